"""Token ids in binary files: frequency-ranked, byte-aligned variable length, control bytes apart from data bytes.

Format, a folder with two Parquet tables. ``ranks``: (rank, id), the most frequent id first. ``blocks``: rows in ascending order of
document, each with ``shard`` and ``block`` numbers, ``first`` (ids of the shard before the block), ``doc_ids`` and ``counts`` of its
documents, ``control`` and ``data``. A value is the rank of an id in 1 to 4 little-endian bytes of ``data``; ``control``
holds the lengths less one, 2 bits each, four values to a byte, first value lowest. A reader needs no other state, so
shards and blocks are read in parallel; Spark's committer makes a lost task harmless.

Defined results: null or empty text has the end id only; null doc_id sorts first; rows with equal doc_id stay separate rows.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epispan.llm.common import Batches, emptied, record, texts
from epispan.llm.pretokens import MARK, PieceEncoder
from epispan.session import cut, scratch_path

END_ID = 2
BLOCK_IDS = 2**18
IDS_PER_SHARD = 2**24
#: Bytes of texts that are encoded together.
GROUP_BYTES = 4 << 20

IDS_DDL = "doc_id bigint, ids binary"
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
COUNTS = pa.schema([("id", pa.int64()), ("n", pa.int64())])
BLOCK_DDL = "shard int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, control binary, data binary"
BLOCKS = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("first", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
        ("control", pa.binary()),
        ("data", pa.binary()),
    ]
)
READ_DDL = "shard int, offset bigint, doc_id bigint, ids binary"
READ = pa.schema([("shard", pa.int32()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

#: Lengths of the four values that a control byte speaks for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit values."""
    values = values.astype("<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values back, by looking lengths up in a table of the 256 control bytes."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    starts = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = np.zeros(count, np.uint32)
    for k in range(4):
        more = lengths > k
        values[more] |= padded[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def byte_letters() -> str:
    """The letters by which byte-level vocabularies write the bytes 0 to 255: printable ones stand for themselves."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


BYTE_LETTERS = byte_letters()
MARK_LETTER = BYTE_LETTERS[ord(MARK)]

#: Signs that are one pre-token where they follow a word in a row. The apostrophe is none of them, since it may begin an ending.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """The public tokenizer. A byte-level one is asked once per distinct pre-token, any other one per text."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        read = json.loads(definition)
        cut = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_piece = (
            read["model"]["type"] == "BPE"
            and read["normalizer"] is None
            and read["truncation"] is None
            and cut.items() <= (read["pre_tokenizer"] or {}).items()
        )
        self.pieces = PieceEncoder(self.split, self.encode_tokens)
        self.id_bytes = [np.array(k, self.dtype).tobytes() for k in range(self.tokenizer.get_vocab_size())]

    def split(self, piece: str) -> list[str]:
        """Pre-tokens: as they stand in the text if the piece is a word and signs, else in the letters of the vocabulary after a mark."""
        word = piece.rstrip(SIGNS)
        if word and (word[1:] if word[0] == " " else word).isalpha():
            return [piece] if len(word) == len(piece) else [word, piece[len(word) :]]
        return [MARK + token for token, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def encode_tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens; the bytes of all those that stand as in the text become letters in one call."""
        plain = [t for t in tokens if t[0] != MARK]
        lettered = iter(codecs.charmap_decode(MARK.join(plain).encode(), "strict", BYTE_LETTERS)[0].split(MARK_LETTER))
        tokenize, own = self.tokenizer.model.tokenize, self.id_bytes
        return [b"".join([own[t.id] for t in tokenize(token[1:] if token[0] == MARK else next(lettered))]) for token in tokens]

    def encode(self, batch: list[str], end_id: int) -> list[bytes]:
        end = np.array([end_id], self.dtype).tobytes()
        by_piece = [self.by_piece and not any(a in t for a in self.added) for t in batch]
        pieced = iter(self.pieces.encode([t for t, cut in zip(batch, by_piece, strict=True) if cut]))
        return [(next(pieced) if cut else self.encode_text(t)) + end for t, cut in zip(batch, by_piece, strict=True)]

    def encode_text(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


ENCODERS: dict[int, Encoder] = {}


def encoder(shared: Broadcast) -> Encoder:
    key = hash(shared.value)
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = Encoder(shared.value)
    return ENCODERS[key]


def default_definition() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def grouped(batches: Batches, size: int = GROUP_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Neighbouring batches of about ``size`` bytes together, so that a piece is looked up once for all of them."""
    group, held = [], 0
    for batch in batches:
        group.append(batch)
        held += batch.nbytes
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def token_ids(docs: DataFrame, definition: str, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, ids)`` of whole texts, the end id last; 16-bit ids if the vocabulary allows, else 32-bit."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def work(batches: Batches) -> Batches:
        for group in grouped(batches):
            encoded = encoder(shared).encode([t for batch in group for t in texts(batch)], end_id)
            for batch in group:
                yield record(IDS, batch.column("doc_id"), encoded[: batch.num_rows])
                del encoded[: batch.num_rows]

    def whole_task(batches: Batches) -> Batches:
        return emptied(work(batches), encoder(shared).pieces.known)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(whole_task, IDS_DDL)


def ranked_ids(encoded: DataFrame, dtype: str) -> DataFrame:
    """``(rank, id, n)``: ids by frequency, the most frequent first; as many rows as the vocabulary has ids in use."""

    def work(batches: Batches) -> Batches:
        total = np.zeros(1, np.int64)
        for batch in batches:
            counts = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype))
            if len(counts) > len(total):
                total = np.r_[total, np.zeros(len(counts) - len(total), np.int64)]
            total[: len(counts)] += counts
        used = np.flatnonzero(total)
        yield record(COUNTS, used, total[used])

    counts = encoded.mapInArrow(work, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1)


def write_tokens(docs: DataFrame, path: str, definition: str, end_id: int = END_ID, ids_per_shard: int = IDS_PER_SHARD) -> None:
    """Encode whole texts and write them below ``path`` in the format above."""
    spark = docs.sparkSession
    dtype = Encoder(definition).dtype
    encoded = cut(token_ids(docs, definition, end_id), "token-ids")
    ranked_ids(encoded, dtype).select("rank", "id", "n").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = spark.read.parquet(f"{path}/ranks").select("id", "rank", "n").collect()
    table = np.zeros(max((r.id for r in ranks), default=0) + 1, np.uint32)
    for r in ranks:
        table[r.id] = r.rank
    shared = spark.sparkContext.broadcast(table)
    shards = max(1, -(-sum(r.n for r in ranks) // ids_per_shard), min(len(ranks), spark.sparkContext.defaultParallelism))

    def work(batches: Batches) -> Batches:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids, parts, waiting = [], [], 0

        def done() -> pa.RecordBatch:
            control, data = pack(shared.value[np.frombuffer(b"".join(parts), dtype)])
            counts = [len(p) // np.dtype(dtype).itemsize for p in parts]
            return record(BLOCKS, [shard], [block], [first], [sum(counts)], [ids], [counts], [control], [data])

        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(doc_id)
                parts.append(own)
                waiting += len(own) // np.dtype(dtype).itemsize
                if waiting >= BLOCK_IDS:
                    yield done()
                    first, block = first + waiting, block + 1
                    ids, parts, waiting = [], [], 0
        if parts:
            yield done()

    ordered = encoded.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(work, BLOCK_DDL).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` from the files: ``start`` counts the ids of all documents before, ``ids`` are 32-bit."""
    ranks = spark.read.parquet(f"{path}/ranks").select("rank", "id").collect()
    table = np.zeros(len(ranks), "<u4")
    for r in ranks:
        table[r.rank] = r.id
    shared = spark.sparkContext.broadcast(table)

    def work(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                ids = shared.value[unpack(row["control"], row["data"], row["n_ids"])]
                ends = np.cumsum(row["counts"])
                starts = ends - row["counts"]
                yield record(
                    READ,
                    [row["shard"]] * len(ends),
                    starts + row["first"],
                    row["doc_ids"],
                    [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
                )

    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        blocks.groupBy("shard")
        .agg(F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("base"))
    )
    rows = blocks.mapInArrow(work, READ_DDL).join(F.broadcast(bases), "shard")
    return rows.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "ids")


def round_trip(docs: DataFrame, definition: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write to a new folder in the shared space and read it back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, definition or default_definition(), end_id)
    return read_tokens(spark, path)


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
