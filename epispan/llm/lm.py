"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform share.

P(w | v) = a2 c(v,w)/c(v) + a1 c(w)/N + a0/(V+1). The weights depend on a bucket of c(v), the frequency of the context, and are
learned by expectation-maximisation: maximum-likelihood estimates come from the training documents less a deleted
part, the weights from the tokens of that part. Scores then use the counts of all training documents.

How it runs. Documents become batches of token numbers with a sorted list of word hashes. A batch sends its distinct hashes, in
delta form, to hash segments; a segment adds up counts and answers each batch in the batch's own order, so an answer is
one small count per entry. Words and bigrams go the same way. Hot words cost one entry per batch. Batches and answers
meet by batch number: first those of the deleted part, whose tokens become a histogram of estimates per bucket (a few
ten thousand cells, whatever the size of the data) for the weights, then all for the scores.

Words are told apart by a 64-bit hash. Defined results: a null text is empty, one end token; a row without doc_id is scored but
never learned from, and is not held out; rows that share an id are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.llm.common import Batches, byte_texts, crc_of_id, mix64, record
from epispan.session import cut

FOLDS, HELD_OUT, DELETED, LEARNED, NO_ID = 10, 0, 1, 2, 3
BATCH_BYTES = 16 * 2**20
SEGMENT_TOKENS = 2**21
ADD = 0.1
STEP = 0.5  # width of a histogram cell, in doublings
NEVER = -1  # the cell of an estimate that is 0
CELLS = 512
BUCKETS = 40
EM_ROUNDS = 200
EM_TOLERANCE = 1e-7
LEAST_WEIGHT = 1e-6
END_HASH = xxhash.xxh3_64_intdigest(b"\n")  # no word holds a line feed

BATCH_DDL = "batch bigint, deleted boolean, doc_ids array<bigint>, parts binary, lengths binary, tokens binary, hashes binary"
BATCH = pa.schema(
    [("batch", pa.int64()), ("deleted", pa.bool_()), ("doc_ids", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("parts", "lengths", "tokens", "hashes")]
)
ASK_DDL = "segment int, batch bigint, deleted boolean, hashes binary, counts binary"
ASK = pa.schema(
    [("segment", pa.int32()), ("batch", pa.int64()), ("deleted", pa.bool_()), ("hashes", pa.binary()), ("counts", pa.binary())]
)
ANSWER_DDL = (
    "segment int, batch bigint, deleted boolean, learned binary, total binary, "
    "n_learned bigint, n_total bigint, v_learned bigint, v_total bigint"
)
ANSWER = pa.schema(
    [("segment", pa.int32()), ("batch", pa.int64()), ("deleted", pa.bool_()), ("learned", pa.binary()), ("total", pa.binary())]
    + [(c, pa.int64()) for c in ("n_learned", "n_total", "v_learned", "v_total")]
)
CELL_DDL = "bucket int, two int, one int, n bigint"
CELL = pa.schema([("bucket", pa.int32()), ("two", pa.int32()), ("one", pa.int32()), ("n", pa.int64())])
SCORE_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
SCORE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("train_tokens", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)


def tight(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned integers that hold them; the first byte tells which."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def loose(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def deltas(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane: the high planes are zeros, which compress away."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def undeltas(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def to_batches(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Batches of documents as token numbers; the deleted part has batches of its own."""

    class Waiting:
        def __init__(self):
            self.ids, self.parts, self.lengths, self.tokens, self.size = [], [], [], [], 0
            self.words: dict[bytes, int] = {}

        def add(self, doc_id, part: int, text: bytes) -> None:
            words = self.words
            tokens = [words.setdefault(w, len(words)) for w in text.lower().split()]
            tokens.append(words.setdefault(b"\n", len(words)))
            self.ids.append(doc_id)
            self.parts.append(part)
            self.lengths.append(len(tokens))
            self.tokens.append(np.array(tokens, np.int32))
            self.size += len(text) + 64

        def done(self, batch: int, deleted: bool) -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
            hashes, place = np.unique(hashes, return_inverse=True)
            tokens = place.astype("<i4")[np.concatenate(self.tokens)]
            arrays = np.array(self.parts, np.uint8), np.array(self.lengths, "<i4"), tokens
            return record(BATCH, [batch], [deleted], [self.ids], *([a.tobytes()] for a in arrays), [deltas(hashes)])

    def work(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId() << 32
        waiting = {False: Waiting(), True: Waiting()}
        for batch in batches:
            for doc_id, part, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), byte_texts(batch), strict=True
            ):
                deleted = part == DELETED
                waiting[deleted].add(doc_id, part, text)
                if waiting[deleted].size >= batch_bytes:
                    yield waiting[deleted].done(number, deleted)
                    number += 1
                    waiting[deleted] = Waiting()
        for deleted, rest in waiting.items():
            if rest.ids:
                yield rest.done(number, deleted)
                number += 1

    fold = F.pmod(crc_of_id(), F.lit(FOLDS))
    part = F.when(fold == 0, HELD_OUT).when(fold == 1, DELETED).when(fold.isNotNull(), LEARNED).otherwise(NO_ID)
    return docs.select(F.col("doc_id").cast("bigint"), part.alias("part"), "text").mapInArrow(work, BATCH_DDL)


class Tokens:
    """A batch row as arrays: token numbers, their contexts, and whether a token is learned from."""

    def __init__(self, row: dict):
        self.row = row
        self.hashes = undeltas(row["hashes"])
        self.tokens = np.frombuffer(row["tokens"], "<i4").astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
        self.parts = np.frombuffer(row["parts"], np.uint8)
        self.end = int(np.searchsorted(self.hashes, np.uint64(END_HASH)))
        # the end of the document before is the context of a first word, and nothing else has it as context
        self.contexts = np.r_[self.end, self.tokens[:-1]]
        self.learned = np.repeat((self.parts == LEARNED) | (self.parts == DELETED), self.lengths)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.hashes, np.bincount(self.tokens[self.learned], minlength=len(self.hashes))

    def pair_hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(mix64(self.hashes)[self.contexts] + self.hashes[self.tokens])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        hashes, place = np.unique(self.pair_hashes(), return_inverse=True)
        return hashes, np.bincount(place[self.learned], minlength=len(hashes))


def asked(batches: DataFrame, kind: str, segment_bits: int) -> DataFrame:
    """What batches ask: their distinct hashes with their own training counts, by segment."""

    def work(rows: Batches) -> Batches:
        for some in rows:
            for row in some.to_pylist():
                hashes, counts = getattr(Tokens(row), kind)()
                segments = (hashes >> np.uint64(32) >> np.uint64(32 - segment_bits)).astype(np.int64)
                edges = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1], True])
                spans = list(zip(edges[:-1], edges[1:], strict=True))
                yield record(
                    ASK,
                    [int(segments[a]) for a, _ in spans],
                    [row["batch"]] * len(spans),
                    [row["deleted"]] * len(spans),
                    [deltas(hashes[a:b]) for a, b in spans],
                    [tight(counts[a:b]) for a, b in spans],
                )

    return batches.mapInArrow(work, ASK_DDL)


def answer(table: pa.Table) -> pa.Table:
    """Counts of a segment's hashes over all batches, sent back in each batch's order."""
    rows = table.to_pylist()
    own = [undeltas(r["hashes"]) for r in rows]
    counts = [loose(r["counts"]) for r in rows]
    sizes = [len(h) for h in own]
    distinct, place = np.unique(np.concatenate(own), return_inverse=True)
    from_deleted = np.repeat([r["deleted"] for r in rows], sizes)
    every = np.concatenate(counts)
    total = np.bincount(place, every, len(distinct)).astype(np.int64)
    learned = np.bincount(place, every * ~from_deleted, len(distinct)).astype(np.int64)
    edges = np.r_[0, np.cumsum(sizes)]
    parts = [place[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    sums = [int(learned.sum()), int(total.sum()), int((learned > 0).sum()), int((total > 0).sum())]
    return pa.Table.from_batches(
        [
            record(
                ANSWER,
                [r["segment"] for r in rows],
                [r["batch"] for r in rows],
                [r["deleted"] for r in rows],
                # only the deleted part is ever scored against the counts of the others alone
                [tight(learned[p]) if r["deleted"] else None for r, p in zip(rows, parts, strict=True)],
                [tight(total[p]) for p in parts],
                *([s] + [0] * (len(rows) - 1) for s in sums),
            )
        ]
    )


def counted(batches: DataFrame, kind: str, segment_bits: int) -> DataFrame:
    return cut(asked(batches, kind, segment_bits).groupBy("segment").applyInArrow(answer, ANSWER_DDL), f"lm-{kind}")


def gathered(answers: pa.Table, kind: str, column: str) -> np.ndarray:
    rows = sorted((r for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r["segment"])
    return np.concatenate([loose(r[column]) for r in rows])


def estimates(own: Tokens, answers: pa.Table, column: str, n_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: count of the word, count of the context, and the bigram and unigram estimates."""
    words = gathered(answers, "words", column)
    pairs = gathered(answers, "pairs", column)
    place = np.unique(own.pair_hashes(), return_inverse=True)[1]
    c_word, c_context = words[own.tokens], words[own.contexts]
    two = pairs[place] / np.maximum(c_context, 1)
    return c_word, c_context, two, c_word / max(n_tokens, 1)


def bucket_of(c_context: np.ndarray) -> np.ndarray:
    """0 for an unknown context, else one more than the doublings of its count."""
    return np.where(c_context > 0, 1 + np.floor(np.log2(np.maximum(c_context, 1))), 0).astype(np.int64)


def cell_of(estimate: np.ndarray, uniform: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        doublings = np.log2(estimate / uniform)
    return np.where(estimate > 0, np.clip(np.round(doublings / STEP), -CELLS // 2, CELLS // 2 - 1) + CELLS // 2, NEVER).astype(np.int64)


def ratio_of(cell: np.ndarray) -> np.ndarray:
    """The estimate over the uniform share that a cell stands for."""
    return np.where(cell == NEVER, 0.0, np.exp2((cell - CELLS // 2) * STEP))


def met(batches: DataFrame, answers: DataFrame):
    return batches.groupBy("batch").cogroup(answers.groupBy("batch"))


def histogram(batches: DataFrame, answers: DataFrame, n_tokens: int, vocabulary: int) -> np.ndarray:
    """Tokens of the deleted part by context bucket and by cells of their two estimates."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = [np.zeros(0, np.int64)]
        for row in left.to_pylist():
            own = Tokens(row)
            _, c_context, two, one = estimates(own, right, "learned", n_tokens)
            cells = cell_of(two, 1 / (vocabulary + 1)) + 1, cell_of(one, 1 / (vocabulary + 1)) + 1
            keys.append((bucket_of(c_context) * (CELLS + 1) + cells[0]) * (CELLS + 1) + cells[1])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        bucket, rest = np.divmod(key, (CELLS + 1) ** 2)
        two, one = np.divmod(rest, CELLS + 1)
        return pa.Table.from_batches([record(CELL, bucket.astype(np.int32), (two - 1).astype(np.int32), (one - 1).astype(np.int32), n)])

    cells = met(batches.where("deleted"), answers.where("deleted")).applyInArrow(work, CELL_DDL)
    rows = cells.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()
    return np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4)


def learn_weights(cells: np.ndarray) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per bucket by expectation-maximisation over the histogram."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0.0, 0.7, 0.3]
    last = None
    for bucket in range(BUCKETS):
        own = cells[cells[:, 0] == bucket]
        if len(own):
            shares = np.c_[ratio_of(own[:, 1]), ratio_of(own[:, 2]), np.ones(len(own))]
            n = own[:, 3].astype(float)
            now = np.full(3, 1 / 3)
            for _ in range(EM_ROUNDS):
                post = shares * now
                new = (post / post.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
                moved, now = np.abs(new - now).max(), new
                if moved < EM_TOLERANCE:
                    break
            now = np.maximum(now, LEAST_WEIGHT)
            last = now / now.sum()
            weights[bucket] = last
        elif bucket and last is not None:
            weights[bucket] = last  # no such context in the deleted part: like the next rarer ones
    weights[0, 0] = 0.0
    weights[0] /= weights[0].sum()
    return weights


def scored(batches: DataFrame, answers: DataFrame, n_tokens: int, vocabulary: int, weights: np.ndarray) -> DataFrame:
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            own = Tokens(row)
            c_word, c_context, two, one = estimates(own, right, "total", n_tokens)
            w = weights[np.minimum(bucket_of(c_context), BUCKETS - 1)]
            chance = w[:, 0] * two + w[:, 1] * one + w[:, 2] / (vocabulary + 1)
            base = np.log10((c_word + ADD) / (n_tokens + ADD * (vocabulary + 1)))
            starts = np.cumsum(own.lengths) - own.lengths
            sums = [np.add.reduceat(x, starts) for x in ((c_word > 0).astype(np.int64), base, np.log10(chance))]
            n = len(starts)
            out.append(record(SCORE, row["doc_ids"], own.parts == HELD_OUT, own.lengths, sums[0], [n_tokens] * n, sums[1], sums[2]))
        return pa.Table.from_batches(out, SCORE)

    return met(batches, answers).applyInArrow(work, SCORE_DDL)


def score_documents(docs: DataFrame, batch_bytes: int = BATCH_BYTES, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``."""
    spark = docs.sparkSession
    batches = cut(to_batches(docs, batch_bytes), "lm-batches")
    total = batches.agg(F.sum(F.length("tokens"))).first()[0]
    if not total:
        return spark.createDataFrame([], SCORE_DDL)
    segment_bits = max(0, int(np.ceil(np.log2(max(1, total / 4 / segment_tokens)))))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "1")  # a row is a whole batch of documents
    try:
        words, pairs = (counted(batches, kind, segment_bits) for kind in ("words", "pairs"))
        sums = words.agg(*[F.sum(c).alias(c) for c in ("n_learned", "n_total", "v_learned", "v_total")]).first()
        columns = ["batch", "deleted", "segment", "learned", "total"]
        answers = words.select(*columns, F.lit("words").alias("kind")).union(pairs.select(*columns, F.lit("pairs").alias("kind")))
        cells = histogram(batches, answers, sums.n_learned, sums.v_learned)
        return cut(scored(batches, answers, sums.n_total, sums.v_total, learn_weights(cells)), "lm-scores")
    finally:
        spark.conf.set(size, before)
