"""Line dedup: two Bloom filters find lines that may repeat; only those are shuffled and confirmed by their text.

1. Each task hashes the keys of its lines once per document and writes the hashes, sorted, by filter segment.
2. A segment streams its hashes through two Bloom filters: a hash whose bits are already in the once-seen filter enters the
   twice-seen filter. No repeated key can be missed; a few single keys pass by chance.
3. The twice-seen filter has a fixed greatest size (``max_filter_bytes``), so it may be broadcast. Documents are scanned
   again and only keys that it holds travel, with their text, to find the smallest document and confirm the repeat.
   If the corpus outgrows the filter, more single keys travel too; the result stays exact.
4. Keys that a document has to drop are joined to it by id.

Defined results: a null or empty text is one empty line. Rows that share a doc_id are one document when repeats are
counted, and each row is returned. A row without doc_id takes no part: it is returned with all its lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.llm.common import WHITE_BYTES, Batches, byte_texts, record
from epispan.session import cut

MIN_KEY_CHARS = 10
SEGMENT_BITS = 12
BITS_PER_HASH = 16
MAX_FILTER_BYTES = 32 * 2**20
HASHES_AT_ONCE = 1_000_000

HASH_SCHEMA = pa.schema([("segment", pa.int32()), ("hashes", pa.binary())])
FILTER_SCHEMA = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])
SUSPECT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE_BYTES).lower()  # bytes.lower() changes A-Z only


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8", "replace")) >= least)


def text_keys(text: bytes, least: int) -> set[bytes]:
    """Distinct keys of a text's lines that are long enough to count."""
    return {k for k in map(line_key, set(text.split(b"\n"))) if long_enough(k, least)}


def hash_of(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def at_most_two(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes, each at most twice: two are enough to tell that it repeats."""
    hashes = np.sort(hashes)
    keep = np.ones(len(hashes), bool)
    keep[2:] = hashes[2:] != hashes[:-2]
    return hashes[keep]


def by_segment(hashes: np.ndarray, segment_bits: int) -> pa.RecordBatch:
    segments = (hashes >> np.uint64(64 - segment_bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]])
    ends = np.r_[starts[1:], len(hashes)]
    return record(
        HASH_SCHEMA, segments[starts].astype(np.int32), [hashes[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    )


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a segment of ``bits`` bits (a power of two)."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(26)) & mask


class TwiceFilter:
    """Once-seen and twice-seen bits of one segment."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits, bool)
        self.twice = np.zeros(bits, bool)

    def add(self, hashes: np.ndarray) -> None:
        values, counts = np.unique(hashes, return_counts=True)
        a, b = positions(values, self.bits)
        again = (counts > 1) | (self.once[a] & self.once[b])
        self.twice[a[again]] = True
        self.twice[b[again]] = True
        self.once[a] = True
        self.once[b] = True


def hashed_lines(docs: DataFrame, least: int, segment_bits: int) -> DataFrame:
    def work(batches: Batches) -> Batches:
        waiting: list[int] = []
        for batch in batches:
            for text in byte_texts(batch):
                waiting += map(hash_of, text_keys(text, least))
                if len(waiting) >= HASHES_AT_ONCE:
                    yield by_segment(at_most_two(np.array(waiting, np.uint64)), segment_bits)
                    waiting = []
        if waiting:
            yield by_segment(at_most_two(np.array(waiting, np.uint64)), segment_bits)

    return docs.where("doc_id is not null and text is not null").select("text").mapInArrow(work, "segment int, hashes binary")


def twice_seen(hashed: DataFrame, segment_bits: int, bits_per_hash: int, max_filter_bytes: int) -> tuple[int, dict[int, np.ndarray]]:
    """Bits of a segment, and the packed twice-seen bits of every segment with a repeat; at most ``max_filter_bytes``."""
    total = hashed.agg(F.sum(F.length("hashes"))).first()[0] or 0
    wanted = total / 8 * bits_per_hash / 2**segment_bits
    most = max_filter_bytes * 8 // 2**segment_bits
    bits = 2 ** min(max(6, math.ceil(math.log2(max(wanted, 1)))), max(6, math.floor(math.log2(max(most, 1)))))

    def work(batches: Batches) -> Batches:
        current, seen = None, None
        for batch in batches:
            for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if segment != current:
                    if seen is not None and seen.twice.any():
                        yield record(FILTER_SCHEMA, [current], [np.packbits(seen.twice).tobytes()])
                    current, seen = segment, TwiceFilter(bits)
                seen.add(np.frombuffer(blob, np.uint64))
        if seen is not None and seen.twice.any():
            yield record(FILTER_SCHEMA, [current], [np.packbits(seen.twice).tobytes()])

    filters = hashed.repartition("segment").sortWithinPartitions("segment").mapInArrow(work, "segment int, bits binary")
    return bits, {row.segment: np.frombuffer(bytes(row.bits), np.uint8) for row in filters.collect()}


def suspected(docs: DataFrame, bits: int, filters: dict[int, np.ndarray], least: int, segment_bits: int) -> DataFrame:
    """(doc_id, key) of every key the twice-seen filter holds."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def holds(hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        segments = (hashes >> np.uint64(64 - segment_bits)).astype(np.int64)
        order = np.argsort(segments, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(segments[order]) != 0, True]) if len(order) else []
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            rows = order[start:end]
            packed = held.value.get(int(segments[rows[0]]))
            if packed is not None:
                a, b = positions(hashes[rows], bits)
                one = lambda p: (packed[p >> np.uint64(3)] >> (7 - (p & np.uint64(7))).astype(np.uint8)) & 1
                found[rows] = (one(a) & one(b)).astype(bool)
        return found

    def work(batches: Batches) -> Batches:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch), strict=True):
                own = text_keys(text, least)
                ids += [doc_id] * len(own)
                keys += own
            hits = np.flatnonzero(holds(np.fromiter(map(hash_of, keys), np.uint64, len(keys))))
            yield record(SUSPECT_SCHEMA, [ids[i] for i in hits], [keys[i] for i in hits])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(work, "doc_id bigint, key binary")


def kept_lines(text: bytes, dropped: Iterable[bytes], least: int) -> tuple[bytes, int, int]:
    """The text without lines whose key is dropped, the lines before, and the lines dropped."""
    lines = text.split(b"\n")
    dropped = set(dropped)
    kept = [line for line in lines if line_key(line) not in dropped] if dropped else lines
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(
    docs: DataFrame,
    least: int = MIN_KEY_CHARS,
    segment_bits: int = SEGMENT_BITS,
    bits_per_hash: int = BITS_PER_HASH,
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``source_row`` (all its columns), ``kept_text``, ``n_lines``, ``n_dropped``.

    ``source_row`` is a struct, so columns of ``docs`` may have any names.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint"), "text")
    hashed = cut(hashed_lines(narrow, least, segment_bits), "line-hashes")
    bits, filters = twice_seen(hashed, segment_bits, bits_per_hash, max_filter_bytes)
    suspects = cut(suspected(narrow, bits, filters, least, segment_bits), "line-suspects")
    repeated = (
        suspects.groupBy("key")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("key", "first")
    )
    drops = (
        suspects.join(repeated, "key")
        .where("doc_id > first")
        .groupBy(F.col("doc_id").alias("drop_id"))
        .agg(F.collect_set("key").alias("keys"))
    )

    @F.pandas_udf("text string, n_lines bigint, n_dropped bigint")
    def keep(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = [
            kept_lines((t or "").encode(), () if k is None else map(bytes, k), least) for t, k in zip(text, keys, strict=True)
        ]
        return pd.DataFrame([(t.decode(), n, d) for t, n, d in rows], columns=["text", "n_lines", "n_dropped"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("source_row"))
    joined = rows.join(drops, F.col("source_row.doc_id").cast("bigint") == F.col("drop_id"), "left")
    done = joined.select("source_row", keep(F.col("source_row.text"), "keys").alias("done"))
    return done.select(
        "source_row",
        F.col("done.text").alias("kept_text"),
        F.col("done.n_lines").alias("n_lines"),
        F.col("done.n_dropped").alias("n_dropped"),
    )


ORACLE = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM split),
repeated AS (
  SELECT line_key, min(doc_id) AS first_doc FROM keyed
  WHERE length(line_key) >= {MIN_KEY_CHARS} GROUP BY line_key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT k.*, coalesce(k.doc_id > r.first_doc, false) AS dropped
  FROM keyed k LEFT JOIN repeated r USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
