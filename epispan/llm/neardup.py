"""Near-duplicate documents by MinHash: many universal hash minima, banding, verification, connected components.

1. Texts with the same shingle set are one class, found by a digest of the set; only the smallest id goes on.
2. A class keeps the minima of ``minima`` universal hash functions over its shingles. Bands of ``rows`` minima are bucket keys.
   At a similarity of 0.85 a pair shares a bucket but for one case in 10**7 (25 bands of 4 rows).
3. Every member of a bucket is paired with the bucket's smallest id. Pairs are tested on the minima, then confirmed on the
   full shingle sets; links join into components.
4. A bucket may still hold different components, whose members differ from the smallest id but perhaps not from each
   other. Members are compared across components on the minima, block by block in numpy; those with a candidate are compared on
   their sets in the same way, and only links that join two components leave a block. No bucket is capped, no member is
   left out and no list of pairs is written.

Defined results: a text without words has an empty set and links with nothing; fewer words than a shingle make one shingle;
rows that share a doc_id are one document, linked with what any of them links with; a row without doc_id links with nothing
and has a null component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.llm.common import Batches, byte_texts, emptied, mix64, record
from epispan.llm.components import components
from epispan.operators.joins import broadcast_if_small
from epispan.session import cut

SHINGLE_WORDS = 5
SIMILARITY = 85  # percent
MINIMA = 100
ROWS = 4
SEED = 11
#: Minima that must agree, in standard errors below the similarity asked for.
MARGIN_ERRORS = 5.0
BLOCK_MEMBERS = 512
COLUMNS = 4096
HASH_CHUNK = 4096
KEPT_WORDS = 200_000
LONG_WORD = 64

SIGNED_DDL = "doc_id bigint, n_shingles bigint, digest binary, minima binary"
SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("minima", pa.binary())])
SET_DDL = "doc_id bigint, shingles array<bigint>"
SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


class WordHashes(dict):
    """64-bit hash per word, kept by a worker and emptied when it has grown; long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORD_HASHES = WordHashes()


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, A-Z lower-cased."""
    own = WORD_HASHES.of(text.lower().split())
    if not len(own):
        return own
    words = min(words, len(own))
    count = len(own) - words + 1
    rolled = np.full(count, words, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            rolled = mix64(rolled + own[k : k + count])
    return np.unique(rolled)


def universal(minima: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the hash functions ``(a * x + b) mod 2**64``, of which the high half counts."""
    draw = np.random.default_rng(SEED)
    a, b = draw.integers(0, 2**63, (2, minima), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def minima_of(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32-bit minima of every function over a non-empty set."""
    best = np.full(len(a), 2**32 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(hashes), HASH_CHUNK):
            part = hashes[start : start + HASH_CHUNK]
            best = np.minimum(best, ((a[:, None] * part + b[:, None]) >> np.uint64(32)).min(axis=1))
    return best.astype(np.uint32)


def signed(docs: DataFrame, words: int, minima: int) -> DataFrame:
    def work(batches: Batches) -> Batches:
        a, b = universal(minima)
        for batch in batches:
            rows = []
            for text in byte_texts(batch):
                own = shingles(text, words)
                blob = own.tobytes()
                rows.append((len(own), hashlib.md5(blob).digest() if len(own) else None, minima_of(own, a, b).tobytes() if len(own) else None))
            yield record(SIGNED, batch.column("doc_id"), *([r[k] for r in rows] for k in range(3)))

    return docs.mapInArrow(lambda batches: emptied(work(batches), WORD_HASHES), SIGNED_DDL)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    def work(batches: Batches) -> Batches:
        for batch in batches:
            sets = [shingles(t, words).view(np.int64) for t in byte_texts(batch)]
            offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield record(SETS, batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))

    return docs.mapInArrow(lambda batches: emptied(work(batches), WORD_HASHES), SET_DDL)


def band_keys(classes: DataFrame, rows: int, minima: int) -> DataFrame:
    """``(band, key, id)``: a 64-bit hash of each band's minima."""
    bands = [F.xxhash64(F.lit(k), F.substring("minima", 4 * rows * k + 1, 4 * rows)) for k in range(minima // rows)]
    return classes.select(F.posexplode(F.array(*bands)).alias("band", "key"), F.col("doc_id").alias("id"))


def least_agreeing(similarity: int, minima: int) -> int:
    share = similarity / 100
    return int(np.floor(minima * (share - MARGIN_ERRORS * (share * (1 - share) / minima) ** 0.5)))


def agreeing(candidates: DataFrame, signs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of which at least ``least`` minima are equal."""

    @F.pandas_udf("int")
    def equal(left: pd.Series, right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype="int32")
        x, y = (signatures(s) for s in (left, right))
        return pd.Series((x == y).sum(axis=1).astype(np.int32))

    return (
        candidates.join(signs.select(F.col("id").alias("b"), F.col("minima").alias("of_b")), "b")
        .join(signs.select(F.col("id").alias("a"), F.col("minima").alias("of_a")), "a")
        .where(equal("of_a", "of_b") >= least)
        .select("a", "b")
    )


def signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint32).reshape(len(column), -1)


def sets_of(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Shingle sets of the documents in ``ids (doc_id)``, written once for all joins that need them."""
    wanted = broadcast_if_small(cut(ids.distinct(), "wanted"))
    return cut(shingle_sets(docs.join(wanted, "doc_id", "left_semi"), words), "shingle-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose full sets are similar enough. A set travels with the pairs of its larger id, never with its smaller id."""
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")), "a")
        .where(100 * shared >= similarity * (F.size("of_a") + F.size("of_b") - shared))
        .select("a", "b")
        .distinct()
    )


def labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    joined = members.join(found, "id", "left")
    return joined.select(*members.columns, F.coalesce("component", "id").alias("component"))


def mixed_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that still hold more than one component; of buckets with the same members, one."""
    named = labelled(members, found)
    buckets = (
        named.groupBy("band", "key")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("same"),
            F.count(F.lit(1)).alias("size"),
        )
        .where("low < high")
        .groupBy("same", "size")
        .agg(F.min(F.struct("band", "key")).alias("bucket"))
        .select("bucket.band", "bucket.key", "size")
    )
    return named.join(buckets, ["band", "key"])


def block_pairs(members: DataFrame) -> DataFrame:
    """Members dealt to the pairs of blocks of their bucket: work of a bucket spreads over tasks of fixed memory."""
    n_blocks = F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(SEED)), n_blocks).cast("int")
    return (
        members.withColumn("n_blocks", n_blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .drop("n_blocks", "other", "size")
    )


def sides(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    low, high = block["low"].iloc[0], block["high"].iloc[0]
    return block[block["own"] == low], block[block["own"] == high]


def suspects(mixed: DataFrame, signs: DataFrame, least: int) -> DataFrame:
    """Members of mixed buckets whose minima agree well enough with a member of another component."""

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        left, right = sides(block)
        if not len(left) or not len(right):  # no member fell into one of the two blocks
            return pd.DataFrame({"band": [], "key": [], "id": []}).astype({"band": "int32", "key": "int64", "id": "int64"})
        x, y = signatures(left["minima"]), signatures(right["minima"])
        other, hit = right["component"].to_numpy(), np.zeros(len(right), bool)
        ids = []
        for sign, i, component in zip(x, left["id"], left["component"], strict=True):
            near = ((sign == y).sum(axis=1) >= least) & (other != component)
            hit |= near
            ids += [i] * bool(near.any())
        both = np.unique(np.r_[np.array(ids, np.int64), right["id"].to_numpy(np.int64)[hit]])
        return pd.DataFrame({"band": block["band"].iloc[0], "key": block["key"].iloc[0], "id": both})

    dealt = block_pairs(mixed.join(signs, "id"))
    return dealt.groupBy("band", "key", "low", "high").applyInPandas(compare, "band int, key bigint, id bigint").distinct()


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets: a matrix product over the values that both sides hold."""
    sizes = [[len(s) for s in side] for side in (left, right)]
    values = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(*values)
    rows, places = [], []
    for side, own in zip(values, sizes, strict=True):
        at = np.minimum(np.searchsorted(shared, side), max(len(shared) - 1, 0))
        held = shared[at] == side if len(shared) else np.zeros(len(side), bool)
        rows.append(np.repeat(np.arange(len(own)), own)[held])
        places.append(at[held])
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), COLUMNS):
        part = []
        for k in range(2):
            grid = np.zeros((len(sizes[k]), COLUMNS), np.float32)
            inside = (places[k] >= start) & (places[k] < start + COLUMNS)
            grid[rows[k][inside], places[k][inside] - start] = 1
            part.append(grid)
        total += part[0] @ part[1].T
    return total


def across(members: DataFrame, sets: DataFrame, similarity: int, whole: bool = False) -> DataFrame:
    """Links (a, b) that join different components of a bucket; of several that join the same two, one.

    All pairs of two blocks are compared at once. Sets are compared by 32 bits of their values unless ``whole``, which can
    only make a pair look more alike: no link is missed, and the links found are confirmed on the full values afterwards.
    """
    values = F.col("shingles") if whole else F.transform("shingles", lambda s: F.shiftright(s, 32).cast("int"))
    short = sets.select(F.col("doc_id").alias("id"), values.alias("values"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        left, right = sides(block)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        shared = common_counts(*([np.unique(v) for v in side["values"]] for side in (left, right)))
        n, m = (np.array([len(v) for v in side["values"]], np.float64) for side in (left, right))
        alike = 100 * shared >= similarity * (n[:, None] + m - shared)
        alike &= left["component"].to_numpy()[:, None] != right["component"].to_numpy()
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        links = []
        for i, j in zip(*np.nonzero(alike), strict=True):
            p, q = top(int(left["component"].iloc[i])), top(int(right["component"].iloc[j]))
            if p != q:
                root[p] = q
                a, b = int(left["id"].iloc[i]), int(right["id"].iloc[j])
                links.append((min(a, b), max(a, b)))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    dealt = block_pairs(members.join(short, "id"))
    return dealt.groupBy("band", "key", "low", "high").applyInPandas(compare, "a bigint, b bigint").distinct()


def joined_up(members: DataFrame, found: DataFrame, links: DataFrame, signs: DataFrame, known: DataFrame, words: int, similarity: int, least: int):
    """Components after the links across components of all mixed buckets."""
    mixed = cut(mixed_buckets(members, found), "mixed")
    chosen = cut(suspects(mixed, signs, least), "suspects")
    sizes = chosen.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"))
    own = labelled(chosen, found).join(sizes, ["band", "key"])
    sets = sets_of(chosen.select(F.col("id").alias("doc_id")), known, words)
    more = cut(across(own, sets, similarity), "across")
    sure = cut(confirmed(more, sets, similarity), "confirmed")
    if sure.count() < more.count():  # 32 bits deceived: a false link may have stood for a true one, so compare all bits
        sure = across(own, sets, similarity, whole=True)
    return cut(components(links.union(sure)), "components")


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    similarity: int = SIMILARITY,
    minima: int = MINIMA,
    rows: int = ROWS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs`` (rows without doc_id included)."""
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    known = texts.where("doc_id is not null")
    first = cut(signed(texts, words, minima), "signed")
    sets = first.where("doc_id is not null and digest is not null")
    least_row = F.min(F.struct("doc_id", "minima")).alias("least_row")
    classes = cut(sets.groupBy("digest", "n_shingles").agg(least_row).select("digest", "n_shingles", "least_row.*"), "classes")
    twins = classes.select("digest", "n_shingles", F.col("doc_id").alias("twin"))
    of_class = sets.select("doc_id", "digest", "n_shingles").join(twins, ["digest", "n_shingles"])
    ids = of_class.groupBy("doc_id").agg(F.min("twin").alias("a"), F.max("twin").alias("z")).where("a < z")
    same_id = of_class.join(ids, "doc_id").where("twin > a").select("a", F.col("twin").alias("b"))

    least = least_agreeing(similarity, minima)
    bands = cut(band_keys(classes, rows, minima), "bands")
    buckets = cut(bands.groupBy("band", "key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z"), "buckets")
    members = cut(bands.join(broadcast_if_small(buckets), ["band", "key"]).select("band", "key", "id", "a"), "members")
    involved = broadcast_if_small(cut(members.select(F.col("id").alias("doc_id")).distinct(), "involved"))
    signs = cut(classes.join(involved, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "minima").distinct(), "signs")
    stars = members.where("id > a").select("a", F.col("id").alias("b")).distinct()
    pairs = cut(agreeing(stars, signs, least), "pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    links = cut(confirmed(pairs, sets_of(ends, known, words), similarity).union(same_id), "confirmed")
    found = cut(components(links), "components")
    found = joined_up(members.drop("a"), found, links, signs, known, words, similarity, least)
    of_row = first.select("doc_id", "n_shingles", "digest").join(twins, ["digest", "n_shingles"], "left")
    labels = labelled(of_row.withColumn("id", F.coalesce("twin", "doc_id")), found)
    return labels.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


#: Exact links by shared shingles; fine for the small tables that SQL is run on.
ORACLE = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE_WORDS} THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - {SHINGLE_WORDS - 2}), lambda k: array_to_string(ws[k:k + {SHINGLE_WORDS - 1}], ' '))
         END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
  WHERE 100 * common >= {SIMILARITY} * (m.n + n.n - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) d LEFT JOIN sizes USING (doc_id)
"""
