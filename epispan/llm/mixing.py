"""Mixing sources to target weights, with DataFrame operations only.

1. Every source gets a target: its share by weight of all words, at most ``max_repeats`` times its size, the excess reshared.
2. Documents fall into blocks by a hash of their id. A target becomes an exact quota of blocks: full rounds through the
   source, then blocks in hash order, then part of one last block, cut between two documents.
3. Output shards get their blocks from a splitting tree: each node halves its shards and draws, by the multivariate
   hypergeometric law, how many blocks of each source go left. A draw inverts the distribution function from one hashed
   uniform, so reruns agree. Only quotas are in the tree, never documents.
4. Shards take consecutive, hence disjoint, runs of the permuted blocks; documents are ordered by a hash inside a shard.

Blocks hold about ``block_words`` words or ``block_docs`` documents, so a source with a third of all rows is many blocks. The
tree holds one number per source and shard; sources are assumed to be few enough for one array (not a limit of rows).

Defined results: null text has size 0 and is never missed or counted; null source is a source of its own, the last; rows
with equal source and doc_id (null ids too) are taken together; a source without words has target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispan.functions.hashing import stable_hash
from epispan.llm.common import WORD_PATTERN
from epispan.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 2**20
BLOCK_DOCS = 2**16
SHARD_WORDS = 2**22
SEED = 17
PARALLEL_LEVEL = 6
TAIL_DEVIATIONS = 12
HASH_RANGE = float(2**60)
SOURCE = ["no_source", "source_key"]


def word_count(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def source_columns(source: Column) -> list[Column]:
    """The source as two columns without nulls that sort null last."""
    return [source.isNull().alias("no_source"), F.coalesce(source.cast("string"), F.lit("")).alias("source_key")]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """Targets of sources from ``(no_source, source_key, source_size, ...)``.

    With sources ordered by ceiling over weight, capping those before a source leaves a rate of words per weight for the
    others. Capping too few or too many leaves less than the right number does, so the greatest rate is the one that holds.
    """
    by_name = Window.orderBy(*SOURCE)
    by_ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), *SOURCE)
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0))) / F.sum("weight").over(onward)
    return (
        sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.array(*map(F.lit, weights))[F.col("source_no") % len(weights)])
        .withColumn("ceiling", max_repeats * F.col("source_size"))
        .withColumn("rate", rate)
        .withColumn("rate", F.max("rate").over(everything))
        .withColumn("target", F.least(F.col("ceiling").cast("double"), F.col("rate") * F.col("weight")))
        .drop("weight", "ceiling", "rate")
    )


def block_table(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Blocks of every source: place in the source's permutation, words, and what an extra round takes of them."""
    order = Window.partitionBy(*SOURCE).orderBy(stable_hash(SEED, "source_key", "block"), "block")
    blocks = (
        rows.join(sources.select(*SOURCE, "n_blocks"), SOURCE)
        .groupBy(*SOURCE, F.pmod("doc_hash", "n_blocks").alias("block"))
        .agg(F.sum("size").alias("words"))
        .withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))
        .withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("held", F.count(F.lit(1)).over(Window.partitionBy(*SOURCE)))
    )
    left = F.col("rest") - (F.col("upto") - F.col("words"))
    return (
        blocks.join(sources.select(*SOURCE, "source_no", "rounds", "rest"), SOURCE)
        .withColumn("whole", F.col("upto") <= F.col("rest"))
        .withColumn("left", F.when(~F.col("whole") & (left > 0), left))
    )


def cut_points(rows: DataFrame, blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source, the last document of the block that is taken in part."""
    parts = blocks.where("left is not null").select(*SOURCE, "block", "left")
    order = Window.partitionBy(*SOURCE).orderBy("doc_hash", "id_text").rangeBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(sources.select(*SOURCE, "n_blocks"), SOURCE)
        .withColumn("block", F.pmod("doc_hash", "n_blocks"))
        .join(parts, [*SOURCE, "block"])
        .groupBy(*SOURCE, "block", "left", "doc_hash", "id_text")
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", F.sum("size").over(order))
        .where(F.col("upto") - F.col("size") / 2 <= F.col("left"))
        .groupBy(*SOURCE, "block")
        .agg(F.max(F.struct("doc_hash", "id_text")).alias("last_doc"))
    )


def hypergeometric(uniform: Column, good: Column, bad: Column, draws: Column) -> Column:
    """Successes among ``draws`` without replacement, by inversion.

    Weights start at 1 on the left tail and follow the ratio of neighbours; ``TAIL_DEVIATIONS`` standard deviations on
    either side hold all mass that doubles can show.
    """
    total = (good + bad).cast("double")
    mean = draws * good / F.greatest(total, F.lit(1.0))
    spread = F.sqrt(mean * (bad / F.greatest(total, F.lit(1.0))) * (total - draws) / F.greatest(total - 1, F.lit(1.0)))
    low = F.greatest(F.lit(0), draws - bad, F.floor(mean - TAIL_DEVIATIONS * spread) - 1).cast("bigint")
    high = F.least(good, draws, F.ceil(mean + TAIL_DEVIATIONS * spread) + 1).cast("bigint")

    def pick(edge: Column) -> Column:
        steps = F.sequence(edge["low"], edge["high"])
        ratio = lambda x: (good - x).cast("double") * (draws - x) / ((x + 1).cast("double") * (bad - draws + x + 1))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        mass = F.aggregate(steps, start, lambda s, x: F.struct((s["w"] * ratio(x)).alias("w"), (s["sum"] + s["w"]).alias("sum")))["sum"]
        return bound(
            mass * uniform,
            lambda goal: F.aggregate(
                steps,
                F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), edge["high"].alias("x")),
                lambda s, x: F.struct(
                    (s["w"] * ratio(x)).alias("w"),
                    (s["sum"] + s["w"]).alias("sum"),
                    F.when((s["sum"] < goal) & (s["sum"] + s["w"] >= goal), x).otherwise(s["x"]).alias("x"),
                ),
            )["x"],
        )

    return bound(F.struct(low.alias("low"), high.alias("high")), pick)


def split_left(node: Column, quotas: Column, left_blocks: Column) -> Column:
    """Blocks of each source that go to the left half of a node: one multivariate hypergeometric draw."""
    total = F.aggregate(quotas, F.lit(0).cast("bigint"), lambda s, q: s + q)
    start = F.struct(
        total.alias("rest"), left_blocks.alias("open"), F.lit(0).alias("k"), F.array().cast("array<bigint>").alias("picks")
    )

    def step(state: Column, quota: Column) -> Column:
        uniform = (stable_hash(SEED, node, state["k"]) + 0.5) / HASH_RANGE
        rest = state["rest"] - quota
        return bound(
            hypergeometric(uniform, quota, rest, state["open"]),
            lambda x: F.struct(
                rest.alias("rest"),
                (state["open"] - x).alias("open"),
                (state["k"] + 1).alias("k"),
                F.concat(state["picks"], F.array(x)).alias("picks"),
            ),
        )

    return F.aggregate(quotas, start, step)["picks"]


def splitting_tree(quotas: DataFrame, depth: int) -> DataFrame:
    """``(shard, quotas)`` for 2**depth shards from one row ``quotas array<bigint>``."""
    nodes = quotas.select(F.lit(1).cast("bigint").alias("node"), "quotas")
    half = F.floor((F.aggregate("quotas", F.lit(0).cast("bigint"), lambda s, q: s + q) + 1) / 2)
    for level in range(depth):
        if level == PARALLEL_LEVEL:
            nodes = nodes.repartition("node")
        drawn = nodes.withColumn("picks", split_left(F.col("node"), F.col("quotas"), half))
        children = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("picks").alias("quotas")),
            F.struct(
                (2 * F.col("node") + 1).alias("node"), F.zip_with("quotas", "picks", lambda q, p: q - p).alias("quotas")
            ),
        )
        nodes = drawn.select(F.explode(children).alias("child")).select("child.*")
    return nodes.select((F.col("node") - 2**depth).alias("shard"), "quotas")


def block_shards(blocks: DataFrame, depth: int) -> DataFrame:
    """``(source_no, place, shards)``: the shard of each round of a block."""
    taken = F.col("rounds") + F.when(F.col("whole") | F.col("left").isNotNull(), 1).otherwise(0)
    quota = blocks.groupBy("source_no").agg(F.sum(taken).alias("quota"), F.max("held").alias("held"))
    root = quota.agg(F.transform(F.array_sort(F.collect_list(F.struct("source_no", "quota"))), lambda q: q["quota"]).alias("quotas"))
    order = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        splitting_tree(root, depth)
        .select("shard", F.posexplode("quotas").alias("source_no", "n"))
        .withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0)))
        .where("n > 0")
    )
    drawn = runs.select("source_no", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("drawn"))
    return (
        drawn.join(quota.select("source_no", "held"), "source_no")
        .select(
            "source_no",
            F.pmod("drawn", "held").alias("place"),
            F.struct(F.floor(F.col("drawn") / F.col("held")).alias("round"), "shard").alias("drawn"),
        )
        .groupBy("source_no", "place")
        .agg(F.transform(F.array_sort(F.collect_list("drawn")), lambda d: d["shard"]).alias("shards"))
    )


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    block_docs: int = BLOCK_DOCS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per row of ``docs``: ``source_row`` (all its columns), ``size``, ``source_size``, ``target``, ``shards``.

    ``shards`` lists the output shard of every copy that the mix takes of the row; it is empty for a row left out.
    """
    source_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        source_row.alias("source_row"),
        (word_count() if size is None else size).alias("size"),
        *source_columns(F.col("source")),
        id_text.alias("id_text"),
        stable_hash(SEED, F.coalesce(F.col("source").cast("string"), F.lit("")), id_text).alias("doc_hash"),
    )
    narrow = cut(rows.drop("source_row"), "mix-rows")
    sizes = narrow.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = cut(
        source_targets(sizes, weights, max_repeats)
        .withColumn(
            "n_blocks",
            F.greatest(F.ceil(F.col("source_size") / block_words), F.ceil(F.col("n_docs") / block_docs), F.lit(1)).cast("bigint"),
        )
        .withColumn("rounds", rounds)
        .withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")),
        "mix-sources",
    )
    words = sources.agg(F.sum("target")).first()[0] or 0
    depth = math.ceil(math.log2(max(1, words / shard_words)))
    blocks = cut(block_table(narrow, sources), "mix-blocks")
    decided = (
        blocks.join(cut_points(narrow, blocks, sources), [*SOURCE, "block"], "left")
        .join(block_shards(blocks, depth), ["source_no", "place"], "left")
        .select(*SOURCE, "block", "rounds", "whole", "last_doc", "shards")
    )
    extra = F.col("whole") | (F.struct("doc_hash", "id_text") <= F.col("last_doc"))
    copies = F.col("rounds") + F.when(extra, 1).otherwise(0)
    return (
        rows.join(sources.select(*SOURCE, "source_size", "target", "n_blocks"), SOURCE)
        .withColumn("block", F.pmod("doc_hash", "n_blocks"))
        .join(decided, [*SOURCE, "block"], "left")
        .select(
            "source_row",
            "size",
            "source_size",
            "target",
            F.slice(F.coalesce("shards", F.array().cast("array<bigint>")), F.lit(1), copies.cast("int")).alias("shards"),
        )
    )


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: one row per copy, together by shard and shuffled inside it, with the columns of ``docs`` only."""
    copies = mixed.select("source_row", F.posexplode("shards").alias("copy", "shard"))
    local = stable_hash(SEED, "shard", F.coalesce(F.col("source_row.doc_id").cast("string"), F.lit("")), "copy")
    return copies.repartition("shard").sortWithinPartitions("shard", local).select("source_row.*")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, source IS NULL AS no_source, coalesce(source, '') AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || md5('{SEED}:' || coalesce(source, '') || ':' || coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS doc_hash
  FROM documents),
named AS (
  SELECT no_source, source_key, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][((row_number() OVER (ORDER BY no_source, source_key) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight,
         {MAX_REPEATS} * sum(size)::BIGINT AS ceiling
  FROM sized GROUP BY no_source, source_key),
rated AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, no_source, source_key
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ceiling / weight, no_source, source_key
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_rate
  FROM named),
targets AS (
  SELECT no_source, source_key, source_size,
         greatest(ceil(source_size / {BLOCK_WORDS}), ceil(n_docs / {BLOCK_DOCS}), 1)::BIGINT AS n_blocks,
         least(ceiling::DOUBLE,
               max(own_rate) OVER () * weight) AS target
  FROM rated),
sources AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS rounds,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest
  FROM targets),
rows_of AS (
  SELECT s.*, t.source_size, t.target, t.rounds, t.rest, s.doc_hash % t.n_blocks AS block
  FROM sized s JOIN sources t USING (no_source, source_key)),
blocks AS (
  SELECT no_source, source_key, block, any_value(rest) AS rest, sum(size) AS words,
         ('0x' || md5('{SEED}:' || source_key || ':' || block::VARCHAR)[1:15])::BIGINT AS block_hash
  FROM rows_of GROUP BY no_source, source_key, block),
placed AS (
  SELECT *, sum(words) OVER (PARTITION BY no_source, source_key ORDER BY block_hash, block
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM blocks),
decided AS (
  SELECT r.*, p.upto AS block_upto, p.words,
         sum(r.size) OVER (PARTITION BY r.no_source, r.source_key, r.block ORDER BY r.doc_hash, coalesce(r.doc_id::VARCHAR, '')
                           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS doc_upto
  FROM rows_of r JOIN placed p USING (no_source, source_key, block))
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (rounds + CASE WHEN block_upto <= rest THEN 1
                              WHEN rest - (block_upto - words) > 0
                                   AND doc_upto - size / 2 <= rest - (block_upto - words) THEN 1
                              ELSE 0 END))::BIGINT AS taken
FROM decided
"""
