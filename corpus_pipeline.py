"""A training-corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's docs; all but the last return the columns of ``documents``, with the text and its length as the
stage leaves them. A row without doc_id passes the stages like any other row; it is never merged with other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispan.llm import bpe, lines, mixing, neardup, quality
from epispan.llm.common import documents, prepared
from epispan.session import cut

#: Byte-level BPE has no SQL form; the tests hold run() against a plain Python version of all stages.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Percent of shingles that two documents of the near-duplicate stage share at least; op9 asks for more.
NEAR_SIMILARITY = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the quality rules."""
    prepared(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without lines that an earlier document holds; a text of which nothing is left goes."""
    prepared(spark)
    done = lines.dedup_lines(docs)
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    columns = [changed.get(c, F.col(f"source_row.`{c}`")).alias(c) for c in docs.columns]
    return done.where("n_dropped < n_lines").select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    prepared(spark)
    found = neardup.near_duplicates(docs.select("doc_id", "text"), similarity=NEAR_SIMILARITY)
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy that it takes of a document, shuffled into output shards."""
    prepared(spark)
    return mixing.mixed_rows(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, little-endian 32-bit in ``ids``, with the digests of ids and of the decoded text."""
    prepared(spark)
    return bpe.digest(bpe.encode(docs.select("doc_id", "source", "text")), "source", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole of ``documents``, each result written and read again."""
    docs = documents(prepared(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
