"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispan.llm import ann, bpe, language, lattice, lines, lm, mixing, neardup, pii, quality, repair, tokenfile, whitening
from epispan.llm.common import documents, prepared
from epispan.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return fn

    return register


@query("op1_line_dedup", lines.ORACLE)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("source_row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(documents(spark, sf_dir)))


@query("op3_quality", quality.ORACLE)
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_quality(documents(spark, sf_dir))


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query("op5_lm_scores")
def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(tokenfile.round_trip(documents(spark, sf_dir)))


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(documents(spark, sf_dir).select("doc_id", "text")))


@query("op8_mixing", mixing.ORACLE)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", mixing.word_count().alias("size"))
    mixed = mixing.mix(cut(sized, "mix-sized"), size=F.col("size"))
    taken = (F.col("size") * F.size("shards")).alias("taken")
    return mixed.select("source_row.doc_id", "size", "source_size", "target", taken)


@query("op9_near_duplicates", neardup.ORACLE)
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(documents(spark, sf_dir))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op10_nearest_vectors")
def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_near_vectors", lattice.ORACLE)
def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@query("op13_repair")
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
