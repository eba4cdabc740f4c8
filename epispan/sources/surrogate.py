"""Map the provided order tables to person dates, visits, coded history and drugs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispan.params import CohortParams, PersonColumns, Wave

COLUMNS = PersonColumns(
    id="person_id",
    positive="date_first_positive",
    diagnosis="date_first_diagnosis",
    tested="date_first_tested",
    hospitalized="hospitalized",
    endpoints=(("a", "date_event_a"), ("b", "date_event_b"), ("c", "date_event_c")),
)
WAVES = (
    Wave(None, dt.date(1998, 1, 1)),
    Wave("wave_1998", dt.date(1998, 1, 1), dt.date(1998, 12, 31)),
    Wave("wave_1999", dt.date(1999, 1, 1), dt.date(1999, 12, 31)),
    Wave("wave_2000", dt.date(2000, 1, 1), dt.date(2000, 12, 31)),
)
PARAMS = CohortParams(
    min_age_unit="days", historical_cutoff=dt.date(1997, 12, 31), waves=WAVES
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "orders")
    return frame.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


def person_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the earliest dates of several kinds of order."""
    date, prio, status = F.col("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus")
    late = date >= F.lit(dt.date(1998, 1, 1))
    firsts = {
        "date_first_positive": (prio == "1-URGENT") & (status == "F") & late,
        "date_first_tested": (prio == "1-URGENT") & late,
        "date_first_diagnosis": (prio == "2-HIGH") & (status == "P") & late,
        "date_event_a": (prio == "5-LOW") & (status == "F"),
        "date_event_b": (prio == "5-LOW") & (status == "O"),
        "date_event_c": (prio == "4-NOT SPECIFIED") & (status == "F"),
    }
    per_person = (
        orders(spark, sf_dir)
        .groupBy("o_custkey")
        .agg(
            *[F.min(F.when(cond, date)).alias(name) for name, cond in firsts.items()],
            F.max(F.when((prio == "3-MEDIUM") & (status == "P"), date)).alias("death_date"),
        )
    )
    customer = table(spark, sf_dir, "customer")
    offset = F.pmod(F.col("c_custkey") * 7919, F.lit(7300)).cast("int")
    limit = F.when(F.col("c_nationkey") % 5 == 0, F.lit(dt.date(2001, 3, 31))).otherwise(
        F.lit(dt.date(2001, 8, 1))
    )
    people = customer.select(
        F.col("c_custkey").alias("person_id"),
        F.date_add(F.lit(dt.date(1921, 1, 1)), offset).alias("birth_date"),
        (F.col("c_mktsegment") == "MACHINERY").alias("hospitalized"),
        limit.alias("censoring_global"),
    )
    return people.join(
        per_person.withColumnRenamed("o_custkey", "person_id"), "person_id", "left"
    ).select("person_id", *COLUMNS.date_columns, "hospitalized")


def coded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a dated code: (person_id, pos, code, code_date, drug_code)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in ("", "A", "XD", "XXS")]),
        (F.pmod(F.col("p_partkey"), F.lit(4)) + 1).cast("int"),
    )
    code = F.concat(
        F.substring("p_type", 1, 1),
        F.lpad(F.col("p_size").cast("string"), 2, "0"),
        F.substring("p_brand", 7, 1),
        suffix,
    )
    return (
        lines.join(orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("person_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
            code.alias("code"),
            F.col("o_orderdate").alias("code_date"),
            F.col("l_partkey").alias("drug_code"),
        )
    )


def drug_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drug dictionary with one key in ten missing."""
    part = table(spark, sf_dir, "part")
    return part.where(F.col("p_partkey") % 10 != 0).select(
        F.col("p_partkey").alias("medication_code"),
        F.concat(
            F.substring("p_type", 1, 1),
            F.lpad(F.col("p_size").cast("string"), 2, "0"),
            F.lit("AB"),
            F.substring("p_brand", 7, 2),
        ).alias("atc"),
    )


VISIT_YEARS = tuple(range(1995, 2002))


def wide_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide longitudinal table: one visit per calendar year, columns ``<field>-<visit>.<array>``.

    Field 53 is the visit date (last order of the year), 101 the largest order value (missing in
    years of one order), 102 two readings (smallest and mean value), 103 a small code with
    sentinel -1, and 31 a static attribute.
    """
    price, date = F.col("o_totalprice"), F.col("o_orderdate")
    yearly = (
        orders(spark, sf_dir)
        .groupBy(F.col("o_custkey").alias("eid"), (F.year(date) - VISIT_YEARS[0]).alias("visit"))
        .agg(
            F.max(date).alias("visit_date"),
            F.when(F.count(F.lit(1)) > 1, F.max(price)).alias("f101"),
            F.min(price).alias("f102_0"),
            F.when(F.min(price) < 200000, F.max(price)).alias("f102_1"),
            F.when(F.count(F.lit(1)) == 1, F.lit(-1.0))
            .otherwise(F.count(F.lit(1)).cast("double"))
            .alias("f103"),
        )
    )
    picks = []
    for v in range(len(VISIT_YEARS)):
        for source, target in (
            ("visit_date", f"53-{v}.0"),
            ("f101", f"101-{v}.0"),
            ("f102_0", f"102-{v}.0"),
            ("f102_1", f"102-{v}.1"),
            ("f103", f"103-{v}.0"),
        ):
            picks.append(F.max(F.when(F.col("visit") == v, F.col(source))).alias(target))
    wide = yearly.groupBy("eid").agg(*picks)
    static = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("eid"),
        F.pmod(F.col("c_nationkey"), F.lit(2)).cast("double").alias("31-0.0"),
    )
    return static.join(wide, "eid", "left")


FIELDS = {"31": "sex", "101": "bmi", "102": "pressure", "103": "education"}
PATTERNS = {
    "econ_early": "E[01].*",
    "promo_45": "P[45].*",
    "small_1": "S1.*",
    "any_large": "L.*",
}
