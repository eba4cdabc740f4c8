"""Readers with explicit schemas for person dates, cohorts, wide tables, test results and dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispan.operators.wide import quoted
from epispan.params import PersonColumns


def person_dates_schema(cols: PersonColumns) -> T.StructType:
    fields = [T.StructField(cols.id, T.LongType())]
    fields += [T.StructField(c, T.DateType()) for c in cols.date_columns]
    return T.StructType([*fields, T.StructField(cols.hospitalized, T.BooleanType())])


def cohort_schema(cols: PersonColumns) -> T.StructType:
    return T.StructType(
        [
            T.StructField(cols.id, T.LongType()),
            T.StructField("exposed", T.BooleanType()),
            T.StructField("index_date", T.DateType()),
            T.StructField("age_at_index", T.DoubleType()),
            T.StructField("event_time", T.IntegerType()),
            T.StructField("event_indicator", T.IntegerType()),
        ]
    )


def strict(name: str, kind: T.DataType | str, path: str, formats: Sequence[str] = ()) -> Column:
    """Text as a value of ``kind``: blank text is null, text that does not parse raises with file, column and text.

    ``formats`` are tried in order for dates; without them the value is cast.
    """
    text = F.trim(quoted(name))
    text = F.when(text != "", text)
    parsed = F.coalesce(*[F.try_to_date(text, f) for f in formats]) if formats else text.try_cast(kind)
    complaint = F.raise_error(F.concat(F.lit(f"{path}: column {name}: bad value "), text)).cast(kind)
    return F.when(text.isNotNull() & parsed.isNull(), complaint).otherwise(parsed)


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """CSV with a header; columns are matched by name, so their order in the file does not matter."""
    head = spark.read.csv(path, header=True, inferSchema=False, **options)
    missing = sorted({f.name for f in schema.fields} - set(head.columns))
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return head.select(*[strict(f.name, f.dataType, path).alias(f.name) for f in schema.fields])


def read_person_dates(
    spark: SparkSession, path: str, cols: PersonColumns = PersonColumns()
) -> DataFrame:
    """Person dates from CSV, or from Parquet when the path ends in ``.parquet``."""
    schema = person_dates_schema(cols)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return _read_csv(spark, path, schema)


def read_dated_cohort(
    spark: SparkSession, path: str, cols: PersonColumns = PersonColumns()
) -> DataFrame:
    return _read_csv(spark, path, cohort_schema(cols))


def read_design_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A written design matrix; a path that does not exist raises."""
    return spark.read.parquet(path)


def read_wide_main(
    spark: SparkSession, path: str, id_col: str, date_field: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Wide CSV: dates for the visit-date field, a number for everything else."""
    head = spark.read.csv(path, header=True, inferSchema=False)
    names = [c for c in head.columns if columns is None or c in columns or c == id_col]

    def typed(name: str) -> Column:
        if name == id_col:
            return strict(name, "bigint", path)
        return strict(name, "date" if name.startswith(f"{date_field}-") else "double", path)

    return head.select(*[typed(c).alias(c) for c in names])


def read_code_families(
    spark: SparkSession, path: str, id_col: str, date_prefixes: Sequence[str]
) -> DataFrame:
    """Wide CSV of codes as text, with the columns of the given prefixes as dates."""
    head = spark.read.csv(path, header=True, inferSchema=False)

    def typed(name: str) -> Column:
        if name == id_col:
            return strict(name, "bigint", path)
        is_date = any(name.startswith(prefix) for prefix in date_prefixes)
        return strict(name, "date", path) if is_date else quoted(name)

    return head.select(*[typed(c).alias(c) for c in head.columns])


def read_glob_tsv(
    spark: SparkSession,
    pattern: str,
    id_col: str = "eid",
    date: str = "specdate",
    result: str = "result",
    formats: Sequence[str] = ("dd/MM/yyyy", "yyyy-MM-dd"),
) -> DataFrame:
    """Test results from all matching tab-separated files.

    Dates may be in any of ``formats``; the first that parses holds, so a date of another format raises.
    """
    raw = spark.read.csv(pattern, sep="\t", header=True, inferSchema=False)
    return raw.select(
        strict(id_col, "bigint", pattern).alias(id_col),
        strict(date, "date", pattern, formats).alias(date),
        strict(result, "int", pattern).alias(result),
    )


def read_code_map(
    spark: SparkSession, path: str, key: str = "medication_code", label: str = "atc", key_type: str = "string"
) -> DataFrame:
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(F.col(key).cast(key_type).alias(key), label)
