"""Column expressions on clinical codes and small recodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_CODE = "UNK"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def format_icd(code: str | Column) -> Column:
    """Dot after the third character, then drop encounter letters A, D, S and filler X."""
    code = _col(code)
    dotted = F.when(
        F.length(code) > 3, F.concat(F.substring(code, 1, 3), F.lit("."), F.substring(code, 4, 1000))
    ).otherwise(code)
    for letter in "ADS":
        dotted = F.rtrim(dotted, F.lit(letter))
    return F.trim(dotted, F.lit("X"))


def matches_pattern(code: str | Column, pattern: str) -> Column:
    """Pattern anchored at the start of the code."""
    return _col(code).rlike(f"^(?:{pattern.removeprefix('^')})")


def missing_if(column: str | Column, values: Sequence[float]) -> Column:
    """Replace sentinel values by null."""
    column = _col(column)
    return F.when(~column.isin(list(values)), column)


def row_min(columns: Sequence[str | Column]) -> Column:
    """Smallest non-null value of several columns."""
    return F.array_min(F.array(*[_col(c) for c in columns]))


def mean_of_repeats(columns: Sequence[str | Column]) -> Column:
    """Mean of repeated readings; null as soon as one reading is missing."""
    total = _col(columns[0])
    for column in columns[1:]:
        total = total + _col(column)
    return total / len(columns)


def prefer(first: Column, second: Column) -> Column:
    return F.coalesce(first, second)


def recode(column: str | Column, mapping: Mapping) -> Column:
    """Look a value up in a small fixed mapping; other values become null."""
    column = _col(column)
    picked = F.lit(None).cast("string")
    for key, label in mapping.items():
        picked = F.when(column == key, F.lit(label)).otherwise(picked)
    return picked


def sex_label(column: str | Column, female_coded_as_one: bool) -> Column:
    labels = {1: "Female", 0: "Male"} if female_coded_as_one else {0: "Female", 1: "Male"}
    return recode(column, labels)


def endpoint_label(indicator: str | Column, endpoint: str) -> Column:
    return recode(indicator, {0: "", 1: endpoint, 2: "death"})


def metric_part(name: str | Column) -> Column:
    """Metric name without its endpoint suffix."""
    return F.regexp_extract(_col(name), r"^(.*)_([^_]*)$", 1)


def metric_endpoint(name: str | Column, endpoint: str) -> Column:
    """Endpoint label of a metric name's suffix."""
    suffix = F.regexp_extract(_col(name), r"^(.*)_([^_]*)$", 2)
    return recode(
        suffix, {"0": "censoring", "1": endpoint, "2": "death", "all": "overall survival"}
    )
