"""Baseline covariates at the index date: as-of values, look-back counts, code flags and arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispan.functions.codes import UNKNOWN_CODE, format_icd, matches_pattern, missing_if
from epispan.operators.joins import broadcast_if_small, require_rows

HISTORY_YEARS = 5
DAYS_PER_HISTORY_YEAR = 365
ARRAY_CHUNK = 10_000
MAX_CATEGORIES = 1_000
VISIT_SPAN = 10_000


def attach_main(cohort: DataFrame, main: DataFrame, id_col: str, main_id: str) -> DataFrame:
    """Left join of the cohort with the main table; raises when the cohort is empty."""
    require_rows(cohort, "the cohort holds no persons to look up in the main table")
    return cohort.join(main.withColumnRenamed(main_id, id_col), id_col, "left")


def keep_cohort_persons(facts: DataFrame, cohort: DataFrame, id_col: str) -> DataFrame:
    return facts.join(cohort.select(id_col), id_col, "left_semi")


def attach_features(cohort: DataFrame, features: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left join of one-row-per-key feature tables; counts and flags missing there stay null."""
    for frame in features:
        cohort = cohort.join(frame, list(keys), "left")
    return cohort


def set_to_missing(frame: DataFrame, columns: Sequence[str], values: Sequence[float]) -> DataFrame:
    return frame.withColumns({c: missing_if(f"`{c}`", values) for c in columns})


def carry_forward(
    long: DataFrame, keys: Sequence[str], order: str, value: str, span: int = VISIT_SPAN
) -> DataFrame:
    """Replace nulls by the latest earlier value of the same key, ordered by visit number.

    Visits are cut into spans; a span starts from the last value of the spans before it, so the
    visits of one key need not meet in one task.
    """
    keys = list(keys)
    spans = long.withColumn("_span", F.floor(F.col(order) / span))
    place = F.when(F.col(value).isNotNull(), F.col(order))
    ends = spans.groupBy(*keys, "_span").agg(F.max_by(value, place).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "_span", F.last("_end", ignorenulls=True).over(earlier).alias("_start"))
    upto = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(value, ignorenulls=True).over(upto)
    joined = spans.withColumn(value, inside).join(starts, [*keys, "_span"])
    return joined.withColumn(value, F.coalesce(value, "_start")).drop("_span", "_start")


def asof_latest_visit(
    long: DataFrame,
    cohort: DataFrame,
    keys: Sequence[str],
    id_col: str,
    index: str = "index_date",
) -> DataFrame:
    """As-of join on long measurements: latest non-null value per key, field and array at the index.

    Same-day repeats collapse before the join, which bounds the rows of any one person by the days
    on record.
    """
    daily = (
        long.where(F.col("value").isNotNull() & F.col("visit_date").isNotNull())
        .groupBy(id_col, "field", "arr", "visit_date")
        .agg(F.max_by("value", "visit").alias("value"))
    )
    return (
        cohort.select(*keys, index)
        .join(daily, id_col)
        .where(F.col("visit_date") <= F.col(index))
        .groupBy(*keys, "field", "arr")
        .agg(F.max_by("value", "visit_date").alias("value"))
    )


def in_lookback(date: str, index: str, years: int = HISTORY_YEARS) -> Column:
    """Date inside ``(index - 365 * years, index]``."""
    start = F.date_sub(F.col(index), years * DAYS_PER_HISTORY_YEAR)
    return (F.col(date) > start) & (F.col(date) <= F.col(index))


def code_features(
    codes: DataFrame,
    cohort: DataFrame,
    keys: Sequence[str],
    id_col: str,
    patterns: Mapping[str, str],
    count_name: str = "num_diagnoses",
    index: str = "index_date",
    years: int = HISTORY_YEARS,
    code: str = "code",
    date: str = "code_date",
    days_since_last: bool = False,
) -> DataFrame:
    """Count in the look-back window, ever-before flags per pattern, and days since the last code.

    Codes are reduced to one row per person and day, and the two edges of every distinct (person,
    index date) are put among them. Running sums along a person's days, read at both edges, give the
    features: no code meets an experiment, and a person's rows are bounded by days, however many
    codes and experiments there are. Keys of persons without any code have no row; codes without a
    date only give their person a row.
    """
    flags = {name: matches_pattern(code, pattern) for name, pattern in patterns.items()}
    day = F.col(date).alias("_day")
    daily = codes.groupBy(id_col, day).agg(
        F.count(code).alias("_n"),
        *[F.coalesce(F.bool_or(flag), F.lit(False)).alias(name) for name, flag in flags.items()],
    )
    daily = daily.withColumns({name: F.col(name) & F.col("_day").isNotNull() for name in flags})
    daily = daily.withColumns({"_edge": F.lit(0)})
    wanted = F.collect_list(F.struct(*keys)).alias("_keys")
    dates = cohort.where(F.col(id_col).isNotNull()).repartition(F.col(id_col))
    dates = dates.groupBy(id_col, F.col(index).cast("date").alias("_index")).agg(wanted)
    start = F.date_sub("_index", years * DAYS_PER_HISTORY_YEAR)
    # on a shared day the codes come first: a window is open at its start and closed at its end
    low = F.struct(F.lit(1).alias("_edge"), start.alias("_day"), F.lit(None).alias("_keys"))
    high = F.struct(F.lit(2).alias("_edge"), F.col("_index").alias("_day"), F.col("_keys"))
    edges = dates.select(id_col, "_index", F.inline(F.array(low, high)))
    line = Window.partitionBy(id_col).orderBy("_day", "_edge")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_code = F.col("_edge") == 0
    running = {
        "_upto": F.coalesce(F.sum("_n").over(so_far), F.lit(0)),
        "_last": F.max(F.when(is_code, F.col("_day"))).over(so_far),
        "_coded": F.max(is_code).over(Window.partitionBy(id_col)),
        **{name: F.coalesce(F.max(name).over(so_far), F.lit(False)) for name in flags},
    }
    points = daily.unionByName(edges, allowMissingColumns=True).withColumns(running)
    at_end = F.col("_edge") == 2
    read = points.where(~is_code & F.col("_coded")).groupBy(id_col, "_index").agg(
        F.sum(F.when(at_end, F.col("_upto")).otherwise(-F.col("_upto"))).alias(count_name),
        F.first("_keys", ignorenulls=True).alias("_keys"),
        F.max(F.when(at_end, F.col("_last"))).alias("_last"),
        *[F.bool_or(at_end & F.col(name)).alias(name) for name in flags],
    )
    found = [count_name, *flags]
    if days_since_last:
        read = read.withColumn("days_since_last", F.datediff("_index", "_last"))
        found.append("days_since_last")
    return read.select(F.explode("_keys").alias("_key"), *found).select("_key.*", *found)


def complete_features(
    cohort: DataFrame, features: DataFrame, keys: Sequence[str], zero: Sequence[str], false: Sequence[str]
) -> DataFrame:
    """Left join with zero counts and false flags for keys without any code."""
    joined = attach_features(cohort, [features], keys)
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in zero}
    filled |= {c: F.coalesce(F.col(c), F.lit(False)) for c in false}
    return joined.withColumns(filled)


def map_codes(
    codes: DataFrame, mapping: DataFrame, code: str, key: str, label: str, length: int = 5
) -> DataFrame:
    """Translate codes by dictionary, shorten the label, and mark unknown codes."""
    unique = mapping.groupBy(F.col(key).alias(code)).agg(F.max(label).alias("_label"))
    joined = codes.join(broadcast_if_small(unique), code, "left")
    known = F.coalesce(F.substring("_label", 1, length), F.lit(UNKNOWN_CODE))
    return joined.withColumn(label, known).drop("_label")


def collect_code_arrays(
    codes: DataFrame,
    cohort: DataFrame,
    keys: Sequence[str],
    id_col: str,
    code: Column,
    codes_name: str,
    dates_name: str,
    index: str = "index_date",
    years: int = HISTORY_YEARS,
    position: str = "pos",
    date: str = "code_date",
    chunk_size: int = ARRAY_CHUNK,
) -> DataFrame:
    """Position-ordered code and ``yyyyMMdd`` date arrays of the look-back window, one row per key.

    Entries are sorted in chunks of ``chunk_size`` neighbouring positions, so that the codes of
    one person are ordered by several tasks; the chunks of a key are then put together in order.
    The chunk size has no influence on the result.
    """
    joined = cohort.select(*keys, index).join(codes, id_col).where(in_lookback(date, index, years))
    entry = F.struct(
        F.col(position).alias("pos"), code.alias("code"), F.date_format(date, "yyyyMMdd").alias("day")
    )
    chunk = F.floor(F.col(position) / chunk_size).alias("_chunk")
    chunks = joined.groupBy(*keys, chunk).agg(F.array_sort(F.collect_list(entry)).alias("_part"))
    parts = F.array_sort(F.collect_list(F.struct("_chunk", "_part")))
    arrays = chunks.groupBy(*keys).agg(parts.alias("_parts"))
    arrays = arrays.withColumn("_all", F.flatten("_parts._part"))
    return arrays.select(
        *keys, F.col("_all.code").alias(codes_name), F.col("_all.day").alias(dates_name)
    )


def categories(
    frame: DataFrame, columns: Sequence[str], most: int = MAX_CATEGORIES
) -> dict[str, list[str]]:
    """Sorted distinct non-null values of categorical columns.

    The number of values is estimated first: a column with more than about ``most`` of them, such
    as an id, raises before its values are gathered.
    """
    sizes = frame.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in columns]).first()
    wide = [c for c in columns if sizes[c] > 1.2 * most]
    if wide:
        raise ValueError(f"more than {most} categories in {', '.join(wide)}")
    row = frame.agg(
        *[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns]
    ).first()
    return {c: list(row[c]) for c in columns}


def one_hot(frame: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column ``<column>_<value>`` per category; a null category gives zeros."""
    indicators = {
        f"{column}_{value}": F.coalesce((F.col(column).cast("string") == value).cast("int"), F.lit(0))
        for column, values in levels.items()
        for value in values
    }
    return frame.withColumns(indicators).drop(*levels)


def pack_features(frame: DataFrame, columns: Sequence[str], out: str = "additional_features") -> DataFrame:
    return frame.withColumn(out, F.struct(*[F.col(c) for c in columns])).drop(*columns)


def first_tests(tests: DataFrame, id_col: str, date: str, positive: Column) -> DataFrame:
    """First test and first positive test per person in one aggregation."""
    return tests.groupBy(id_col).agg(
        F.min(date).alias("date_first_tested"),
        F.min(F.when(positive, F.col(date))).alias("date_first_tested_positive"),
    )


def first_date_of_code(
    codes: DataFrame,
    id_col: str,
    prefix: str,
    out: str,
    code: str = "code",
    date: str = "code_date",
    position: str | None = None,
) -> DataFrame:
    """Earliest date of a code prefix, or the date at its first position when one is given."""
    hits = codes.where(F.col(code).startswith(prefix))
    picked = F.min(date) if position is None else F.min_by(date, F.struct(position, date))
    return hits.groupBy(id_col).agg(picked.alias(out))


def eligibility_filter(
    positive: str,
    diagnosis: str,
    birth: str,
    pool_date: str,
    pool_age: float = 65.0,
    exposed_age: float = 70.0,
    earliest_exposure: str | None = None,
) -> Column:
    """Never exposed and old enough at a fixed date, or exposed and old enough at exposure.

    Exposures dated before ``earliest_exposure`` are left out.
    """
    first = F.least(positive, diagnosis)
    in_pool = first.isNull() & (
        F.datediff(F.lit(pool_date).cast("date"), birth) / 365 >= F.lit(pool_age)
    )
    is_exposed = first.isNotNull() & (F.datediff(first, birth) / 365 >= F.lit(exposed_age))
    if earliest_exposure is not None:
        is_exposed = is_exposed & (first >= F.lit(earliest_exposure).cast("date"))
    return in_pool | is_exposed


def build_person_dates(
    main: DataFrame,
    tests: DataFrame,
    codes: DataFrame,
    *,
    id_col: str,
    birth_year: str,
    exposure_prefix: str,
    test_date: str,
    positive: Column,
    region: Column,
    diagnosis_name: str = "date_first_diagnosis",
) -> DataFrame:
    """Assemble the person-date table from the main table, test results and coded history."""
    first_code = first_date_of_code(codes, id_col, exposure_prefix, diagnosis_name)
    return (
        main.withColumn("birth_date", F.make_date(F.col(birth_year), F.lit(1), F.lit(1)))
        .withColumn("censoring_global", region)
        .join(first_tests(tests, id_col, test_date, positive), id_col, "left")
        .join(first_code, id_col, "left")
    )
