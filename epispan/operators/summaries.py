"""Histograms, metric summaries and covariate comparisons between groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispan.functions import stats
from epispan.functions.codes import metric_endpoint, metric_part
from epispan.operators.ranking import exact_quantiles

# Above this sketched count a column surely holds more than the few values asked about.
SURE_DISTINCT = 100


def histogram(
    frame: DataFrame, feature: Column, exposed: str, bins: int = 50, by: Sequence[str] = ()
) -> DataFrame:
    """Counts per arm over equal-width bins shared by both arms; the last bin is closed.

    ``by`` names a handful of groups, each with its own edges.
    """
    by = list(by)
    rows = frame.select(*by, F.col(exposed).alias("_exposed"), feature.cast("double").alias("_x"))
    rows = rows.where(F.col("_x").isNotNull())
    ends = [F.min("_x").alias("_min"), F.max("_x").alias("_max")]
    flat = F.col("_min") == F.col("_max")
    edges = {
        "_lo": F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")),
        "_hi": F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")),
    }
    number = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    width = (F.col("_hi") - F.col("_lo")) / bins
    if by:
        spans = rows.groupBy(*by).agg(*ends).withColumns(edges).select(*by, "_lo", width.alias("_width"))
        rows = rows.join(F.broadcast(spans), by)
        grid = spans.select(*by, "_lo", "_width", number)
    else:
        # one group has one pair of edges, which become constants
        spans = rows.agg(*ends).withColumns(edges).select("_lo", width.alias("_width"))
        lo, step = spans.first()
        constant = {"_lo": F.lit(lo).cast("double"), "_width": F.lit(step).cast("double")}
        rows = rows.withColumns(constant)
        grid = frame.sparkSession.range(1).select(number).withColumns(constant)
    slot = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_width")), F.lit(bins - 1))
    counts = rows.groupBy(*by, slot.cast("int").alias("bin")).agg(
        F.count_if(F.col("_exposed")).alias("n_exposed"),
        F.count_if(~F.col("_exposed")).alias("n_control"),
    )
    return grid.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_start"),
        F.coalesce("n_exposed", F.lit(0)).alias("n_exposed"),
        F.coalesce("n_control", F.lit(0)).alias("n_control"),
    )


def unpivot_metrics(wide: DataFrame, fold: str, endpoint: str) -> DataFrame:
    """Wide fold metrics ``<metric>_<suffix>`` to long rows without missing values."""
    names = [c for c in wide.columns if c != fold]
    long = wide.unpivot(fold, names, "name", "value").na.drop(subset=["value"])
    return long.select(
        fold,
        metric_part("name").alias("metric"),
        metric_endpoint("name", endpoint).alias("endpoint"),
        "value",
    )


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Five-number summary of each fold metric; folds are few."""
    marks = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    return metrics.groupBy("metric", "endpoint").agg(
        F.count("value").alias("folds"),
        *[F.percentile("value", F.lit(p)).alias(name) for name, p in marks.items()],
    )


def auc_curve_summary(curves: DataFrame, folds: Sequence[int], by: str, t: str, value: str) -> DataFrame:
    """Mean and spread over folds of curves known at different times.

    Gaps are filled linearly by position among all known times, trailing gaps by the last value;
    a time before the first known value of any fold stays null.
    """
    wide = curves.groupBy(by, t).pivot("fold", list(folds)).agg(F.first(value))
    ordered = Window.partitionBy(by).orderBy(t)
    back = ordered.rowsBetween(Window.unboundedPreceding, 0)
    ahead = ordered.rowsBetween(0, Window.unboundedFollowing)
    wide = wide.withColumn("_pos", F.row_number().over(ordered))
    filled = []
    for fold in folds:
        known = F.col(f"`{fold}`")
        at = F.when(known.isNotNull(), F.col("_pos"))
        v0, p0 = F.last(known, True).over(back), F.last(at, True).over(back)
        v1, p1 = F.first(known, True).over(ahead), F.first(at, True).over(ahead)
        between = v0 + (v1 - v0) * (F.col("_pos") - p0) / (p1 - p0)
        filled.append(
            F.when(known.isNotNull(), known)
            .when(v0.isNotNull() & v1.isNotNull(), between)
            .otherwise(v0)
            .alias(f"_f{fold}")
        )
    rows = wide.select(by, t, *filled)
    values = [F.col(f"_f{fold}") for fold in folds]
    k = len(values)
    mean = sum(values[1:], values[0]) / k
    rows = rows.withColumn("mean", mean)
    squares = [(v - F.col("mean")) * (v - F.col("mean")) for v in values]
    return rows.select(
        by, t, "mean", F.sqrt(sum(squares[1:], squares[0]) / (k - 1)).alias("std")
    )


def hte_quantile_groups(
    effects: DataFrame, t: str, hte: str, q: float, ceiling: float | None = 0.5
) -> DataFrame:
    """Label each effect bottom, middle or top by the exact lower and upper quantile of its time.

    Effects above the ceiling count as missing.
    """
    value = F.col(hte) if ceiling is None else F.when(F.col(hte) <= ceiling, F.col(hte))
    rows = effects.withColumn(hte, value)
    cuts = exact_quantiles(rows, hte, [q, 1 - q], [t])
    edges = cuts.groupBy(t).agg(
        F.max(F.when(F.col("prob") == q, F.col("quantile"))).alias("q_lower"),
        F.max(F.when(F.col("prob") == 1 - q, F.col("quantile"))).alias("q_upper"),
    )
    group = (
        F.when(F.col(hte) <= F.col("q_lower"), "bottom")
        .when(F.col(hte) <= F.col("q_upper"), "middle")
        .when(F.col(hte) > F.col("q_upper"), "top")
    )
    return rows.join(F.broadcast(edges), t, "left").withColumn("quantile_group", group)


def feature_kinds(frame: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """'continuous' (numeric, more than five values), 'binary' (two values) or None per column.

    A null counts as a value.  A mergeable sketch settles the columns with many values, since few
    values can never sketch as many; only the others are counted exactly.
    """
    numeric = {
        f.name for f in frame.schema.fields if f.dataType.typeName() in
        ("byte", "short", "integer", "long", "float", "double", "decimal", "boolean")
    }
    first = frame.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if first[c] <= SURE_DISTINCT]
    exact: dict[str, int] = {}
    if few:
        row = frame.agg(
            *[
                (F.size(F.collect_set(c)) + F.max(F.col(c).isNull().cast("int"))).alias(c)
                for c in few
            ]
        ).first()
        exact = {c: row[c] for c in few}
    kinds: dict[str, str | None] = {}
    for c in columns:
        n = exact.get(c, SURE_DISTINCT + 1)
        kinds[c] = "binary" if n == 2 else "continuous" if n > 5 and c in numeric else None
    return kinds


def unpivot_columns(frame: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form (keys, covariate, value) of numeric columns, in one narrow pass."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return frame.select(*keys, F.inline(cells))


def group_moments(long: DataFrame, by: Sequence[str], group: str, labels: Mapping[str, object]) -> DataFrame:
    """Count, mean and variance of two groups side by side."""
    out = []
    for name, label in labels.items():
        value = F.when(F.col(group) == F.lit(label), F.col("value"))
        out += [
            F.count(value).alias(f"n_{name}"),
            F.avg(value).alias(f"mean_{name}"),
            F.var_samp(value).alias(f"var_{name}"),
        ]
    return long.groupBy(*by).agg(*out)


def standardized_differences(frame: DataFrame, exposed: str, columns: Sequence[str]) -> DataFrame:
    """Standardised mean difference of every covariate between the arms."""
    long = unpivot_columns(frame, [exposed], columns)
    moments = group_moments(long, ["covariate"], exposed, {"1": True, "0": False})
    difference = stats.smd(*[F.col(c) for c in ("mean_1", "mean_0", "var_1", "var_0")])
    return moments.select("covariate", "n_1", "n_0", difference.alias("smd"))


def compare_continuous(
    grouped: DataFrame, by: Sequence[str], columns: Sequence[str], group: str = "quantile_group"
) -> DataFrame:
    """Pooled t test of every continuous covariate, bottom against top group."""
    extremes = grouped.where(F.col(group).isin("bottom", "top"))
    long = unpivot_columns(extremes, [*by, group], columns)
    moments = group_moments(long, [*by, "covariate"], group, {"bottom": "bottom", "top": "top"})
    parts = [F.col(f"{c}_{g}") for g in ("bottom", "top") for c in ("n", "mean", "var")]
    out = moments.withColumn("t", stats.pooled_t(*parts)).withColumn(
        "df", F.col("n_bottom") + F.col("n_top") - 2
    )
    out = out.withColumn("p", stats.t_p_value(F.col("t"), F.col("df").cast("double")))
    return out.withColumn("stars", stats.significance_stars(F.col("p")))


def compare_binary(
    grouped: DataFrame, by: Sequence[str], columns: Sequence[str], group: str = "quantile_group"
) -> DataFrame:
    """Rate in percent and chi-square of every binary covariate, bottom against top group."""
    extremes = grouped.where(F.col(group).isin("bottom", "top"))
    long = unpivot_columns(extremes, [*by, group], columns)
    sums = []
    for label in ("bottom", "top"):
        value = F.when(F.col(group) == label, F.col("value"))
        sums += [F.sum(value).alias(f"yes_{label}"), F.count(value).alias(f"n_{label}")]
    out = long.groupBy(*by, "covariate").agg(*sums)
    yes = [F.coalesce(F.col(f"yes_{g}"), F.lit(0.0)) for g in ("bottom", "top")]
    no = [F.col(f"n_{g}") - y for g, y in zip(("bottom", "top"), yes)]
    out = out.withColumns(
        {
            "rate_bottom": 100 * F.col("yes_bottom") / F.col("n_bottom"),
            "rate_top": 100 * F.col("yes_top") / F.col("n_top"),
            "chi2": stats.chi2_2x2(yes[0], yes[1], no[0], no[1]),
        }
    )
    out = out.withColumn("p", stats.chi2_p_value(F.col("chi2")))
    return out.withColumn("stars", stats.significance_stars(F.col("p")))


def group_distribution(
    grouped: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
) -> DataFrame:
    """Count, maximum and exact quantiles of every covariate per group."""
    keys = [*by, "covariate"]
    long = unpivot_columns(grouped, by, columns).where(F.col("value").isNotNull())
    sizes = long.groupBy(*keys).agg(F.count("value").alias("n"), F.max("value").alias("largest"))
    cuts = exact_quantiles(long, "value", probs, keys)
    marks = [
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"q{round(100 * p)}")
        for p in probs
    ]
    return sizes.join(cuts.groupBy(*keys).agg(*marks), keys)
