"""Queries on time grids, curves, sampling, summaries and effect heterogeneity."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispan.functions import stats
from epispan.functions.dates import earliest
from epispan.operators import curves as K
from epispan.operators import ranking as R
from epispan.operators import sampling as P
from epispan.operators import summaries as M
from epispan.registry.base import query
from epispan.registry.sql import PERSONS, SEED, hashed
from epispan.sources import surrogate as S

START = "1995-01-01"


def followup(spark, sf):
    """Every customer followed from a fixed day: exposure, event time and indicator, covariates."""
    persons = S.person_dates(spark, sf)
    event = earliest(["date_event_a", "date_event_b", "date_event_c"])
    last = F.least("censoring_global", event, "death_date")
    indicator = (
        F.when(F.col("censoring_global") == last, 0).when(event == last, 1).otherwise(2)
    )
    start = F.lit(START).cast("date")
    rows = persons.select(
        "person_id",
        F.col("date_first_tested").isNotNull().alias("exposed"),
        F.datediff(last, start).alias("event_time"),
        indicator.alias("event_indicator"),
        F.datediff(start, "birth_date").alias("age"),
        "hospitalized",
    )
    main = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"), "c_acctbal", "c_nationkey", "c_mktsegment"
    )
    return rows.join(main, "person_id")


FOLLOWUP = f"""{PERSONS},
outc AS (
  SELECT *, least(date_event_a, date_event_b, date_event_c) AS event_date FROM persons),
followup AS (
  SELECT person_id, date_first_tested IS NOT NULL AS exposed,
    CAST(date_diff('day', DATE '{START}', least(censoring_global, event_date, death_date)) AS INTEGER) AS event_time,
    CASE WHEN censoring_global = least(censoring_global, event_date, death_date) THEN 0
         WHEN event_date = least(censoring_global, event_date, death_date) THEN 1 ELSE 2 END AS event_indicator,
    CAST(date_diff('day', birth_date, DATE '{START}') AS INTEGER) AS age, hospitalized, c_acctbal, c_nationkey, c_mktsegment
  FROM outc JOIN customer ON c_custkey = person_id)
"""


@query("followup", "P14 P15", f"""WITH {FOLLOWUP} SELECT person_id, exposed, event_time,
    event_indicator, c_acctbal FROM followup WHERE event_time > 30""")
def _followup(spark, sf):
    rows = followup(spark, sf).filter(F.expr("event_time > 30"))
    drop = [c for c in ("age", "hospitalized", "c_nationkey", "c_mktsegment", "absent") if c in rows.columns]
    return rows.drop(*drop)


def _hist_sql(source: str, value: str, by: str) -> str:
    comma = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""x AS (SELECT {comma}exposed, CAST({value} AS DOUBLE) AS x FROM {source}),
    e AS (SELECT *, min(x) OVER ({part}) AS lo, max(x) OVER ({part}) AS hi FROM x),
    w AS (SELECT *, (hi - lo) / 50 AS width FROM e),
    c AS (SELECT {comma}lo, width, least(floor((x - lo) / width), 49) AS bin,
        count(*) FILTER (WHERE exposed) AS n1, count(*) FILTER (WHERE NOT exposed) AS n0 FROM w GROUP BY ALL),
    g AS (SELECT DISTINCT {comma}lo, width, unnest(range(50)) AS bin FROM w)
    SELECT {"g." + by + ", " if by else ""}CAST(g.bin AS INTEGER) AS bin, round(g.lo + g.bin * g.width, 6) AS bin_start,
      coalesce(n1, 0) AS n_exposed, coalesce(n0, 0) AS n_control
    FROM g LEFT JOIN c ON c.bin = g.bin {f"AND c.{by} = g.{by}" if by else ""}"""


@query("histogram_age", "A9", f"WITH {FOLLOWUP}, {_hist_sql('followup', 'age / 365.25', '')}")
def _hist_age(spark, sf):
    out = M.histogram(followup(spark, sf), F.col("age") / 365.25, "exposed")
    return out.withColumn("bin_start", F.round("bin_start", 6))


@query(
    "histogram_event_time",
    "A9",
    f"WITH {FOLLOWUP}, {_hist_sql('followup', 'event_time', 'event_indicator')}",
)
def _hist_time(spark, sf):
    out = M.histogram(followup(spark, sf), F.col("event_time"), "exposed", by=["event_indicator"])
    return out.withColumn("bin_start", F.round("bin_start", 6))


def _grid_sql(k: int) -> str:
    return f"""ordered AS (SELECT event_time AS t, row_number() OVER (ORDER BY event_time) - 1 AS r, count(*) OVER () AS n FROM followup),
    picks AS (SELECT unnest(range({k})) AS j),
    grid AS (SELECT DISTINCT t FROM ordered JOIN picks ON r = floor(j * (n - 1) / {float(k - 1)}))"""


@query(
    "time_grid",
    "A10",
    f"""WITH {FOLLOWUP}, {_grid_sql(100)}
    SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS t_idx, t FROM grid""",
)
def _grid(spark, sf):
    return K.time_grid(followup(spark, sf), "event_time", 100)


@query(
    "snap_to_grid",
    "J14 A11",
    f"""WITH {FOLLOWUP}, {_grid_sql(22)} SELECT person_id, event_time, max(t) AS snapped
    FROM followup JOIN grid ON t <= event_time GROUP BY ALL""",
)
def _snap(spark, sf):
    rows = followup(spark, sf)
    grid = K.grid_values(rows, "event_time", 22)
    return rows.select("person_id", "event_time", K.snap_to_grid("event_time", grid).alias("snapped"))


@query(
    "reachable_times",
    "A12",
    f"""WITH {FOLLOWUP} SELECT t, count(*) AS still_followed FROM followup
    JOIN (SELECT unnest([500, 1000, 1500, 2000, 2500, 9000]) AS t) ON event_time >= t
    WHERE t <= (SELECT max(event_time) FROM followup) GROUP BY t""",
)
def _reachable(spark, sf):
    rows = followup(spark, sf)
    times = K.reachable_times(rows, "event_time", [500, 1000, 1500, 2000, 2500, 9000])
    reached = F.filter(F.array(*[F.lit(t) for t in times]), lambda t: t <= F.col("event_time"))
    return (
        rows.select(F.explode(reached).alias("t"))
        .groupBy("t")
        .agg(F.count(F.lit(1)).alias("still_followed"))
    )


AJ = f"""{FOLLOWUP},
daily AS (
  SELECT exposed, event_time AS t, count(*) AS leaving, count(*) FILTER (WHERE event_indicator > 0) AS d,
    count(*) FILTER (WHERE event_indicator = 1) AS d1, count(*) FILTER (WHERE event_indicator = 2) AS d2
  FROM followup GROUP BY ALL),
risk AS (
  SELECT *, CAST(sum(leaving) OVER (PARTITION BY exposed ORDER BY t DESC) AS BIGINT) AS n FROM daily),
km AS (
  SELECT *, product(1 - d / n) OVER (PARTITION BY exposed ORDER BY t) AS surv,
    product(1 - CASE WHEN n > d THEN (leaving - d) / (n - d) ELSE 0 END) OVER (PARTITION BY exposed ORDER BY t) AS cens_surv
  FROM risk),
lagged AS (SELECT *, coalesce(lag(surv) OVER (PARTITION BY exposed ORDER BY t), 1.0) AS s0 FROM km),
aj AS (SELECT *, sum(s0 * d1 / n) OVER (PARTITION BY exposed ORDER BY t) AS cif,
    sum(s0 * d2 / n) OVER (PARTITION BY exposed ORDER BY t) AS cif2 FROM lagged)
"""


@query(
    "kaplan_meier",
    "A17 M10",
    f"""WITH {AJ} SELECT exposed, t, n AS n_risk, d AS n_events, round(surv, 8) AS surv,
    round(cens_surv, 8) AS cens_surv FROM aj""",
)
def _km(spark, sf):
    out = K.kaplan_meier(followup(spark, sf), "event_time", "event_indicator", ["exposed"])
    return out.withColumns({c: F.round(c, 8) for c in ("surv", "cens_surv")}).drop("n_censored")


@query(
    "aalen_johansen",
    "A17",
    f"""WITH {AJ} SELECT a.exposed, a.t, a.n AS n_risk, a.d AS n_events, a.d1 AS n_events_1,
      round(a.surv, 8) AS surv, round(a.cif, 8) AS cif,
      round(sum(CASE WHEN s.n > s.d THEN (a.cif - s.cif) ** 2 * s.d / (s.n * (s.n - s.d)) ELSE 0 END
        + s.s0 ** 2 * s.d1 * (s.n - s.d1) / CAST(s.n AS DOUBLE) ** 3
        - 2 * (a.cif - s.cif) * s.s0 * s.d1 / CAST(s.n AS DOUBLE) ** 2), 8) AS variance
    FROM aj a JOIN aj s ON s.exposed = a.exposed AND s.t <= a.t GROUP BY ALL""",
)
def _aj(spark, sf):
    out = K.aalen_johansen(followup(spark, sf), "event_time", "event_indicator", ["exposed"])
    return out.withColumns({c: F.round(c, 8) for c in ("surv", "cif", "variance")})


def nation_curves(spark, sf):
    """Competing-risk curves per nation and arm on the days with an event."""
    rows = followup(spark, sf).withColumn("arm", F.col("hospitalized").cast("int"))
    return K.aalen_johansen(rows, "event_time", "event_indicator", ["c_nationkey", "arm"])


NATION = f"""{FOLLOWUP},
daily AS (
  SELECT c_nationkey, CAST(hospitalized AS INTEGER) AS arm, event_time AS t, count(*) AS leaving,
    count(*) FILTER (WHERE event_indicator > 0) AS d, count(*) FILTER (WHERE event_indicator = 1) AS d1
  FROM followup GROUP BY ALL),
risk AS (SELECT *, CAST(sum(leaving) OVER (PARTITION BY c_nationkey, arm ORDER BY t DESC) AS BIGINT) AS n FROM daily),
km AS (SELECT *, product(1 - d / n) OVER w AS surv FROM risk WINDOW w AS (PARTITION BY c_nationkey, arm ORDER BY t)),
lagged AS (SELECT *, coalesce(lag(surv) OVER (PARTITION BY c_nationkey, arm ORDER BY t), 1.0) AS s0 FROM km),
aj AS (SELECT *, sum(s0 * d1 / n) OVER (PARTITION BY c_nationkey, arm ORDER BY t) AS cif FROM lagged)
"""
KEYS = ["c_nationkey", "arm"]


@query(
    "running_monotone",
    "W2",
    f"""WITH {FOLLOWUP}, rates AS (
      SELECT c_nationkey, event_time AS t, count(*) FILTER (WHERE event_indicator = 1) / count(*) AS rate FROM followup GROUP BY ALL)
    SELECT c_nationkey, t, max(rate) OVER w AS up, min(rate) OVER w AS down
    FROM rates WINDOW w AS (PARTITION BY c_nationkey ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _monotone(spark, sf):
    hit = F.count_if(F.col("event_indicator") == 1) / F.count(F.lit(1))
    rates = (
        followup(spark, sf)
        .groupBy("c_nationkey", F.col("event_time").alias("t"))
        .agg(hit.alias("up"))
        .withColumn("down", F.col("up"))
    )
    rates = K.running_monotone(rates, ["c_nationkey"], "up", True)
    return K.running_monotone(rates, ["c_nationkey"], "down", False)


@query(
    "lag_survival",
    "W3",
    f"WITH {NATION} SELECT c_nationkey, arm, t, round(s0, 8) AS surv_before FROM aj",
)
def _lag(spark, sf):
    out = K.lag_survival(nation_curves(spark, sf), KEYS)
    return out.select(*KEYS, "t", F.round("surv_before", 8).alias("surv_before"))


@query(
    "hazard_from_cif",
    "W4 W5",
    f"""WITH {NATION} SELECT c_nationkey, arm, t, round(d1 / n, 8) AS hazard,
    round(cif, 8) AS cif_again FROM aj""",
)
def _hazard(spark, sf):
    curves = K.hazard_from_cif(nation_curves(spark, sf), KEYS)
    out = K.cif_from_hazard(curves, KEYS)
    return out.select(*KEYS, "t", F.round("hazard", 8).alias("hazard"), F.round("cif_again", 8).alias("cif_again"))


TARGETS = (400, 800, 1200)


def nation_effects(spark, sf):
    """Cumulative incidence at the target days and its difference between the arms, per nation."""
    rows = followup(spark, sf).withColumn("arm", F.col("hospitalized").cast("int"))
    hits = F.array(*[F.lit(t) for t in TARGETS])
    by_day = rows.select(*KEYS, "event_time", "event_indicator", F.explode(hits).alias("t"))
    hit = (F.col("event_indicator") == 1) & (F.col("event_time") <= F.col("t"))
    share = by_day.groupBy(*KEYS, "t").agg((F.count_if(hit) / F.count(F.lit(1))).alias("cif"))
    return K.effect_by_time(share, "c_nationkey")


@query(
    "effect_by_time",
    "W6 W12",
    f"""WITH {FOLLOWUP} SELECT c_nationkey, t, round(
      count(*) FILTER (WHERE hospitalized AND event_indicator = 1 AND event_time <= t) / count(*) FILTER (WHERE hospitalized)
      - count(*) FILTER (WHERE NOT hospitalized AND event_indicator = 1 AND event_time <= t) / count(*) FILTER (WHERE NOT hospitalized), 8) AS hte
    FROM followup, (SELECT unnest([400, 1200]) AS t) GROUP BY ALL
    HAVING count(*) FILTER (WHERE hospitalized) > 0 AND count(*) FILTER (WHERE NOT hospitalized) > 0""",
)
def _effect(spark, sf):
    out = K.at_target_times(nation_effects(spark, sf), [400, 1200])
    return out.where(F.col("hte").isNotNull()).withColumn("hte", F.round("hte", 8))


@query(
    "counterfactual",
    "P30",
    f"""WITH {FOLLOWUP} SELECT person_id, arm AS exposed, c_acctbal FROM followup, (SELECT unnest([true, false]) AS arm)""",
)
def _counter(spark, sf):
    return K.counterfactual(followup(spark, sf).select("person_id", "exposed", "c_acctbal"))


@query(
    "n_causes",
    "A28",
    f"WITH {FOLLOWUP} SELECT count(DISTINCT event_indicator) - 1 AS n_causes FROM followup",
)
def _causes(spark, sf):
    n = F.count_distinct("event_indicator") - 1
    return followup(spark, sf).agg(n.alias("n_causes"))


FOLD = f"""CAST((row_number() OVER (PARTITION BY event_indicator ORDER BY {hashed("'fold'", "person_id")}, person_id) - 1) % 5 AS INTEGER)"""


def folded(spark, sf):
    return P.stratified_folds(followup(spark, sf), "person_id", "event_indicator", 5, SEED)


@query("stratified_folds", "W10", f"WITH {FOLLOWUP} SELECT person_id, event_indicator, {FOLD} AS fold FROM followup")
def _folds(spark, sf):
    return folded(spark, sf).select("person_id", "event_indicator", "fold")


@query(
    "train_val_split",
    "W11",
    f"""WITH {FOLLOWUP} SELECT person_id, {hashed("'split'", "person_id")} < {int(0.75 * 2**60)} AS training FROM followup""",
)
def _split(spark, sf):
    return followup(spark, sf).select("person_id", P.in_training("person_id", SEED).alias("training"))


@query(
    "subsample_controls",
    "T2 U1",
    f"""WITH {FOLLOWUP}, n AS (SELECT CAST(floor(1.5 * count(*)) AS BIGINT) AS n FROM followup WHERE hospitalized)
    SELECT person_id, hospitalized FROM followup WHERE hospitalized
    UNION ALL SELECT person_id, hospitalized FROM (
      SELECT *, row_number() OVER (ORDER BY {hashed("'subsample'", "person_id")}, person_id) AS r
      FROM followup WHERE NOT hospitalized), n WHERE r <= n.n""",
)
def _subsample(spark, sf):
    rows = followup(spark, sf).select("person_id", "hospitalized")
    return P.subsample_controls(rows, "person_id", "hospitalized", 1.5, SEED)


SUFFIXES = ("0", "1", "2", "all")


def fold_metrics(spark, sf):
    """Wide fold metrics computed from the follow-up rows; one column is missing in one fold."""
    score = F.col("c_acctbal") / 10000
    time = F.col("event_time") / 2500
    out = []
    for suffix in SUFFIXES:
        inside = F.lit(True) if suffix == "all" else F.col("event_indicator") == int(suffix)
        for name, fn in (("c_harrel", F.avg), ("c_uno", F.max), ("ibs", F.avg), ("auc_mean", F.min)):
            source = score if name.startswith("c_") else time
            out.append(fn(F.when(inside, source)).alias(f"{name}_{suffix}"))
    wide = folded(spark, sf).groupBy("fold").agg(*out)
    return wide.withColumn("ibs_2", F.when(F.col("fold") != 3, F.col("ibs_2")))


def _fold_sql() -> str:
    parts = []
    names = {"0": "censoring", "1": "composite", "2": "death", "all": "overall survival"}
    for suffix, label in names.items():
        cond = "true" if suffix == "all" else f"event_indicator = {suffix}"
        for name, agg, col in (
            ("c_harrel", "avg", "c_acctbal / 10000"),
            ("c_uno", "max", "c_acctbal / 10000"),
            ("ibs", "avg", "event_time / 2500"),
            ("auc_mean", "min", "event_time / 2500"),
        ):
            parts.append(
                f"SELECT fold, '{name}' AS metric, '{label}' AS endpoint, {agg}({col}) AS value FROM ff WHERE {cond}"
                + (" AND fold <> 3" if (name, suffix) == ("ibs", "2") else "")
                + " GROUP BY fold"
            )
    return f"{FOLLOWUP}, ff AS (SELECT *, {FOLD} AS fold FROM followup), fm AS ({' UNION ALL '.join(parts)})"


@query(
    "unpivot_metrics",
    "X2 X3 P31 D11",
    f"WITH {_fold_sql()} SELECT fold, metric, endpoint, round(value, 8) AS value FROM fm",
)
def _unpivot(spark, sf):
    out = M.unpivot_metrics(fold_metrics(spark, sf), "fold", "composite")
    return out.withColumn("value", F.round("value", 8))


@query(
    "metric_summary",
    "A18",
    f"""WITH {_fold_sql()} SELECT metric, endpoint, count(value) AS folds, round(quantile_cont(value, 0.0), 8) AS q0,
    round(quantile_cont(value, 0.25), 8) AS q25, round(quantile_cont(value, 0.5), 8) AS q50,
    round(quantile_cont(value, 0.75), 8) AS q75, round(quantile_cont(value, 1.0), 8) AS q100 FROM fm GROUP BY ALL""",
)
def _summary(spark, sf):
    out = M.metric_summary(M.unpivot_metrics(fold_metrics(spark, sf), "fold", "composite"))
    return out.withColumns({c: F.round(c, 8) for c in ("q0", "q25", "q50", "q75", "q100")})


@query(
    "auc_curve_summary",
    "A19 W8",
    f"""WITH {FOLLOWUP}, ff AS (SELECT *, {FOLD} AS fold FROM followup),
    pts AS (SELECT event_indicator, fold, event_time - event_time % 50 AS t, avg(c_acctbal) AS v FROM ff GROUP BY ALL),
    times AS (SELECT event_indicator, t, row_number() OVER (PARTITION BY event_indicator ORDER BY t) AS pos
      FROM (SELECT DISTINCT event_indicator, t FROM pts)),
    full_grid AS (SELECT ts.event_indicator, ts.t, ts.pos, f.fold, p.v, CASE WHEN p.v IS NOT NULL THEN ts.pos END AS known_pos
      FROM times ts CROSS JOIN (SELECT unnest(range(5)) AS fold) f
      LEFT JOIN pts p ON p.event_indicator = ts.event_indicator AND p.t = ts.t AND p.fold = f.fold),
    near AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(known_pos IGNORE NULLS) OVER b AS p0,
        first_value(v IGNORE NULLS) OVER a AS v1, first_value(known_pos IGNORE NULLS) OVER a AS p1
      FROM full_grid
      WINDOW b AS (PARTITION BY event_indicator, fold ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        a AS (PARTITION BY event_indicator, fold ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT event_indicator, t, CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL
        WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END AS v FROM near)
    SELECT event_indicator, t, CASE WHEN count(v) = 5 THEN round(avg(v), 6) END AS mean,
      CASE WHEN count(v) = 5 THEN round(stddev_samp(v), 6) END AS std FROM filled GROUP BY ALL""",
)
def _auc_curves(spark, sf):
    points = (
        folded(spark, sf)
        .withColumn("t", F.col("event_time") - F.col("event_time") % 50)
        .groupBy("event_indicator", "fold", "t")
        .agg(F.avg("c_acctbal").alias("v"))
    )
    out = M.auc_curve_summary(points, range(5), "event_indicator", "t", "v")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "best_trial",
    "T3 A25",
    f"""WITH {FOLLOWUP}, ff AS (SELECT *, {FOLD} AS fold FROM followup),
    r AS (SELECT c_nationkey AS trial, fold, avg(c_acctbal) AS score FROM ff GROUP BY ALL),
    m AS (SELECT trial, avg(score) AS score FROM r GROUP BY trial)
    SELECT 'maximize' AS direction, arg_max(trial, score) AS best_params, round(max(score), 6) AS best_value FROM m
    UNION ALL SELECT 'minimize', arg_min(trial, score), round(min(score), 6) FROM m""",
)
def _best(spark, sf):
    results = folded(spark, sf).groupBy(F.col("c_nationkey").alias("trial"), "fold").agg(
        F.avg("c_acctbal").alias("score")
    )
    means = P.mean_over_folds(results, "trial", "score")
    picks = [
        P.best_trial(means, "trial", "score", minimize).select(
            F.lit("minimize" if minimize else "maximize").alias("direction"),
            "best_params",
            F.round("best_value", 6).alias("best_value"),
        )
        for minimize in (False, True)
    ]
    return picks[0].unionByName(picks[1])


def effects(spark, sf):
    """A continuous value per customer and target day that stands for an estimated effect."""
    rows = followup(spark, sf)
    day = F.explode(F.array(*[F.lit(t) for t in TARGETS])).alias("t")
    value = F.col("c_acctbal") / 20000 + (F.col("event_time") - F.col("t")) / 10000
    return rows.select("*", day).withColumn("hte", value)


EFFECTS = f"""{FOLLOWUP},
effects0 AS (
  SELECT f.*, t, c_acctbal / 20000 + (event_time - t) / 10000 AS raw
  FROM followup f, (SELECT unnest([400, 800, 1200]) AS t)),
effects AS (SELECT * EXCLUDE (raw), CASE WHEN raw <= 0.45 THEN raw END AS hte FROM effects0),
cuts AS (SELECT t, quantile_cont(hte, 0.05) AS q_lower, quantile_cont(hte, 0.95) AS q_upper FROM effects GROUP BY t),
grouped AS (
  SELECT e.*, q_lower, q_upper, CASE WHEN hte <= q_lower THEN 'bottom' WHEN hte <= q_upper THEN 'middle'
    WHEN hte > q_upper THEN 'top' END AS quantile_group FROM effects e JOIN cuts USING (t))
"""


def grouped_effects(spark, sf):
    return M.hte_quantile_groups(effects(spark, sf), "t", "hte", 0.05, ceiling=0.45)


@query(
    "hte_quantile_groups",
    "A20",
    f"""WITH {EFFECTS} SELECT person_id, t, round(hte, 8) AS hte, round(q_lower, 8) AS q_lower,
    round(q_upper, 8) AS q_upper, quantile_group FROM grouped""",
)
def _groups(spark, sf):
    out = grouped_effects(spark, sf).select("person_id", "t", "hte", "q_lower", "q_upper", "quantile_group")
    return out.withColumns({c: F.round(c, 8) for c in ("hte", "q_lower", "q_upper")})


KIND_COLUMNS = ("exposed", "event_time", "event_indicator", "age", "hospitalized", "c_acctbal", "c_nationkey", "c_mktsegment")


@query(
    "feature_kind",
    "A21",
    f"WITH {FOLLOWUP} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CASE WHEN count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) = 2 THEN 'binary'
        WHEN {str(c != 'c_mktsegment').lower()} AND count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 5
        THEN 'continuous' END AS kind FROM followup"""
        for c in KIND_COLUMNS
    ),
)
def _kinds(spark, sf):
    kinds = M.feature_kinds(followup(spark, sf), KIND_COLUMNS)
    return spark.createDataFrame(list(kinds.items()), "feature string, kind string")


CONTINUOUS = ("age", "c_acctbal", "event_time")
BINARY = ("hospitalized", "exposed")


def _long_sql(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT t, quantile_group, '{c}' AS covariate, CAST({c} AS DOUBLE) AS value FROM grouped"
        for c in columns
    )


@query(
    "pooled_t",
    "A22 M22",
    f"""WITH {EFFECTS}, long_rows AS ({_long_sql(CONTINUOUS)}),
    m AS (SELECT t, covariate, count(value) FILTER (WHERE quantile_group = 'bottom') AS n1, avg(value) FILTER (WHERE quantile_group = 'bottom') AS m1,
      var_samp(value) FILTER (WHERE quantile_group = 'bottom') AS v1, count(value) FILTER (WHERE quantile_group = 'top') AS n2,
      avg(value) FILTER (WHERE quantile_group = 'top') AS m2, var_samp(value) FILTER (WHERE quantile_group = 'top') AS v2
      FROM long_rows GROUP BY ALL)
    SELECT t, covariate, n1 AS n_bottom, n2 AS n_top, n1 + n2 - 2 AS df,
      round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t_stat FROM m""",
)
def _pooled(spark, sf):
    rows = grouped_effects(spark, sf)
    out = M.compare_continuous(rows.withColumnRenamed("t", "day"), ["day"], CONTINUOUS)
    return out.select(
        F.col("day").alias("t"), "covariate", "n_bottom", "n_top", "df", F.round("t", 6).alias("t_stat")
    )


@query(
    "binary_rate_chi2",
    "A23 M22",
    f"""WITH {EFFECTS}, long_rows AS ({_long_sql(BINARY)}),
    c AS (SELECT t, covariate, sum(value) FILTER (WHERE quantile_group = 'bottom') AS a, sum(value) FILTER (WHERE quantile_group = 'top') AS b,
      count(value) FILTER (WHERE quantile_group = 'bottom') AS n1, count(value) FILTER (WHERE quantile_group = 'top') AS n2
      FROM long_rows GROUP BY ALL)
    SELECT t, covariate, round(100 * a / n1, 6) AS rate_bottom, round(100 * b / n2, 6) AS rate_top,
      round(CASE WHEN (a + b) * (n1 + n2 - a - b) > 0 THEN (n1 + n2) * greatest(abs(a * (n2 - b) - b * (n1 - a)) - (n1 + n2) / 2, 0) ** 2
        / ((a + b) * (n1 + n2 - a - b) * n1 * n2) END, 6) AS chi2 FROM c""",
)
def _chi2(spark, sf):
    out = M.compare_binary(grouped_effects(spark, sf), ["t"], BINARY)
    rounded = {c: F.round(c, 6) for c in ("rate_bottom", "rate_top", "chi2")}
    return out.select("t", "covariate", "rate_bottom", "rate_top", "chi2").withColumns(rounded)


@query(
    "t_p_values",
    "A22 A24",
    """WITH s AS (SELECT o_orderkey, (o_totalprice - 250000) / 50000 AS t, 1 + o_orderkey % 4 AS df FROM orders),
    p AS (SELECT *, CASE df WHEN 1 THEN 1 - 2 / pi() * atan(abs(t)) WHEN 2 THEN 1 - abs(t) / sqrt(2 + t * t)
      WHEN 3 THEN 1 - 2 / pi() * (atan(abs(t) / sqrt(3)) + abs(t) / sqrt(3) / (1 + t * t / 3))
      ELSE 1 - abs(t) / sqrt(4 + t * t) * (1 + 2 / (4 + t * t)) END AS p FROM s)
    SELECT o_orderkey, round(p, 9) AS p, CASE WHEN p >= 0.05 THEN 'n. s.' WHEN p >= 0.005 THEN '*' WHEN p >= 0.0005 THEN '**'
      ELSE '***' END AS stars FROM p""",
)
def _t_p(spark, sf):
    """p values at one to four degrees of freedom, where they have closed forms."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    t, df = (F.col("o_totalprice") - 250000) / 50000, 1 + F.col("o_orderkey") % 4
    rows = orders.select("o_orderkey", stats.t_p_value(t, df).alias("p"))
    return rows.select("o_orderkey", F.round("p", 9).alias("p"), stats.significance_stars(F.col("p")).alias("stars"))


@query(
    "chi2_stars",
    "A23 A24",
    f"""WITH {EFFECTS}, long_rows AS ({_long_sql(BINARY)}),
    c AS (SELECT t, covariate, sum(value) FILTER (WHERE quantile_group = 'bottom') AS a, sum(value) FILTER (WHERE quantile_group = 'top') AS b,
      count(value) FILTER (WHERE quantile_group = 'bottom') AS n1, count(value) FILTER (WHERE quantile_group = 'top') AS n2
      FROM long_rows GROUP BY ALL),
    x AS (SELECT t, covariate, CASE WHEN (a + b) * (n1 + n2 - a - b) > 0 THEN
      (n1 + n2) * greatest(abs(a * (n2 - b) - b * (n1 - a)) - (n1 + n2) / 2, 0) ** 2 / ((a + b) * (n1 + n2 - a - b) * n1 * n2) END AS chi2 FROM c)
    SELECT t, covariate, CASE WHEN chi2 > 12.115665146 THEN '***' WHEN chi2 > 7.879438577 THEN '**' WHEN chi2 > 3.841458821 THEN '*'
      ELSE 'n. s.' END AS stars FROM x""",
)
def _chi2_stars(spark, sf):
    """Stars of the p values; the SQL holds the statistic against the table values of 0.05, 0.005 and 0.0005."""
    return M.compare_binary(grouped_effects(spark, sf), ["t"], BINARY).select("t", "covariate", "stars")


@query(
    "significance_stars",
    "A24",
    """SELECT o_orderkey, CASE WHEN p >= 0.05 THEN 'n. s.' WHEN p >= 0.005 THEN '*' WHEN p >= 0.0005 THEN '**' ELSE '***' END AS stars
    FROM (SELECT o_orderkey, pow(o_totalprice / 1000000, 4) AS p FROM orders)""",
)
def _stars(spark, sf):
    p = F.pow(F.col("o_totalprice") / 1000000, F.lit(4))
    return S.orders(spark, sf).select("o_orderkey", stats.significance_stars(p).alias("stars"))


@query(
    "group_distribution",
    "A27",
    f"""WITH {EFFECTS}, long_rows AS ({_long_sql(("age", "c_acctbal", "hte"))})
    SELECT t, quantile_group, covariate, count(value) AS n, round(max(value), 9) AS largest,
      round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.5), 9) AS q50, round(quantile_cont(value, 0.75), 9) AS q75
    FROM long_rows WHERE quantile_group IS NOT NULL GROUP BY ALL""",
)
def _distribution(spark, sf):
    rows = grouped_effects(spark, sf).where(F.col("quantile_group").isNotNull())
    out = M.group_distribution(rows, ["t", "quantile_group"], ("age", "c_acctbal", "hte"))
    return out.withColumns({c: F.round(c, 9) for c in ("largest", "q25", "q50", "q75")})


PROBS = (0.0, 0.01, 0.5, 0.999, 1.0)


@query(
    "exact_quantiles",
    "A20 A27",
    " UNION ALL ".join(
        f"""SELECT o_orderpriority, CAST({p} AS DOUBLE) AS prob, round(quantile_cont(o_totalprice, {p}), 6) AS quantile
        FROM orders GROUP BY o_orderpriority"""
        for p in PROBS
    ),
)
def _quantiles(spark, sf):
    orders = S.orders(spark, sf)
    out = R.exact_quantiles(orders, "o_totalprice", PROBS, ["o_orderpriority"], accuracy=1000)
    return out.withColumn("quantile", F.round("quantile", 6))
