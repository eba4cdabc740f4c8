"""Queries on prediction metrics, hazards, targeted estimates and effect heterogeneity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from epispan.functions import stats
from epispan.operators import curves as K
from epispan.operators import hazards as H
from epispan.operators import metrics as E
from epispan.operators import propensity as Q
from epispan.operators import sampling as P
from epispan.operators import summaries as M
from epispan.operators import tmle as T
from epispan.operators.search import BOOSTING
from epispan.params import FitParams, HazardParams
from epispan.plans.estimation import benchmark_rows, e_value_benchmark, select_rows
from epispan.registry.base import query
from epispan.registry.sql import SEED, hashed
from epispan.registry.statistic import FOLD, FOLLOWUP, followup
from epispan.session import cut, spread

GRID = tuple(range(0, 2401, 200))
EVAL_TIMES = (400.0, 800.0, 1200.0, 1600.0)
TAU = 2000.0


def predicted(spark, sf):
    """Follow-up rows with an event flag, a risk score and a survival curve on a fixed grid."""
    power = 1 + F.col("c_nationkey") / 25
    curve = F.array(*[F.exp(-F.pow(F.lit(t / 1500), power)) for t in GRID])
    return followup(spark, sf).select(
        "person_id",
        "hospitalized",
        "event_time",
        (F.col("event_indicator") == 1).alias("event"),
        (F.round(F.col("c_acctbal") / 500) - F.col("event_time") / 400).alias("score"),
        curve.alias("curve"),
        P.in_training("person_id", SEED).alias("training"),
    )


PREDICTED = f"""{FOLLOWUP},
pred AS (
  SELECT person_id, hospitalized, event_time, event_indicator = 1 AS event, c_nationkey,
    round(c_acctbal / 500) - event_time / 400 AS score,
    {hashed("'split'", "person_id")} < {int(0.75 * 2**60)} AS training FROM followup),
test AS (SELECT * FROM pred WHERE NOT training),
tdaily AS (SELECT hospitalized, event_time AS t, count(*) AS leaving, count(*) FILTER (WHERE event) AS d FROM pred WHERE training GROUP BY ALL),
trisk AS (SELECT *, sum(leaving) OVER (PARTITION BY hospitalized ORDER BY t DESC) AS n FROM tdaily),
tg AS (SELECT *, product(1 - CASE WHEN n > d THEN (leaving - d) / (n - d) ELSE 0 END) OVER (PARTITION BY hospitalized ORDER BY t) AS g FROM trisk),
days AS (SELECT DISTINCT hospitalized, event_time AS t FROM test),
g_own AS (SELECT d.hospitalized, d.t, coalesce(arg_max(tg.g, tg.t), 1.0) AS g FROM days d
  LEFT JOIN tg ON tg.hospitalized = d.hospitalized AND tg.t <= d.t GROUP BY ALL)
"""
LONGER = "(j.event_time > i.event_time OR (j.event_time = i.event_time AND NOT j.event))"


def arms(spark, sf):
    rows = predicted(spark, sf)
    train, test = rows.where("training"), rows.where(~F.col("training"))
    curve = E.censoring_survival(train, "event_time", "event", ["hospitalized"])
    return train, test, curve


@query(
    "c_harrell",
    "M9 J13",
    f"""WITH {PREDICTED} SELECT i.hospitalized, CAST(count(*) FILTER (WHERE j.score < i.score) AS DOUBLE) AS concordant,
      CAST(count(*) FILTER (WHERE j.score = i.score) AS DOUBLE) AS tied, CAST(count(*) AS DOUBLE) AS comparable,
      round((count(*) FILTER (WHERE j.score < i.score) + 0.5 * count(*) FILTER (WHERE j.score = i.score)) / count(*), 8) AS c_index
    FROM pred i JOIN pred j ON i.event AND j.hospitalized = i.hospitalized AND {LONGER} GROUP BY i.hospitalized""",
)
def _harrell(spark, sf):
    out = E.concordance(predicted(spark, sf), ["hospitalized"], F.col("score"), "event_time", "event")
    return out.withColumn("c_index", F.round("c_index", 8))


@query(
    "c_harrell_cells",
    "M9 J13",
    f"""WITH {PREDICTED} SELECT i.hospitalized, CAST(count(*) FILTER (WHERE j.score < i.score) AS DOUBLE) AS concordant,
      CAST(count(*) FILTER (WHERE j.score = i.score) AS DOUBLE) AS tied, CAST(count(*) AS DOUBLE) AS comparable
    FROM pred i JOIN pred j ON i.event AND j.hospitalized = i.hospitalized AND {LONGER} GROUP BY i.hospitalized""",
)
def _harrell_cells(spark, sf):
    rows = predicted(spark, sf)
    out = E.concordance(rows, ["hospitalized"], F.col("score"), "event_time", "event", cell_rows=200)
    return out.drop("c_index")


@query(
    "c_uno",
    "M10",
    f"""WITH {PREDICTED}, w AS (SELECT i.*, CASE WHEN event_time < {TAU} AND g > 0 THEN 1 / (g * g) ELSE 0 END AS w
      FROM test i JOIN g_own o ON o.hospitalized = i.hospitalized AND o.t = i.event_time)
    SELECT i.hospitalized, round(sum(w * CASE WHEN j.score < i.score THEN 1.0 WHEN j.score = i.score THEN 0.5 ELSE 0.0 END) / sum(w), 8) AS c_index
    FROM w i JOIN test j ON i.event AND j.hospitalized = i.hospitalized AND {LONGER} GROUP BY i.hospitalized""",
)
def _uno(spark, sf):
    _, test, curve = arms(spark, sf)
    by = ["hospitalized"]
    weights = E.uno_weights(E.censoring_at_own_time(test, curve, "event_time", by), TAU)
    out = E.concordance(test, by, F.col("score"), "event_time", "event", weights)
    return out.select("hospitalized", F.round("c_index", 8).alias("c_index"))


@query(
    "c_antolini",
    "M11",
    f"""WITH {PREDICTED}, gi AS (SELECT *, greatest(least(event_time // 200, {len(GRID) - 1}), 0) * 200 AS gt FROM pred),
    s AS (SELECT i.hospitalized, exp(-pow(i.gt / 1500.0, 1 + i.c_nationkey / 25)) AS si, exp(-pow(i.gt / 1500.0, 1 + j.c_nationkey / 25)) AS sj
      FROM gi i JOIN gi j ON i.event AND j.hospitalized = i.hospitalized AND {LONGER})
    SELECT hospitalized, round(avg(CASE WHEN abs(si - sj) < 1e-13 THEN 0.5 WHEN si < sj THEN 1.0 ELSE 0.0 END), 8) AS c_index FROM s GROUP BY 1""",
)
def _antolini(spark, sf):
    rows = predicted(spark, sf)
    out = E.antolini_concordance(rows, ["hospitalized"], "curve", "event_time", "event", GRID)
    return out.select("hospitalized", F.round("c_index", 8).alias("c_index"))


AUC = f"""{PREDICTED},
times AS (SELECT unnest([400.0::DOUBLE, 800.0, 1200.0, 1600.0]) AS t),
auc AS (
  SELECT i.hospitalized, ts.t, sum(1 / g * CASE WHEN j.score < i.score THEN 1.0 WHEN j.score = i.score THEN 0.5 ELSE 0.0 END) / sum(1 / g) AS auc
  FROM times ts JOIN test i ON i.event AND i.event_time <= ts.t
    JOIN g_own o ON o.hospitalized = i.hospitalized AND o.t = i.event_time AND g > 0
    JOIN test j ON j.hospitalized = i.hospitalized AND j.event_time > ts.t GROUP BY ALL)
"""


def auc(spark, sf, cell_rows=E.CELL_ROWS):
    _, test, curve = arms(spark, sf)
    by = ["hospitalized"]
    own = E.censoring_at_own_time(test, curve, "event_time", by)
    return test, E.auc_over_time(
        test, by, F.col("score"), "event_time", "event", EVAL_TIMES, own, cell_rows
    )


@query("auc_over_time", "M12", f"WITH {AUC} SELECT hospitalized, t, round(auc, 8) AS auc FROM auc")
def _auc(spark, sf):
    return auc(spark, sf, cell_rows=100)[1].withColumn("auc", F.round("auc", 8))


@query(
    "mean_auc",
    "M12",
    f"""WITH {AUC},
    sdaily AS (SELECT hospitalized, event_time AS t, count(*) AS leaving, count(*) FILTER (WHERE event) AS d FROM test GROUP BY ALL),
    srisk AS (SELECT *, sum(leaving) OVER (PARTITION BY hospitalized ORDER BY t DESC) AS n FROM sdaily),
    sv AS (SELECT *, product(1 - d / n) OVER (PARTITION BY hospitalized ORDER BY t) AS surv FROM srisk),
    at AS (SELECT a.hospitalized, a.t, a.auc, coalesce(arg_max(surv, sv.t), 1.0) AS surv FROM auc a
      LEFT JOIN sv ON sv.hospitalized = a.hospitalized AND sv.t <= a.t GROUP BY ALL),
    dr AS (SELECT *, coalesce(lag(surv) OVER (PARTITION BY hospitalized ORDER BY t), 1.0) - surv AS drop_s FROM at)
    SELECT hospitalized, round(sum(auc * drop_s) / (1 - min(surv)), 8) AS auc_mean FROM dr GROUP BY 1""".replace(
        " at AS", " at_t AS"
    ).replace("FROM at)", "FROM at_t)"),
)
def _mean_auc(spark, sf):
    test, curve = auc(spark, sf)
    coded = test.withColumn("event", F.col("event").cast("int"))
    survival = K.kaplan_meier(coded, "event_time", "event", ["hospitalized"])
    out = E.mean_auc(curve, survival, ["hospitalized"])
    return out.withColumn("auc_mean", F.round("auc_mean", 8))


BRIER = f"""{PREDICTED},
gt AS (SELECT CAST(unnest(range(0, 2401, 200)) AS DOUBLE) AS t),
g_grid AS (SELECT h.hospitalized, gt.t, coalesce(arg_max(tg.g, tg.t), 1.0) AS g FROM gt, (SELECT DISTINCT hospitalized FROM pred WHERE training) h
  LEFT JOIN tg ON tg.hospitalized = h.hospitalized AND tg.t <= gt.t GROUP BY ALL),
brier AS (
  SELECT i.hospitalized, q.t, avg(CASE
      WHEN i.event_time <= q.t AND i.event AND o.g > 0 THEN exp(-pow(q.t / 1500.0, 1 + i.c_nationkey / 25)) ** 2 / o.g
      WHEN i.event_time > q.t AND q.g > 0 THEN (1 - exp(-pow(q.t / 1500.0, 1 + i.c_nationkey / 25))) ** 2 / q.g ELSE 0 END) AS brier
  FROM test i JOIN g_own o ON o.hospitalized = i.hospitalized AND o.t = i.event_time
    JOIN g_grid q ON q.hospitalized = i.hospitalized GROUP BY ALL)
"""


def brier(spark, sf):
    _, test, curve = arms(spark, sf)
    return E.brier_over_time(test, ["hospitalized"], "curve", "event_time", "event", GRID, curve)


@query("brier_over_time", "M13", f"WITH {BRIER} SELECT hospitalized, t, round(brier, 8) AS brier FROM brier")
def _brier(spark, sf):
    return brier(spark, sf).withColumn("brier", F.round("brier", 8))


@query(
    "integrated_brier",
    "M13",
    f"""WITH {BRIER}, a AS (SELECT *, (t - lag(t) OVER w) * (brier + lag(brier) OVER w) / 2 AS area FROM brier
      WINDOW w AS (PARTITION BY hospitalized ORDER BY t))
    SELECT hospitalized, round(sum(area) / (max(t) - min(t)), 8) AS ibs FROM a GROUP BY 1""",
)
def _ibs(spark, sf):
    out = E.integrated_brier(brier(spark, sf), ["hospitalized"])
    return out.withColumn("ibs", F.round("ibs", 8))


@query(
    "risk_score",
    "X5 D10",
    f"""WITH {PREDICTED} SELECT person_id, round(sum(-ln(exp(-pow(t / 1500.0, 1 + c_nationkey / 25)) + 1e-10)), 6) AS risk_score
    FROM pred, (SELECT unnest(range(0, 2401, 200)) AS t) GROUP BY person_id""",
)
def _risk(spark, sf):
    score = stats.risk_score(F.col("curve"))
    return predicted(spark, sf).select("person_id", F.round(score, 6).alias("risk_score"))


# One simple curve model per person stands in for fitted hazards where SQL recomputes the result.
STEP_TARGETS = (600.0, 1200.0, 1800.0)


def step_target():
    return T.Target(
        "person_id", "hospitalized", "event_indicator", "propensity", GRID_F, STEP_TARGETS, bound=0.05
    )


GRID_F = tuple(float(t) for t in GRID)


def curve_frame(spark, sf):
    """Constant hazards per person and arm, shared censoring curve, and a propensity."""
    lift = 1 + F.col("c_nationkey") / 50
    arrays = {}
    for arm in (0, 1):
        for cause, base in ((1, 0.06), (2, 0.03)):
            value = lift * (base * (1 + 0.31 * arm))
            arrays[H.haz_name(cause, arm)] = F.array_repeat(value, len(GRID))
        stay = [0.98 ** (k + 1) for k in range(len(GRID))]
        arrays[H.cens_name(arm)] = F.array(*[F.lit(s) for s in stay])
    rows = followup(spark, sf).withColumns(arrays)
    rows = rows.withColumn("own", H.grid_index("event_time", GRID))
    return rows.withColumn("propensity", 0.2 + F.col("c_nationkey") / 100)


INFLUENCE = f"""{FOLLOWUP},
cf AS (
  SELECT person_id, hospitalized, event_indicator, least(event_time // 200, {len(GRID) - 1}) AS own, arm,
    CASE WHEN arm = 1 THEN 0.2::DOUBLE + c_nationkey / 100 ELSE 1 - (0.2::DOUBLE + c_nationkey / 100) END AS pi,
    (1 + c_nationkey / 50) * (0.06::DOUBLE * (1 + 0.31::DOUBLE * arm)) AS h1, (1 + c_nationkey / 50) * (0.03::DOUBLE * (1 + 0.31::DOUBLE * arm)) AS h2
  FROM followup, (SELECT unnest([0, 1]) AS arm)),
st AS (
  SELECT cf.*, s, pow(1 - h1 - h2, s + 1) AS surv, (1 - pow(1 - h1 - h2, s + 1)) / (h1 + h2) AS mass,
    1 / (greatest(pi, 0.05) * greatest(pow(0.98::DOUBLE, s), 0.05)) AS weight,
    CASE WHEN hospitalized = (arm = 1) THEN 1 ELSE 0 END AS own_arm,
    CASE WHEN own = s AND event_indicator = 1 THEN 1 ELSE 0 END - CASE WHEN s <= own THEN h1 ELSE 0 END AS m1,
    CASE WHEN own = s AND event_indicator = 2 THEN 1 ELSE 0 END - CASE WHEN s <= own THEN h2 ELSE 0 END AS m2
  FROM cf, (SELECT unnest(range({len(GRID)})) AS s)),
per_arm AS (
  SELECT k.person_id, k.arm, ev AS event, k.s * 200.0::DOUBLE AS target_time, any_value(k.mass * CASE ev WHEN 1 THEN k.h1 ELSE k.h2 END) AS f,
    sum(x.weight * x.own_arm * (CASE ev WHEN 1 THEN x.m1 ELSE x.m2 END
      - (k.mass - x.mass) * CASE ev WHEN 1 THEN k.h1 ELSE k.h2 END / x.surv * (x.m1 + x.m2))) AS m
  FROM st k JOIN st x ON x.person_id = k.person_id AND x.arm = k.arm AND x.s <= k.s, (SELECT unnest([1, 2]) AS ev)
  WHERE k.s IN (3, 6, 9) GROUP BY k.person_id, k.arm, ev, k.s),
inf AS (
  SELECT person_id, event, target_time, max(f) FILTER (WHERE arm = 1) AS f1, max(f) FILTER (WHERE arm = 0) AS f0,
    max(f + m) FILTER (WHERE arm = 1) AS u1, max(f + m) FILTER (WHERE arm = 0) AS u0 FROM per_arm GROUP BY ALL)
"""


@query(
    "influence_values",
    "M17",
    f"""WITH {INFLUENCE} SELECT person_id, event, target_time, round(f1, 12) AS f1, round(f0, 12) AS f0,
    round(u1, 12) AS u1, round(u0, 12) AS u0 FROM inf""",
)
def _influence(spark, sf):
    out = T.influence_rows(curve_frame(spark, sf), step_target())
    return out.withColumns({c: F.round(c, 12) for c in ("f1", "f0", "u1", "u0")})


MOMENTS = f"""{INFLUENCE},
mo AS (SELECT event, target_time, count(*) AS n, avg(f1) AS p1, avg(f0) AS p0, var_samp(u1) AS v1, var_samp(u0) AS v0, covar_samp(u1, u0) AS c FROM inf GROUP BY ALL),
se AS (SELECT *, sqrt(greatest(v1 + v0 - 2 * c, 0) / n) AS rd_se, sqrt(greatest(v1 / (p1 * p1) + v0 / (p0 * p0) - 2 * c / (p1 * p0), 0) / n) AS log_se FROM mo),
est AS (
  SELECT event, target_time, 'risks' AS type, 1 AS arm, p1 AS estimate, sqrt(v1 / n) AS se, p1 - {T.Z_95} * sqrt(v1 / n) AS lo, p1 + {T.Z_95} * sqrt(v1 / n) AS hi FROM se
  UNION ALL SELECT event, target_time, 'risks', 0, p0, sqrt(v0 / n), p0 - {T.Z_95} * sqrt(v0 / n), p0 + {T.Z_95} * sqrt(v0 / n) FROM se
  UNION ALL SELECT event, target_time, 'rr', NULL, p1 / p0, p1 / p0 * log_se, p1 / p0 * exp(-{T.Z_95} * log_se), p1 / p0 * exp({T.Z_95} * log_se) FROM se
  UNION ALL SELECT event, target_time, 'rd', NULL, p1 - p0, rd_se, p1 - p0 - {T.Z_95} * rd_se, p1 - p0 + {T.Z_95} * rd_se FROM se)
"""
ROUNDED = ("estimate", "se", "lo", "hi")


def step_estimates(spark, sf):
    return T.estimates(T.influence_rows(curve_frame(spark, sf), step_target()))


@query(
    "estimates",
    "M18 D12",
    f"WITH {MOMENTS} SELECT event, target_time, type, arm, "
    + ", ".join(f"round({c}, 7) AS {c}" for c in ROUNDED)
    + " FROM est",
)
def _estimates(spark, sf):
    return step_estimates(spark, sf).withColumns({c: F.round(c, 7) for c in ROUNDED})


@query(
    "e_values",
    "M19",
    f"""WITH {MOMENTS}, r AS (SELECT event, target_time, estimate, lo, hi, CASE WHEN estimate >= 1 THEN lo ELSE hi END AS near FROM est WHERE type = 'rr'),
    a AS (SELECT *, CASE WHEN estimate < 1 THEN 1 / estimate ELSE estimate END AS e, CASE WHEN near < 1 THEN 1 / near ELSE near END AS l FROM r)
    SELECT event, target_time, round(e + sqrt(e * (e - 1)), 6) AS e_value,
      CASE WHEN lo <= 1 AND hi >= 1 THEN 1.0::DOUBLE ELSE round(l + sqrt(l * (l - 1)), 6) END AS e_value_limit FROM a""",
)
def _e_values(spark, sf):
    out = T.e_values(step_estimates(spark, sf).where("type = 'rr'"))
    return out.select(
        "event",
        "target_time",
        F.round("e_value", 6).alias("e_value"),
        F.round("e_value_limit", 6).alias("e_value_limit"),
    )


@query(
    "e_value_contours",
    "M19",
    f"""WITH {MOMENTS}, lv AS (SELECT unnest([1.0::DOUBLE, 1.5, 2.0, 3.0]) AS x)
    SELECT event, target_time, a.x AS rr_exposure, b.x AS rr_outcome, round(a.x * b.x / (a.x + b.x - 1), 7) AS bias_factor,
      round(CASE WHEN estimate >= 1 THEN estimate / (a.x * b.x / (a.x + b.x - 1)) ELSE estimate * (a.x * b.x / (a.x + b.x - 1)) END, 7) AS adjusted
    FROM est, lv a, lv b WHERE type = 'rr'""",
)
def _contours(spark, sf):
    ratios = step_estimates(spark, sf).where("type = 'rr'")
    out = T.e_value_contours(ratios, (1.0, 1.5, 2.0, 3.0))
    return out.select(
        "event",
        "target_time",
        "rr_exposure",
        "rr_outcome",
        F.round("bias_factor", 7).alias("bias_factor"),
        F.round("adjusted", 7).alias("adjusted"),
    )


HIGHER = f"""{MOMENTS},
arms AS (SELECT event, target_time, p1 - p0 AS estimate, (p1 - p0) - {T.Z_95} * rd_se AS lo, (p1 - p0) + {T.Z_95} * rd_se AS hi,
  greatest(p1, p0) AS h, least(p1, p0) AS l, CASE WHEN p1 >= p0 THEN v1 ELSE v0 END / n AS vh, CASE WHEN p1 >= p0 THEN v0 ELSE v1 END / n AS vl,
  c / n AS cov, p1, p0 FROM se)
"""


@query(
    "difference_e_values",
    "M19",
    f"""WITH {HIGHER},
    q AS (SELECT *, l * l - {T.Z_95**2} * vl AS qa, h * l - {T.Z_95**2} * cov AS qb, h * h - {T.Z_95**2} * vh AS qc FROM arms),
    roots AS (SELECT *, (qb - sqrt(qb * qb - qa * qc)) / qa AS b FROM q)
    SELECT event, target_time, round(estimate, 7) AS estimate, round(h / l + sqrt(h / l * (h / l - 1)), 6) AS e_value,
      CASE WHEN lo <= 0 AND hi >= 0 THEN 1.0::DOUBLE ELSE round(b + sqrt(b * (b - 1)), 6) END AS e_value_limit FROM roots""",
)
def _difference_e_values(spark, sf):
    out = T.difference_e_values(step_estimates(spark, sf))
    digits = {"estimate": 7, "e_value": 6, "e_value_limit": 6}
    return out.select("event", "target_time", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "contours_of_both",
    "M19",
    f"""WITH {HIGHER}, lv AS (SELECT unnest({list(FitParams().contour_strengths)}::DOUBLE[]) AS x),
    g AS (SELECT *, a.x AS rr_exposure, b.x AS rr_outcome, a.x * b.x / (a.x + b.x - 1) AS f FROM arms, lv a, lv b)
    SELECT 'rd' AS type, event, target_time, rr_exposure, rr_outcome, round(CASE WHEN p1 >= p0 THEN p1 / f - p0 ELSE p1 - p0 / f END, 7) AS adjusted FROM g
    UNION ALL SELECT 'rr', event, target_time, rr_exposure, rr_outcome, round(CASE WHEN p1 >= p0 THEN p1 / p0 / f ELSE p1 / p0 * f END, 7) FROM g""",
)
def _both_contours(spark, sf):
    out = T.both_contours(step_estimates(spark, sf), FitParams().contour_strengths)
    return out.select("type", "event", "target_time", "rr_exposure", "rr_outcome", F.round("adjusted", 7).alias("adjusted"))


@query(
    "quantile_bins",
    "A11 A10",
    f"""WITH {FOLLOWUP}, e AS (SELECT list_distinct([sorted[CAST(floor(j * (len(sorted) - 1) / 21.0) AS INTEGER) + 1] for j in range(22)]) AS edges
      FROM (SELECT list(event_time ORDER BY event_time) AS sorted FROM followup))
    SELECT hospitalized, CAST(coalesce(list_max([x for x in edges if x < event_time]), list_min(edges)) AS DOUBLE) AS bin, count(*) AS n
    FROM followup, e GROUP BY ALL""",
)
def _quantile_bins(spark, sf):
    rows = followup(spark, sf).select("person_id", "hospitalized", "event_time")
    binned, _, _ = benchmark_rows(rows, FitParams(target_times=(100,)))
    return binned.groupBy("hospitalized", F.col("event_time").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("e_value_benchmark", "M19 A11 M17")
def _e_value_benchmark(spark, sf):
    """Every covariate left out in turn; the score is the logistic one, all else as by default."""
    params = FitParams(exclude_columns=(), subset_condition=None, match=False, target_times=STEP_TARGETS)

    def score(rows, used):
        scored = Q.propensity_scores(rows, "person_id", "hospitalized", used, SEED, learner="logistic")
        return scored.select("person_id", F.col("propensity_score").alias("propensity"))

    return e_value_benchmark(fit_rows(spark, sf), params, COVARIATES, "person_id", "hospitalized", score=score)


@query(
    "nuisance_weight_summary",
    "M20",
    f"""WITH {INFLUENCE}, w AS (SELECT hospitalized, s * 200.0::DOUBLE AS target_time, weight FROM st WHERE own_arm = 1 AND s IN (3, 6, 9))
    SELECT hospitalized, target_time, count(*) AS n, round(max(weight), 7) AS largest, round(quantile_cont(weight, 0.25), 7) AS q25,
      round(quantile_cont(weight, 0.5), 7) AS q50, round(quantile_cont(weight, 0.75), 7) AS q75 FROM w GROUP BY ALL""",
)
def _nuisance(spark, sf):
    rows = T.nuisance_weights(curve_frame(spark, sf), step_target())
    out = M.group_distribution(rows, ["hospitalized", "target_time"], ["weight"]).drop("covariate")
    return out.withColumns({c: F.round(c, 7) for c in ("largest", "q25", "q50", "q75")})


@query(
    "g_computation",
    "M16",
    f"""WITH {INFLUENCE} SELECT event, target_time, round(avg(f1), 8) AS f1, round(avg(f0), 8) AS f0 FROM inf GROUP BY ALL""",
)
def _g_comp(spark, sf):
    rows = T.influence_rows(curve_frame(spark, sf), step_target())
    out = T.g_computation(rows, ["event", "target_time"], ["f1", "f0"])
    return out.withColumns({c: F.round(c, 8) for c in ("f1", "f0")})


@query(
    "effect_groups",
    "M22 A20 J15",
    f"""WITH {INFLUENCE}, ef AS (SELECT person_id, target_time, f1 - f0 AS hte FROM inf WHERE event = 1),
    cuts AS (SELECT target_time, quantile_cont(hte, 0.05) AS a, quantile_cont(hte, 0.95) AS b FROM ef GROUP BY 1),
    g AS (SELECT ef.*, CASE WHEN hte <= a + 1e-12 THEN 'bottom' WHEN hte <= b + 1e-12 THEN 'middle' ELSE 'top' END AS grp FROM ef JOIN cuts USING (target_time))
    SELECT target_time, count(c_acctbal) FILTER (WHERE grp = 'bottom') AS n_bottom, count(c_acctbal) FILTER (WHERE grp = 'top') AS n_top,
      round(avg(c_acctbal) FILTER (WHERE grp = 'bottom'), 6) AS mean_bottom, round(avg(c_acctbal) FILTER (WHERE grp = 'top'), 6) AS mean_top
    FROM g JOIN customer ON c_custkey = person_id GROUP BY 1""",
)
def _effect_groups(spark, sf):
    effects = T.effect_rows(curve_frame(spark, sf), step_target())
    # curves of the same nation agree only up to rounding, which must not split a group
    effects = effects.withColumn("hte", F.round("hte", 11))
    grouped = M.hte_quantile_groups(effects, "target_time", "hte", 0.05)
    joined = grouped.join(followup(spark, sf).select("person_id", "c_acctbal"), "person_id")
    out = M.compare_continuous(joined, ["target_time"], ["c_acctbal"])
    return out.select(
        "target_time",
        "n_bottom",
        "n_top",
        F.round("mean_bottom", 6).alias("mean_bottom"),
        F.round("mean_top", 6).alias("mean_top"),
    )


PANEL = f"""{INFLUENCE}, folds AS (SELECT person_id, event_time, {FOLD} AS fold FROM followup),
own AS (
  SELECT x.person_id, f.fold, f.event_time, x.event_indicator, x.s, x.surv, 1 - x.h1 * x.mass AS p1, 1 - x.h2 * x.mass AS p2,
    pow(0.98::DOUBLE, x.s + 1) AS p0
  FROM st x JOIN folds f USING (person_id) WHERE own_arm = 1),
scored AS (
  SELECT person_id, fold, event_time, any_value(event_indicator) AS code, round(sum(-ln(p0 + 1e-10)), 9) AS s0, round(sum(-ln(p1 + 1e-10)), 9) AS s1,
    round(sum(-ln(p2 + 1e-10)), 9) AS s2, round(sum(-ln(surv + 1e-10)), 9) AS sa FROM own GROUP BY ALL),
ends AS (
  SELECT fold, '0' AS endpoint, event_time AS t, code = 0 AS hit, s0 AS score FROM scored
  UNION ALL SELECT fold, '1', event_time, code = 1, s1 FROM scored
  UNION ALL SELECT fold, '2', event_time, code = 2, s2 FROM scored
  UNION ALL SELECT fold, 'all', event_time, code > 0, sa FROM scored),
kept AS (SELECT e.* FROM ends e WHERE t < (SELECT max(o.event_time) FROM folds o WHERE o.fold <> e.fold))
"""


@query(
    "metric_panel_concordance",
    "M14 M9",
    f"""WITH {PANEL} SELECT i.fold, 'c_harrel' AS metric, i.endpoint,
      round(avg(CASE WHEN j.score < i.score THEN 1.0 WHEN j.score = i.score THEN 0.5 ELSE 0.0 END), 8) AS value
    FROM kept i JOIN kept j ON i.hit AND i.fold = j.fold AND i.endpoint = j.endpoint AND (j.t > i.t OR (j.t = i.t AND NOT j.hit))
    GROUP BY i.fold, i.endpoint""",
)
def _panel_concordance(spark, sf):
    rows = P.stratified_folds(curve_frame(spark, sf), "person_id", "event_indicator", 5, SEED)
    out = H.metric_panel(
        rows, "hospitalized", "event_time", "event_indicator", GRID_F, families=("c_harrel",)
    )
    return out.na.drop(subset=["value"]).withColumn("value", F.round("value", 8))


@query(
    "metric_panel_auc",
    "M12 M14 S11",
    f"""WITH {PANEL},
    tr AS (SELECT k.fold, e.endpoint, e.t, count(*) AS leaving, count(*) FILTER (WHERE e.hit) AS d
      FROM ends e JOIN (SELECT DISTINCT fold FROM folds) k ON e.fold <> k.fold GROUP BY ALL),
    tr_risk AS (SELECT *, sum(leaving) OVER (PARTITION BY fold, endpoint ORDER BY t DESC) AS n FROM tr),
    tr_g AS (SELECT *, product(1 - CASE WHEN n > d THEN (leaving - d) / (n - d) ELSE 0 END) OVER (PARTITION BY fold, endpoint ORDER BY t) AS g FROM tr_risk),
    days AS (SELECT DISTINCT fold, endpoint, t FROM kept),
    at_day AS (SELECT d.fold, d.endpoint, d.t, coalesce(arg_max(c.g, c.t), 1.0) AS g FROM days d
      LEFT JOIN tr_g c ON c.fold = d.fold AND c.endpoint = d.endpoint AND c.t <= d.t GROUP BY ALL),
    span AS (SELECT fold, endpoint, min(t) AS a, max(t) AS b FROM kept GROUP BY ALL),
    times AS (SELECT CAST(unnest([{", ".join(map(str, GRID_F))}]) AS DOUBLE) AS at),
    cases AS (SELECT k.fold, k.endpoint, k.t, k.score, 1 / g AS w FROM kept k JOIN at_day USING (fold, endpoint, t) WHERE hit AND g > 0)
    SELECT i.fold, i.endpoint, q.at AS t,
      round(sum(i.w * CASE WHEN j.score < i.score THEN 1.0 WHEN j.score = i.score THEN 0.5 ELSE 0.0 END) / sum(i.w), 8) AS auc
    FROM times q JOIN span s ON q.at > s.a AND q.at < s.b
    JOIN cases i ON i.fold = s.fold AND i.endpoint = s.endpoint AND i.t <= q.at
    JOIN kept j ON j.fold = s.fold AND j.endpoint = s.endpoint AND j.t > q.at
    GROUP BY ALL""",
)
def _panel_auc(spark, sf):
    rows = P.stratified_folds(curve_frame(spark, sf), "person_id", "event_indicator", 5, SEED)
    out = H.auc_curves(rows, "hospitalized", "event_time", "event_indicator", GRID_F)
    return out.na.drop(subset=["auc"]).withColumn("auc", F.round("auc", 8))


COVARIATES = ("age", "c_acctbal", "c_nationkey")
FIT_GRID = tuple(float(t) for t in range(0, 2401, 200))


def fit_rows(spark, sf):
    rows = followup(spark, sf)
    names = ["person_id", "hospitalized", "event_time", "event_indicator", *COVARIATES]
    return cut(rows.select(*names), "fit")


def crossed(spark, sf, folds=3):
    return H.cross_fit(
        fit_rows(spark, sf), "person_id", COVARIATES, "hospitalized", "event_time",
        "event_indicator", FIT_GRID, folds, seed=SEED,
    )


@query(
    "selection_counts",
    "A26 P14 T2",
    f"""WITH {FOLLOWUP}, s AS (SELECT * FROM followup WHERE event_time > 30),
    n AS (SELECT count(*) FILTER (WHERE hospitalized) AS n1, count(*) FILTER (WHERE NOT hospitalized) AS n0 FROM s)
    SELECT 'all' AS step, count(*) AS n FROM followup UNION ALL SELECT 'subset', count(*) FROM s
    UNION ALL SELECT 'subsample', n1 + CASE WHEN n0 > 2.0 * n1 THEN CAST(floor(2.0 * n1) AS BIGINT) ELSE n0 END FROM n""",
)
def _selection(spark, sf):
    rows = followup(spark, sf).select("person_id", "hospitalized", "event_time")
    subset = FitParams(subset_condition="event_time > 30")
    sampled = FitParams(subset_condition="event_time > 30", control_subsample_factor=2.0)
    steps = {
        "all": rows,
        "subset": select_rows(rows, subset, "person_id", "hospitalized"),
        "subsample": select_rows(rows, sampled, "person_id", "hospitalized"),
    }
    counts = [f.agg(F.lit(k).alias("step"), F.count(F.lit(1)).alias("n")) for k, f in steps.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("hazard_curves", "M6 D10")
def _hazards(spark, sf):
    rows = fit_rows(spark, sf)
    model = H.fit_hazards(
        rows, COVARIATES, "hospitalized", "event_time", "event_indicator", FIT_GRID, seed=SEED
    )
    keep = ["person_id", "hospitalized"]
    return H.predict_hazards(model, rows, COVARIATES, "hospitalized", keep)


@query(
    "hazard_baseline",
    "M6",
    f"""WITH {FOLLOWUP}, own AS (
      SELECT hospitalized, event_indicator, CAST(least(floor(event_time / 200), 12) AS INTEGER) AS last FROM followup),
    cells AS (
      SELECT hospitalized, t_idx, count(*) AS n, count(*) FILTER (WHERE last = t_idx AND event_indicator = 1) AS n1,
        count(*) FILTER (WHERE last = t_idx AND event_indicator = 2) AS n2,
        count(*) FILTER (WHERE last = t_idx AND event_indicator = 0) AS n0
      FROM own, (SELECT unnest(range(0, 4)) AS t_idx) WHERE last >= t_idx GROUP BY ALL)
    SELECT hospitalized, CAST(t_idx AS INTEGER) AS t_idx, round(n1 / n, 5) AS haz_1, round(n2 / n, 5) AS haz_2,
      round(n0 / (n - n1 - n2), 5) AS leaving FROM cells""",
)
def _hazard_baseline(spark, sf):
    """Without covariates the fitted hazards are the shares of those at risk; later periods have few persons."""
    rows, tables = fit_rows(spark, sf), []
    for arm in (False, True):
        model = H.fit_hazards(
            rows.where(F.col("hospitalized") == arm), (), "hospitalized", "event_time", "event_indicator", FIT_GRID,
            params=HazardParams(reg_param=0.0),
        )
        share = model.shares(0.0)
        for k in range(4):
            stay, one, two, out = (float(v) for v in share[:, k])
            tables.append((arm, k, round(one, 5), round(two, 5), round(out / (stay + out), 5)))
    return spark.createDataFrame(tables, "hospitalized boolean, t_idx int, haz_1 double, haz_2 double, leaving double")


ROUND = HazardParams(learner="boosted", n_iter=1, max_depth=1, min_samples_leaf=5)


@query(
    "boosting_round",
    "M6",
    f"""WITH {FOLLOWUP},
    daily AS (SELECT event_time AS t, count(*) FILTER (WHERE event_indicator > 0) AS d,
      count(*) FILTER (WHERE event_indicator = 0) AS c FROM followup GROUP BY ALL),
    risk AS (SELECT *, sum(d + c) OVER (ORDER BY t DESC) AS n FROM daily),
    chances AS (SELECT t, product(1 - c / greatest(n - d, 1)) OVER (ORDER BY t) AS u, product(1 - d / n) OVER (ORDER BY t) AS s FROM risk),
    looked AS (SELECT person_id, event_time, event_indicator AS e, c_nationkey, hospitalized,
      CAST(({hashed("'time'", "person_id")} >> 12) % 13 AS INTEGER) AS place FROM followup),
    chance AS (
      SELECT f.person_id,
        coalesce(arg_max(b.u, b.t) FILTER (WHERE b.t < f.event_time), 1.0) AS u_own,
        coalesce(arg_max(b.s, b.t) FILTER (WHERE b.t <= f.event_time), 1.0) AS s_own,
        coalesce(arg_max(b.u, b.t) FILTER (WHERE b.t <= 200 * f.place), 1.0) AS u_at,
        coalesce(arg_max(b.s, b.t) FILTER (WHERE b.t <= 200 * f.place), 1.0) AS s_at
      FROM looked f, chances b GROUP BY f.person_id),
    weighed AS (
      SELECT l.*, event_time <= 200 * place AS due,
        CASE WHEN event_time > 200 * place THEN 1 / greatest(u_at, 0.001) WHEN e > 0 THEN 1 / greatest(u_own, 0.001) ELSE 0 END AS we,
        CASE WHEN event_time > 200 * place THEN 1 / greatest(s_at, 0.001) WHEN e = 0 THEN 1 / greatest(s_own, 0.001) ELSE 0 END AS wc
      FROM looked l JOIN chance USING (person_id)),
    states AS (
      SELECT person_id, c_nationkey, hospitalized, place, k AS tree, CASE WHEN k < 3 THEN we ELSE wc END AS w,
        CASE WHEN k < 3 THEN CASE WHEN due THEN e ELSE 0 END = k ELSE due AND e = 0 END AS y
      FROM weighed, (SELECT unnest([0, 1, 2, 3]) AS k)),
    starts AS (SELECT tree, sum(w) FILTER (WHERE y) / sum(w) AS p FROM states GROUP BY tree),
    slopes AS (SELECT s.*, w * (p - CASE WHEN y THEN 1 ELSE 0 END) AS g, w * p * (1 - p) AS h FROM states s JOIN starts USING (tree) WHERE w > 0),
    named AS (
      SELECT tree, 'c_nationkey' AS feature, CAST(c_nationkey AS DOUBLE) AS v, g, h FROM slopes
      UNION ALL SELECT tree, 'hospitalized', CASE WHEN hospitalized THEN 1.0 ELSE 0.0 END, g, h FROM slopes
      UNION ALL SELECT tree, 'time', CAST(200 * place AS DOUBLE), g, h FROM slopes),
    cells AS (SELECT tree, feature, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM named GROUP BY ALL),
    sides AS (
      SELECT tree, feature, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
        sum(g) OVER a AS ga, sum(h) OVER a AS ha, sum(n) OVER a AS na
      FROM cells WINDOW w AS (PARTITION BY tree, feature ORDER BY v), a AS (PARTITION BY tree, feature)),
    gains AS (
      SELECT *, gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) - ga * ga / ha AS gain FROM sides
      WHERE nl >= 5 AND na - nl >= 5 AND hl >= 0.001 AND ha - hl >= 0.001),
    best AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY gain DESC) AS place FROM gains)
    SELECT CAST(tree AS INTEGER) AS tree, feature, v AS cut, round(gain, 4) AS gain,
      round(-0.013 * gl / hl, 6) AS value_left, round(-0.013 * (ga - gl) / (ha - hl), 6) AS value_right
    FROM best WHERE place = 1""",
)
def _boosting_round(spark, sf):
    """The first trees of the states and of censoring: one round of depth one."""
    rows = fit_rows(spark, sf)
    model = H.fit_hazards(
        rows, ("c_nationkey",), "hospitalized", "event_time", "event_indicator", FIT_GRID, params=ROUND, seed=SEED, id_col="person_id"
    ).model
    names, found = ("c_nationkey", "hospitalized", "time"), []
    for number, tree in enumerate(model.rounds[0]):
        if tree.feature[0] >= 0:
            f, cut_at = tree.feature[0], tree.cut[0] - 1
            value = FIT_GRID[cut_at] if f == 2 else model.edges[f][cut_at]
            sizes = round(tree.gain[0], 4), *(round(float(v), 6) for v in tree.value[1:])
            found.append((number, names[f], float(value), *sizes))
    return spark.createDataFrame(found, "tree int, feature string, cut double, gain double, value_left double, value_right double")


@query("hazard_curves_boosted", "M6")
def _hazards_boosted(spark, sf):
    rows = fit_rows(spark, sf)
    model = H.fit_hazards(
        rows, COVARIATES, "hospitalized", "event_time", "event_indicator", FIT_GRID,
        params=HazardParams(learner="boosted"), seed=SEED, id_col="person_id",
    )
    keep = ["person_id", "hospitalized"]
    shared_out = spread(rows, rows.count(), H.PERSONS_PER_TASK)  # narrow rows lie in few files
    return H.predict_hazards(model, shared_out, COVARIATES, "hospitalized", keep)


@query("cross_fit", "M7 W10 P30")
def _cross_fit(spark, sf):
    return crossed(spark, sf)


@query("metric_panel", "M14 M9 M10 M11 M12 M13 D11")
def _panel(spark, sf):
    return H.metric_panel(crossed(spark, sf), "hospitalized", "event_time", "event_indicator", FIT_GRID)


@query("tune", "M8 A25 T3")
def _tune(spark, sf):
    """The four settings of the boosted model: a hundred trials over three inner folds, ten at random, then proposed eight at a time."""
    best, trials = H.tune(
        fit_rows(spark, sf), "person_id", COVARIATES, "hospitalized", "event_time",
        "event_indicator", FIT_GRID, HazardParams(learner="boosted"), "c_antolini_all", seed=SEED, at_once=8,
    )
    chosen = reduce(Column.__and__, [F.col(s) == F.lit(getattr(best, s)) for s in BOOSTING])
    return trials.select("trial", "state", *BOOSTING, "reg_param", "folds", "value", chosen.alias("best"))


UNADJUSTED_TIMES = (400.0, 800.0, 1200.0, 1600.0)


@query(
    "targeted_unadjusted",
    "M17",
    f"""WITH {FOLLOWUP},
    daily AS (
      SELECT hospitalized, least(floor(event_time / 200), 12) * 200 AS t, count(*) AS leaving,
        count(*) FILTER (WHERE event_indicator > 0) AS d, count(*) FILTER (WHERE event_indicator = 1) AS d1,
        count(*) FILTER (WHERE event_indicator = 2) AS d2
      FROM followup GROUP BY ALL),
    risk AS (SELECT *, sum(leaving) OVER (PARTITION BY hospitalized ORDER BY t DESC) AS n FROM daily),
    km AS (SELECT *, product(1 - d / n) OVER (PARTITION BY hospitalized ORDER BY t) AS surv FROM risk),
    lagged AS (SELECT *, coalesce(lag(surv) OVER (PARTITION BY hospitalized ORDER BY t), 1.0) AS s0 FROM km),
    aj AS (SELECT hospitalized, t, sum(s0 * d1 / n) OVER w AS cif1, sum(s0 * d2 / n) OVER w AS cif2
      FROM lagged WINDOW w AS (PARTITION BY hospitalized ORDER BY t)),
    wide AS (SELECT hospitalized, u.t AS target_time, max(cif1) AS cif1, max(cif2) AS cif2 FROM aj,
      (SELECT unnest([400.0, 800.0, 1200.0, 1600.0]) AS t) u WHERE aj.t <= u.t GROUP BY ALL)
    SELECT hospitalized, CAST(target_time AS DOUBLE) AS target_time, 1 AS event, round(cif1, 4) AS risk FROM wide
    UNION ALL SELECT hospitalized, CAST(target_time AS DOUBLE), 2, round(cif2, 4) FROM wide""",
)
def _targeted_unadjusted(spark, sf):
    """Hazards half as high again as those observed, without covariates: targeting must lead back to Aalen-Johansen."""
    rows = fit_rows(spark, sf)
    period = H.grid_index("event_time", FIT_GRID)
    daily = rows.groupBy("hospitalized", period.alias("k"), "event_indicator").count().collect()
    curves = {}
    for arm in (False, True):
        own = [[sum(r["count"] for r in daily if (r.hospitalized, r.k, r.event_indicator) == (arm, k, e)) for e in (0, 1, 2)] for k in range(len(FIT_GRID))]
        at_risk = [sum(map(sum, own[k:])) for k in range(len(own))]
        for e in (1, 2):
            curves[H.haz_name(e, int(arm))] = [min(1.5 * c[e] / max(n, 1), 0.45) for c, n in zip(own, at_risk)]
        stay, cens = 1.0, []
        for (c0, c1, c2), n in zip(own, at_risk):
            stay *= 1 - c0 / (n - c1 - c2) if n > c1 + c2 else 1.0
            cens.append(stay)
        curves[H.cens_name(int(arm))] = cens
    arrays = [F.array(*[F.lit(float(v)) for v in curves[c]]).alias(c) for c in H.curve_columns((1, 2))]
    time = F.element_at(F.array(*[F.lit(t) for t in FIT_GRID]), period + 1).alias("event_time")
    crossed_rows = rows.select("person_id", "hospitalized", time, "event_indicator", *arrays)
    share = rows.agg(F.avg(F.col("hospitalized").cast("double"))).first()[0]
    data = rows.select("person_id", F.lit(share).alias("p"))
    target = T.Target("person_id", "hospitalized", "event_indicator", "p", FIT_GRID, UNADJUSTED_TIMES, bound=1e-6)
    frame = cut(T.targeting_frame(crossed_rows, data, target, "event_time"), "unadjusted")
    done = T.tmle_update(frame, target, tolerance=1e-7)
    table = [
        (bool(arm), t, cause, round(float(done.score.risk[arm, k, j]), 4))
        for arm in (0, 1) for k, cause in enumerate((1, 2)) for j, t in enumerate(UNADJUSTED_TIMES)
    ]
    return spark.createDataFrame(table, "hospitalized boolean, target_time double, event int, risk double")


@query("tmle_estimates", "M17 M18 M16 M15")
def _tmle(spark, sf):
    curves = crossed(spark, sf)
    rows = fit_rows(spark, sf)
    data = Q.propensity_scores(rows, "person_id", "hospitalized", COVARIATES, SEED, learner="logistic")
    target = T.Target(
        "person_id", "hospitalized", "event_indicator", "propensity_score", FIT_GRID, STEP_TARGETS
    )
    frame = cut(T.targeting_frame(curves, data, target, "event_time"), "targeting")
    done = T.tmle_update(frame, target, max_updates=20)
    return T.all_estimates(done.frame, frame, target)
