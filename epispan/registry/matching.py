"""Queries on propensity scores, matching and match diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispan.functions import stats
from epispan.operators import isotonic as I
from epispan.operators import matching as X
from epispan.operators import propensity as Q
from epispan.operators import summaries as M
from epispan.registry.base import query
from epispan.registry.sql import SEED
from epispan.registry.statistic import FOLLOWUP, followup
from epispan.session import cut

FEATURES = ("age", "c_acctbal", "c_nationkey", "early_balance")


def rows(spark, sf):
    """Follow-up rows with hospitalisation as exposure, a rough score, and a covariate with gaps."""
    base = followup(spark, sf)
    noise = (F.col("person_id") * 37) % 101 / 101
    p = F.col("c_acctbal") / 25000 + F.col("age") / 40000 + noise / 10
    return base.withColumns(
        {
            "early_balance": F.when(F.col("event_time") % 4 != 0, F.col("c_acctbal") / 2),
            "p_raw": p,
            "p_coarse": F.round(p, 2),
            "p_flat": F.lit(0.2) + F.col("c_nationkey") / 1000,
        }
    )


ROWS = f"""{FOLLOWUP},
rws AS (
  SELECT *, c_acctbal / 25000 + age / 40000 + ((person_id * 37) % 101 / 101) / 10 AS p_raw,
    round(c_acctbal / 25000 + age / 40000 + ((person_id * 37) % 101 / 101) / 10, 2) AS p_coarse,
    0.2::DOUBLE + c_nationkey / 1000 AS p_flat,
    CASE WHEN event_time % 4 <> 0 THEN c_acctbal / 2 END AS early_balance FROM followup)
"""


@query(
    "smaller_arm",
    "A29",
    f"""WITH {ROWS} SELECT count(*) FILTER (WHERE hospitalized) AS n_treated, count(*) FILTER (WHERE NOT hospitalized) AS n_control,
    CASE WHEN count(*) FILTER (WHERE hospitalized) < count(*) FILTER (WHERE NOT hospitalized) THEN 'treated' ELSE 'control' END AS minority FROM rws""",
)
def _arms(spark, sf):
    return X.smaller_arm(rows(spark, sf), "hospitalized")


@query(
    "class_weights",
    "A13",
    f"""WITH {ROWS} SELECT person_id, round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY hospitalized)), 8) AS weight FROM rws""",
)
def _weights(spark, sf):
    out = X.balanced_weights(rows(spark, sf), "hospitalized")
    return out.select("person_id", F.round("weight", 8).alias("weight"))


@query(
    "brier_score",
    "A14",
    f"""WITH {ROWS}, y AS (SELECT *, CASE WHEN hospitalized THEN 1.0 ELSE 0.0 END AS y FROM rws)
    SELECT round(avg((y - p_raw) ** 2), 8) AS p_raw, round(avg((y - p_coarse) ** 2), 8) AS p_coarse, round(avg((y - p_flat) ** 2), 8) AS p_flat FROM y""",
)
def _brier(spark, sf):
    names = ("p_raw", "p_coarse", "p_flat")
    out = Q.brier_scores(rows(spark, sf), "hospitalized", names)
    return out.select(*[F.round(c, 8).alias(c) for c in names])


@query(
    "pick_calibration",
    "M5 X4",
    f"""WITH {ROWS}, y AS (SELECT *, CASE WHEN hospitalized THEN 1.0 ELSE 0.0 END AS y FROM rws),
    b AS (SELECT avg((y - p_raw) ** 2) AS b1, avg((y - p_coarse) ** 2) AS b2, avg((y - p_flat) ** 2) AS b3 FROM y),
    s AS (SELECT person_id, CASE WHEN b1 <= b2 AND b1 <= b3 THEN p_raw WHEN b2 <= b3 THEN p_coarse ELSE p_flat END AS p FROM y, b),
    c AS (SELECT person_id, greatest(1e-6, least(1 - 1e-6, p)) AS p FROM s)
    SELECT person_id, round(p, 8) AS propensity_score, round(ln(p / ((1 - p) + 1e-15)), 8) AS propensity_logit FROM c""",
)
def _pick(spark, sf):
    _, out = Q.pick_calibration(rows(spark, sf), "hospitalized", ("p_raw", "p_coarse", "p_flat"))
    score = F.col("propensity_score")
    return out.select(
        "person_id",
        F.round(score, 8).alias("propensity_score"),
        F.round(stats.logit(score), 8).alias("propensity_logit"),
    )


@query(
    "rolling_rate",
    "W7 T4",
    f"""WITH {ROWS}, o AS (SELECT person_id, hospitalized, p_coarse AS score, CAST('0x' || substr(md5('0:tie:' || person_id), 1, 15) AS BIGINT) >> 52 AS tie, hospitalized AS y FROM rws),
    r AS (SELECT *, row_number() OVER (ORDER BY score, tie, person_id) - 1 AS position FROM o)
    SELECT person_id, position, CASE WHEN position >= 49 THEN round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END)
      OVER (ORDER BY position ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 8) END AS rate FROM r""",
)
def _rolling(spark, sf):
    out = X.rolling_rate(rows(spark, sf), "p_coarse", "hospitalized", "person_id")
    return out.select("person_id", "position", F.round("rate", 8).alias("rate"))


@query(
    "propensity_calibration_table",
    "M21",
    f"""WITH {ROWS}, o AS (SELECT person_id, p_raw, hospitalized, CAST('0x' || substr(md5('0:tie:' || person_id), 1, 15) AS BIGINT) >> 52 AS tie FROM rws),
    r AS (SELECT *, row_number() OVER (ORDER BY p_raw, tie, person_id) - 1 AS position, count(*) OVER () AS n FROM o)
    SELECT CAST(floor(position * 10 / n) AS INTEGER) AS bin, count(*) AS n, round(avg(p_raw), 8) AS predicted,
      round(avg(CASE WHEN hospitalized THEN 1.0 ELSE 0.0 END), 8) AS observed FROM r GROUP BY 1""",
)
def _calibration(spark, sf):
    out = X.calibration_table(rows(spark, sf), "p_raw", "hospitalized", "person_id")
    return out.withColumns({c: F.round(c, 8) for c in ("predicted", "observed")})


MATCHED = f"""RECURSIVE {ROWS},
rounds AS (
  SELECT 0 AS r, person_id AS id, hospitalized AS treated, p_coarse AS score, CAST(NULL AS BIGINT) AS partner,
    CAST('0x' || substr(md5('0:tie:' || person_id), 1, 15) AS BIGINT) >> 52 AS tie FROM rws
  UNION ALL
  (WITH available AS (SELECT * FROM rounds WHERE partner IS NULL),
     pairs AS (SELECT t.id AS ti, c.id AS ci, t.tie AS tt, c.tie AS ct, abs(t.score - c.score) AS d, least(t.score, c.score) AS lo
       FROM available t JOIN available c ON t.treated AND NOT c.treated AND abs(t.score - c.score) <= 0.025),
     best AS (SELECT ti, ci, row_number() OVER (PARTITION BY ti ORDER BY d, lo, ct, ci) AS rt,
       row_number() OVER (PARTITION BY ci ORDER BY d, lo, tt, ti) AS rc FROM pairs),
     hit AS (SELECT ti, ci FROM best WHERE rt = 1 AND rc = 1)
   SELECT a.r + 1, a.id, a.treated, a.score, coalesce(x.ci, y.ti), a.tie
   FROM available a LEFT JOIN hit x ON x.ti = a.id LEFT JOIN hit y ON y.ci = a.id WHERE EXISTS (SELECT 1 FROM hit))),
pairs AS (SELECT m.id AS treated_id, m.partner AS control_id, abs(m.score - c.p_coarse) AS distance
  FROM rounds m JOIN rws c ON c.person_id = m.partner WHERE m.treated AND m.partner IS NOT NULL)
"""


def pairs(spark, sf):
    return X.nearest_neighbor_match(rows(spark, sf), "person_id", "hospitalized", "p_coarse", 0.025)


@query(
    "nearest_neighbor_match",
    "J12",
    f"WITH {MATCHED} SELECT treated_id, control_id, round(distance, 8) AS distance FROM pairs",
)
def _match(spark, sf):
    return pairs(spark, sf).withColumn("distance", F.round("distance", 8))


@query(
    "match_filter",
    "J9 J10",
    f"""WITH {MATCHED} SELECT person_id, hospitalized, p_coarse FROM rws
    WHERE person_id IN (SELECT treated_id FROM pairs UNION ALL SELECT control_id FROM pairs)""",
)
def _filter(spark, sf):
    base = rows(spark, sf)
    kept = X.match_filter(base.select("person_id", "p_coarse"), pairs(spark, sf), "person_id")
    return kept.join(base.select("person_id", "hospitalized"), "person_id")


SMD_COLUMNS = ("age", "c_acctbal", "event_time")


def _smd_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS covariate, count({c}) FILTER (WHERE hospitalized) AS n_1, count({c}) FILTER (WHERE NOT hospitalized) AS n_0,
        round((avg({c}) FILTER (WHERE hospitalized) - avg({c}) FILTER (WHERE NOT hospitalized))
          / sqrt((var_samp({c}) FILTER (WHERE hospitalized) + var_samp({c}) FILTER (WHERE NOT hospitalized)) / 2), 8) AS smd FROM {source}"""
        for c in SMD_COLUMNS
    )


@query("standardized_differences", "A15", f"WITH {ROWS} {_smd_sql('rws')}")
def _smd(spark, sf):
    out = M.standardized_differences(rows(spark, sf), "hospitalized", SMD_COLUMNS)
    return out.withColumn("smd", F.round("smd", 8))


@query(
    "matched_differences",
    "A15 J9",
    f"""WITH {MATCHED}, kept AS (SELECT * FROM rws WHERE person_id IN (SELECT treated_id FROM pairs UNION ALL SELECT control_id FROM pairs))
    {_smd_sql("kept")}""",
)
def _smd_matched(spark, sf):
    kept = X.match_filter(rows(spark, sf), pairs(spark, sf), "person_id")
    out = M.standardized_differences(kept, "hospitalized", SMD_COLUMNS)
    return out.withColumn("smd", F.round("smd", 8))


@query(
    "match_balance_histogram",
    "A16",
    f"""WITH {MATCHED}, kept AS (SELECT hospitalized AS exposed, p_coarse AS x FROM rws
      WHERE person_id IN (SELECT treated_id FROM pairs UNION ALL SELECT control_id FROM pairs)),
    e AS (SELECT *, min(x) OVER () AS lo, (max(x) OVER () - min(x) OVER ()) / 20 AS width FROM kept),
    c AS (SELECT least(floor((x - lo) / width), 19) AS bin, count(*) FILTER (WHERE exposed) AS n1, count(*) FILTER (WHERE NOT exposed) AS n0 FROM e GROUP BY 1),
    g AS (SELECT DISTINCT lo, width, unnest(range(20)) AS bin FROM e)
    SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * width, 6) AS bin_start, coalesce(n1, 0) AS n_exposed, coalesce(n0, 0) AS n_control
    FROM g LEFT JOIN c ON c.bin = g.bin""",
)
def _balance(spark, sf):
    kept = X.match_filter(rows(spark, sf), pairs(spark, sf), "person_id")
    out = M.histogram(kept, F.col("p_coarse"), "hospitalized", bins=20)
    return out.withColumn("bin_start", F.round("bin_start", 6))


def feature_rows(spark, sf):
    """Follow-up rows cut to the shared folder, since model fits read them many times."""
    return cut(rows(spark, sf).select("person_id", "hospitalized", *FEATURES), "features")


@query("propensity_scores", "M1 J10 W11")
def _scores(spark, sf):
    return Q.propensity_scores(
        feature_rows(spark, sf), "person_id", "hospitalized", FEATURES, SEED, learner="logistic"
    )


@query("propensity_boosted", "M1")
def _boosted(spark, sf):
    return Q.propensity_scores(
        feature_rows(spark, sf), "person_id", "hospitalized", FEATURES, SEED,
        learner="gbt", maxIter=5, maxDepth=3, stepSize=0.1,
    )


@query("propensity_grid_search", "M2")
def _grid(spark, sf):
    data = Q.prepare(feature_rows(spark, sf), "hospitalized", FEATURES)
    numbered = data.frame.withColumn("_fold", Q.hash_fold("person_id", SEED, 3))
    points = Q.grid_search(
        data, numbered, "_fold", 3, depths=(2, 3), rates=(0.1,), iterations=(3,)
    )
    return spark.createDataFrame(
        [tuple(p.values()) for p in points],
        "max_depth int, learning_rate double, max_iter int, accuracy double",
    )


@query("calibrated_propensity", "M3 M4 M5")
def _calibrated(spark, sf):
    return Q.propensity_scores(
        feature_rows(spark, sf), "person_id", "hospitalized", FEATURES, SEED,
        learner="logistic", calibrate=True,
    )


@query(
    "isotonic_steps",
    "M3",
    f"""WITH {FOLLOWUP},
    s AS (SELECT CAST(round(c_acctbal / 250) AS DOUBLE) AS score, count(*) AS n, count(*) FILTER (WHERE hospitalized) AS y FROM followup GROUP BY ALL),
    c AS (SELECT *, row_number() OVER (ORDER BY score) AS i, sum(n) OVER (ORDER BY score) AS cn, sum(y) OVER (ORDER BY score) AS cy FROM s),
    runs AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.i <= b.i),
    lows AS (SELECT a, c.i, c.score, min(mean) AS low FROM runs JOIN c ON c.i BETWEEN a AND b GROUP BY ALL)
    SELECT score, round(max(low), 8) AS calibrated FROM lows GROUP BY score""",
)
def _isotonic(spark, sf):
    """Calibrated value of every score; the SQL takes the greatest, over starts, of the least mean of runs through the score."""
    frame = followup(spark, sf).select(F.round(F.col("c_acctbal") / 250).alias("score"), "hospitalized")
    steps = I.fit(frame, "score", "hospitalized", cell_scores=8)
    return frame.select("score").distinct().select("score", F.round(steps.value(F.col("score")), 8).alias("calibrated"))


@query("stacked_propensity", "M15")
def _stacked(spark, sf):
    small = {"forest": {"numTrees": 10}, "gbt": {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1}}
    return Q.stacked_propensity(
        feature_rows(spark, sf), "person_id", "hospitalized", FEATURES, SEED, settings=small
    )
