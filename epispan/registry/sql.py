"""SQL fragments shared by the check queries: the surrogate tables and the cohort designs."""

from __future__ import annotations

from epispan.params import Experiment
from epispan.sources.surrogate import PARAMS

SEED = PARAMS.seed

PERSONS = """
ord AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice AS price,
         o_orderpriority AS prio, o_orderstatus AS st
  FROM orders),
firsts AS (
  SELECT o_custkey,
    min(d) FILTER (WHERE prio = '1-URGENT' AND st = 'F' AND d >= DATE '1998-01-01') AS date_first_positive,
    min(d) FILTER (WHERE prio = '1-URGENT' AND d >= DATE '1998-01-01') AS date_first_tested,
    min(d) FILTER (WHERE prio = '2-HIGH' AND st = 'P' AND d >= DATE '1998-01-01') AS date_first_diagnosis,
    min(d) FILTER (WHERE prio = '5-LOW' AND st = 'F') AS date_event_a,
    min(d) FILTER (WHERE prio = '5-LOW' AND st = 'O') AS date_event_b,
    min(d) FILTER (WHERE prio = '4-NOT SPECIFIED' AND st = 'F') AS date_event_c,
    max(d) FILTER (WHERE prio = '3-MEDIUM' AND st = 'P') AS death_date
  FROM ord GROUP BY o_custkey),
persons AS (
  SELECT c_custkey AS person_id,
    DATE '1921-01-01' + CAST((c_custkey * 7919) % 7300 AS INTEGER) AS birth_date,
    date_first_positive, date_first_diagnosis, date_first_tested,
    date_event_a, date_event_b, date_event_c, death_date,
    CASE WHEN c_nationkey % 5 = 0 THEN DATE '2001-03-31' ELSE DATE '2001-08-01' END AS censoring_global,
    c_mktsegment = 'MACHINERY' AS hospitalized
  FROM customer LEFT JOIN firsts ON o_custkey = c_custkey),
dated AS (
  SELECT *, least(date_first_positive, date_first_diagnosis) AS index_date,
    CAST(date_diff('day', birth_date, least(date_first_positive, date_first_diagnosis)) AS INTEGER) AS age_days
  FROM persons)
"""


def hashed(*parts: str) -> str:
    """The stable hash of ``seed:part:...`` where parts are SQL expressions."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in (f"'{SEED}'", *parts))
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def _date(value) -> str:
    return "CAST(NULL AS DATE)" if value is None else f"DATE '{value}'"


OUTCOME = """
  CASE WHEN censoring_date = least(censoring_date, event_date, death_date) THEN 0
       WHEN event_date = least(censoring_date, event_date, death_date) THEN 1 ELSE 2 END AS event_indicator,
  CAST(date_diff('day', index_date, least(censoring_date, event_date, death_date)) AS INTEGER) AS event_time
"""
VALID = """
  index_date < censoring_global AND (event_date IS NULL OR index_date < event_date)
  AND (death_date IS NULL OR index_date < death_date)
"""


def cohorts(experiments: list[Experiment]) -> str:
    """CTEs up to ``cohort``: the dated cohorts of the experiments."""
    rows = ",\n".join(
        "('{}', '{}', {}, {}, '{}', {})".format(
            e.name,
            e.endpoint,
            _date(PARAMS.wave(e.wave).first),
            _date(PARAMS.wave(e.wave).last),
            e.design,
            "NULL" if e.subset is None else f"'{e.subset}'",
        )
        for e in experiments
    )
    endpoint = """CASE endpoint WHEN 'a' THEN date_event_a WHEN 'b' THEN date_event_b
      WHEN 'c' THEN date_event_c ELSE least(date_event_a, date_event_b, date_event_c) END"""
    return f"""{PERSONS},
exps(experiment, endpoint, lo, hi, design, subset) AS (VALUES {rows}),
exposed0 AS (
  SELECT e.experiment, e.design, p.*, {endpoint} AS event_date, censoring_global AS censoring_date
  FROM dated p JOIN exps e ON p.index_date >= e.lo AND (e.hi IS NULL OR p.index_date <= e.hi)
  WHERE p.age_days >= {PARAMS.min_age}
    AND (CASE WHEN design = 'tested_positive_vs_negative' OR subset = 'tested'
                THEN coalesce(date_first_positive = index_date, false)
              WHEN subset = 'hospital' THEN hospitalized ELSE true END)),
exposed AS (SELECT *, {OUTCOME} FROM exposed0 WHERE {VALID}),
donors AS (
  SELECT experiment, index_date AS donor_date, age_days AS donor_age,
    row_number() OVER (PARTITION BY experiment ORDER BY {hashed("'donor'", "person_id")}, person_id) - 1 AS k,
    count(*) OVER (PARTITION BY experiment) AS n
  FROM exposed),
followed AS (
  SELECT experiment, event_time AS donor_time,
    row_number() OVER (PARTITION BY experiment ORDER BY {hashed("'donor'", "person_id")}, person_id) - 1 AS k,
    count(*) OVER (PARTITION BY experiment) AS n
  FROM exposed WHERE event_indicator = 0 AND design = 'prepandemic_control_fu'),
pool0 AS (
  SELECT e.experiment, e.design, p.* EXCLUDE (index_date, age_days), {endpoint} AS event_date
  FROM dated p, exps e
  WHERE p.index_date IS NULL AND (design <> 'tested_positive_vs_negative'
    OR (date_first_tested >= lo AND (hi IS NULL OR date_first_tested <= hi)))),
pool1 AS (
  SELECT q.*, CASE WHEN design = 'prepandemic_control_fu' THEN q.birth_date + donor_age ELSE donor_date END AS index_date
  FROM pool0 q JOIN donors dn ON dn.experiment = q.experiment AND dn.k = {hashed("'a'", "q.person_id")} % dn.n),
pool2 AS (
  SELECT * REPLACE (DATE '{PARAMS.historical_cutoff}' AS censoring_global), censoring_date0 AS censoring_date
  FROM (SELECT q.*, q.index_date + donor_time AS censoring_date0
        FROM pool1 q JOIN followed f ON f.experiment = q.experiment AND f.k = {hashed("'b'", "q.person_id")} % f.n
        WHERE design = 'prepandemic_control_fu')
  UNION ALL BY NAME
  SELECT *, censoring_global AS censoring_date FROM pool1 WHERE design <> 'prepandemic_control_fu'),
pool3 AS (
  SELECT * REPLACE (CASE WHEN censoring_global < censoring_date THEN censoring_global ELSE censoring_date END AS censoring_date)
  FROM pool2 WHERE {VALID}),
controls AS (
  SELECT *, CAST(date_diff('day', birth_date, index_date) AS INTEGER) AS age_days, {OUTCOME} FROM pool3),
cohort AS (
  SELECT experiment, person_id, true AS exposed, index_date, age_days / 365.25 AS age_at_index, event_time, event_indicator FROM exposed
  UNION ALL
  SELECT experiment, person_id, false, index_date, age_days / 365.25, event_time, event_indicator FROM controls)
"""


CODED = """
coded AS (
  SELECT o_custkey AS person_id, l_orderkey * 10 + l_linenumber AS pos,
    substr(p_type, 1, 1) || lpad(CAST(p_size AS VARCHAR), 2, '0') || substr(p_brand, 7, 1)
      || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'A' WHEN 2 THEN 'XD' ELSE 'XXS' END AS code,
    CAST(o_orderdate AS DATE) AS code_date, l_partkey AS drug_code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
atc_map AS (
  SELECT p_partkey AS medication_code,
    substr(p_type, 1, 1) || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'AB' || substr(p_brand, 7, 2) AS atc
  FROM part WHERE p_partkey % 10 <> 0)
"""

# long form of the wide longitudinal table
VISITS = """
yearly AS (
  SELECT o_custkey AS eid, CAST(year(o_orderdate) - 1995 AS INTEGER) AS visit,
    CAST(max(o_orderdate) AS DATE) AS visit_date, count(*) AS n,
    min(o_totalprice) AS lo, max(o_totalprice) AS hi
  FROM orders GROUP BY 1, 2),
long_values AS (
  SELECT eid, '101' AS field, visit, 0 AS arr, visit_date, hi AS value FROM yearly WHERE n > 1
  UNION ALL SELECT eid, '102', visit, 0, visit_date, lo FROM yearly
  UNION ALL SELECT eid, '102', visit, 1, visit_date, hi FROM yearly WHERE lo < 200000
  UNION ALL SELECT eid, '103', visit, 0, visit_date, CASE WHEN n = 1 THEN -1.0 ELSE CAST(n AS DOUBLE) END FROM yearly)
"""
