"""Look-back features by running sums, against a plain walk over every (key, code) pair."""

import datetime as dt
import random
import re

from epispan.operators import covariates as V

PATTERNS = {"heart": "I.*", "lung": "J4[45]"}
START = dt.date(2010, 1, 1)


def plain(codes, cohort, years):
    found = {}
    for experiment, person, index in cohort:
        own = [(c, d) for p, c, d in codes if p == person]
        if person is None or not own:
            continue
        dated = [(c, d) for c, d in own if d is not None and index is not None]
        past = [(c, d) for c, d in dated if d <= index]
        span = dt.timedelta(days=365 * years)
        count = sum(c is not None and d > index - span for c, d in past)
        flags = [any(c is not None and re.fullmatch(p, c) for c, _ in past) for p in PATTERNS.values()]
        last = max((d for _, d in past), default=None)
        found[experiment, person] = (count, *flags, None if last is None else (index - last).days)
    return found


def random_tables(seed, persons=12, per_person=25):
    draw = random.Random(seed)
    day = lambda: START + dt.timedelta(days=365 * draw.randrange(9) + draw.randrange(3))
    codes = [
        (draw.choice([None, *range(persons)]), draw.choice([None, "I10", "J44", "J46", "E11"]), None if draw.random() < 0.1 else day())
        for _ in range(persons * per_person)
    ]
    cohort = [(f"e{e}", p, None if draw.random() < 0.1 else day()) for e in range(4) for p in [*range(persons + 3), None]]
    return codes, cohort


def features(spark, codes, cohort, years):
    facts = spark.createDataFrame(codes, "person_id long, code string, code_date date")
    people = spark.createDataFrame(cohort, "experiment string, person_id long, index_date date")
    return V.code_features(
        facts, people, ["experiment", "person_id"], "person_id", PATTERNS, years=years, days_since_last=True
    )


def rows(frame):
    return {(r[0], r[1]): tuple(r)[2:] for r in frame.collect()}


def test_equals_a_plain_walk_with_ties_and_nulls(spark):
    for seed, years in ((1, 1), (2, 5)):
        codes, cohort = random_tables(seed)
        assert rows(features(spark, codes, cohort, years)) == plain(codes, cohort, years)


def test_empty_tables_give_no_rows(spark):
    codes, cohort = random_tables(3)
    assert rows(features(spark, [], cohort, 5)) == {}
    assert rows(features(spark, codes, [], 5)) == {}


def test_codes_never_meet_experiments(spark):
    plan = features(spark, *random_tables(4), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan
