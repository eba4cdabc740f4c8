"""Column expressions on person dates: index, age, endpoint, event time, waves and subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from epispan.params import COMPOSITE, PersonColumns, Wave

DAYS_PER_YEAR = 365.25


def earliest(columns: Sequence[str | Column]) -> Column:
    """Earliest non-null date of several columns."""
    picked = [F.col(c) if isinstance(c, str) else c for c in columns]
    return picked[0] if len(picked) == 1 else F.least(*picked)


def index_date(cols: PersonColumns) -> Column:
    return earliest(cols.exposure_dates)


def age_days(index: str | Column, birth: str | Column) -> Column:
    return F.datediff(index, birth)


def age_years(days: str | Column, days_per_year: float = DAYS_PER_YEAR) -> Column:
    days = F.col(days) if isinstance(days, str) else days
    return days / F.lit(days_per_year)


def event_date(cols: PersonColumns, endpoint: str) -> Column:
    """Date of one endpoint, or the earliest of all for the composite endpoint."""
    mapping = cols.endpoint_map
    if endpoint == COMPOSITE:
        return earliest(list(mapping.values()))
    if endpoint not in mapping:
        raise ValueError(f"Unknown endpoint: {endpoint}")
    return F.col(mapping[endpoint])


def first_outcome_date(censoring: str, event: str, death: str) -> Column:
    return F.least(F.col(censoring), F.col(event), F.col(death))


def event_indicator(censoring: str, event: str, death: str) -> Column:
    """0 censored, 1 event, 2 death; ties go to the earlier of that order."""
    first = first_outcome_date(censoring, event, death)
    return F.when(F.col(censoring) == first, 0).when(F.col(event) == first, 1).otherwise(2)


def event_time(index: str, censoring: str, event: str, death: str) -> Column:
    return F.datediff(first_outcome_date(censoring, event, death), F.col(index))


def forced_censoring(censoring: str | Column, limit: str | Column) -> Column:
    """Bring a censoring date forward to the global limit when it lies beyond."""
    censoring = F.col(censoring) if isinstance(censoring, str) else censoring
    limit = F.col(limit) if isinstance(limit, str) else limit
    return F.when(limit < censoring, limit).otherwise(censoring)


def valid_dates(index: str, limit: str, event: str, death: str) -> Column:
    """Index strictly before the global limit, the event and the death date."""
    idx = F.col(index)
    return (
        (idx < F.col(limit))
        & (F.col(event).isNull() | (idx < F.col(event)))
        & (F.col(death).isNull() | (idx < F.col(death)))
    )


def in_wave(date: str | Column, wave: Wave) -> Column:
    date = F.col(date) if isinstance(date, str) else date
    inside = date >= F.lit(wave.first)
    return inside if wave.last is None else inside & (date <= F.lit(wave.last))


def in_subset(cols: PersonColumns, subset: str | None, index: str = "index_date") -> Column:
    """Membership in a subset; unknown flags count as not a member."""
    known = F.col(index).isNotNull()
    if subset is None:
        return known
    if subset == "hospital":
        return known & F.coalesce(F.col(cols.hospitalized), F.lit(False))
    if subset == "tested":
        return known & F.coalesce(F.col(cols.positive) == F.col(index), F.lit(False))
    raise ValueError(f"Unknown subset: {subset}")


def old_enough(days: str, min_age: float, unit: str) -> Column:
    if unit == "days":
        return F.col(days) >= F.lit(min_age)
    if unit == "years":
        return age_years(days) >= F.lit(min_age)
    raise ValueError(f"Unknown age unit: {unit}")


def birth_date_from_year(year: str | Column) -> Column:
    return F.make_date(F.col(year) if isinstance(year, str) else year, F.lit(1), F.lit(1))


def region_limit(sources: Sequence[str], overrides: Sequence[tuple[str, str]], default: str) -> Column:
    """Global censoring date by data source; the first matching override wins."""
    seen = F.array(*[F.col(s) for s in sources])
    picked = F.lit(default).cast("date")
    for label, date in reversed(list(overrides)):
        hit = F.coalesce(F.array_contains(seen, label), F.lit(False))
        picked = F.when(hit, F.lit(date).cast("date")).otherwise(picked)
    return picked
