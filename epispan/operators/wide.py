"""Wide longitudinal tables with columns named ``<field>-<visit>.<array>``."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^(?P<field>.+?)-(?P<visit>\d+)\.(?P<arr>\d+)$")


def quoted(name: str) -> Column:
    """Column reference that allows dots in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def rename_fields(frame: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the field part of wide columns, e.g. ``31-0.0`` to ``sex-0.0``."""
    renamed = {}
    for name in frame.columns:
        field, dash, rest = name.partition("-")
        if dash and field in mapping:
            renamed[name] = f"{mapping[field]}-{rest}"
    return frame.withColumnsRenamed(renamed)


def select_by_regex(frame: DataFrame, pattern: str) -> DataFrame:
    """Keep the columns whose name matches the pattern somewhere."""
    return frame.select(*[quoted(c) for c in frame.columns if re.search(pattern, c)])


@dataclass(frozen=True)
class WideLayout:
    """Which columns of a wide table are static and which repeat over visits."""

    static: tuple[str, ...]
    repeated: tuple[tuple[str, str, int, int], ...]  # column, field, visit, array
    visit_dates: tuple[tuple[str, int], ...]  # column, visit

    @property
    def slots(self) -> list[tuple[str, int]]:
        """Distinct (field, array) pairs in column order."""
        return list(dict.fromkeys((field, arr) for _, field, _, arr in self.repeated))


def wide_layout(columns: Sequence[str], date_field: str = "visit_date") -> WideLayout:
    """Sort columns into static ones (a single instance) and repeated ones."""
    parsed = [(c, m["field"], int(m["visit"]), int(m["arr"])) for c in columns if (m := _NAME.match(c))]
    dates = tuple((c, visit) for c, field, visit, _ in parsed if field == date_field)
    values = [p for p in parsed if p[1] != date_field]
    instances: dict[str, int] = {}
    for _, field, _, _ in values:
        instances[field] = instances.get(field, 0) + 1
    return WideLayout(
        static=tuple(c for c, field, _, _ in values if instances[field] == 1),
        repeated=tuple(p for p in values if instances[p[1]] > 1),
        visit_dates=dates,
    )


def wide_to_long(frame: DataFrame, id_col: str, date_field: str = "visit_date") -> DataFrame:
    """Long form (id, field, visit, arr, visit_date, value) of the non-null repeated values.

    One narrow pass: every value meets its visit date inside the row, so nothing is shuffled.
    """
    layout = wide_layout(frame.columns, date_field)
    when = {visit: quoted(c) for c, visit in layout.visit_dates}
    cells = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"),
                F.lit(visit).alias("visit"),
                F.lit(arr).alias("arr"),
                when[visit].alias("visit_date"),
                quoted(column).alias("value"),
            )
            for column, field, visit, arr in layout.repeated
        ]
    )
    return frame.select(id_col, F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))


def static_values(columns: Sequence[str], date_field: str = "visit_date") -> list[Column]:
    """The static columns under their field names, as expressions."""
    return [quoted(c).alias(c.split("-")[0]) for c in wide_layout(columns, date_field).static]


def static_columns(frame: DataFrame, keys: Sequence[str], date_field: str = "visit_date") -> DataFrame:
    """The static columns under their field names."""
    return frame.select(*keys, *static_values(frame.columns, date_field))


def slot_name(field: str, arr: int) -> str:
    return field if arr == 0 else f"{field}.{arr}"


def asof_columns(columns: Sequence[str], index: str, date_field: str = "visit_date") -> list[Column]:
    """Latest value of every repeated field at the index date, as expressions on the wide row."""
    layout = wide_layout(columns, date_field)
    when = {visit: quoted(c) for c, visit in layout.visit_dates}
    picked = []
    for slot in layout.slots:
        versions = F.array(
            *[
                F.when(
                    (when[visit] <= F.col(index)) & quoted(column).isNotNull(),
                    F.struct(when[visit].alias("at"), F.lit(visit).alias("visit"), quoted(column).alias("value")),
                )
                for column, field, visit, arr in layout.repeated
                if (field, arr) == slot
            ]
        )
        picked.append(F.array_max(versions)["value"].alias(slot_name(*slot)))
    return picked


def asof_from_wide(
    frame: DataFrame, keys: Sequence[str], index: str, date_field: str = "visit_date"
) -> DataFrame:
    """Latest value of every repeated field at the index date, read inside the wide row.

    A visit counts when its date is not after the index; a value missing at the latest such visit
    is carried forward from the most recent earlier one.
    """
    return frame.select(*keys, *asof_columns(frame.columns, index, date_field))


def code_families_to_long(
    frame: DataFrame, id_col: str, families: Sequence[tuple[str, str]]
) -> DataFrame:
    """Long form (id, pos, code, code_date) of parallel code and date column families.

    The n-th column of a code family belongs to the n-th column of its date family; positions run
    on across the families.
    """
    pairs = []
    for codes, dates in families:
        code_columns = [c for c in frame.columns if re.match(rf"^{codes}(\D|$)", c)]
        date_columns = [c for c in frame.columns if re.match(rf"^{dates}(\D|$)", c)]
        pairs.extend(zip(code_columns, date_columns, strict=True))
    cells = F.array(
        *[
            F.struct(
                F.lit(pos).alias("pos"),
                quoted(code).alias("code"),
                quoted(date).cast("date").alias("code_date"),
            )
            for pos, (code, date) in enumerate(pairs)
        ]
    )
    return frame.select(id_col, F.inline(F.filter(cells, lambda c: c["code"].isNotNull())))
