"""Reproducible pseudo-random draws that any SQL engine can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 15
HASH_BITS = 4 * HEX_DIGITS
CELL_BITS = 12


def stable_hash(seed: int | str, *parts: Column | str) -> Column:
    """60-bit hash of ``seed:part:part`` from the leading hex digits of md5."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("bigint")


def hash_cell(hashed: Column, bits: int = CELL_BITS) -> Column:
    """Leading bits of a stable hash: an evenly filled, order-preserving cell number."""
    return F.shiftright(hashed, HASH_BITS - bits)
