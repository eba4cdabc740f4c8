"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def broadcast_if_small(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting that the frame has at most ``limit`` rows.

    Larger frames are returned as they are and joined by shuffle.
    """
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def require_rows(frame: DataFrame, message: str) -> DataFrame:
    """Raise when the frame is empty."""
    if frame.isEmpty():
        raise RuntimeError(message)
    return frame
