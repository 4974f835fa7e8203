"""Broadcasts behind a check of the side's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest side, in counted rows times an estimated row width, that is broadcast.
BROADCAST_BYTES = 48 << 20


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows times row_bytes stay under limit; otherwise df itself, for a shuffle join that adaptive execution splits where skewed."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
