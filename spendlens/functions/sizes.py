"""Broadcasts behind a check of the measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few short values each that a broadcast may have; a larger side is joined by a shuffle.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``most`` rows, else ``df`` itself."""
    return F.broadcast(df) if is_small(df, most) else df
