"""Checks of size before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def broadcast_if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint where it has at most `most` rows; else Spark shuffles as it sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
