"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast.
FEW_ROWS = 100_000


def if_small(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, and left to the optimiser beyond; the count stops there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
