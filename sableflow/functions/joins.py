"""Joins with a side whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = 20_000) -> DataFrame:
    """Join with `small` broadcast if it has at most max_rows rows (counted first), else as a plain join that AQE may split by skew."""
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
