"""Joins with a side that does not grow with the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_bounded(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join with a side of at most one row per state, target or iteration: it is broadcast without counting.

    Any other side is joined plainly; the optimizer and adaptive execution choose by its measured bytes.
    """
    return rows.join(F.broadcast(side), list(keys), how)
