"""Broadcast only what was counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_up_to(df: DataFrame, bound: int) -> int:
    """Number of rows of ``df``, counted no further than ``bound + 1``."""
    return df.limit(bound + 1).count()


def broadcast_if_small(df: DataFrame, bound: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``bound`` rows, else ``df`` as it is."""
    return F.broadcast(df) if rows_up_to(df, bound) <= bound else df
