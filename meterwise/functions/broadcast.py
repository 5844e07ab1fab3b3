"""Broadcast only behind a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Parameter-bounded sides (top-N winners, allow-lists, price tables,
# enforcement targets) are broadcast up to this many rows; beyond it the
# join is left to AQE, which broadcasts from the *measured* size or keeps a
# shuffle join.
MAX_BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, row_bound: int) -> DataFrame:
    """``broadcast(df)`` when ``row_bound`` (a bound known from parameters,
    not from the data) is small enough; otherwise ``df`` unchanged."""
    return F.broadcast(df) if row_bound <= MAX_BROADCAST_ROWS else df
