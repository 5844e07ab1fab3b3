"""Decimal literals, built once per Spark context.

Each ``lit(Decimal)`` is several JVM round trips; price chains and status
rules use dozens per query. The literal is made from its exact text and
cast (constant-folded by Catalyst), and reused for the context's lifetime.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

_CACHE: dict = {}
_OWNER: list = [None]  # the context whose columns _CACHE holds


def dec(value, dtype: str) -> Column:
    v = value if isinstance(value, Decimal) else Decimal(str(value))
    sc = SparkContext._active_spark_context
    if _OWNER[0] is not sc:
        _CACHE.clear()
        _OWNER[0] = sc
    key = (format(v, "f"), dtype)
    if key not in _CACHE:
        _CACHE[key] = F.lit(key[0]).cast(dtype)
    return _CACHE[key]
