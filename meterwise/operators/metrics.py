"""Metric datasets: per-model + total documents, the legacy four-way cube,
5-minute event-time series and the long ``metrics`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterwise.config import MeterConfig
from meterwise.functions import pricing
from meterwise.functions.pricing import TOKEN_COLS
from meterwise.operators.alerts import time_bucket

# Metric names of the emitted documents, in document order.
METRIC_NAMES = ("InputTokens", "OutputTokens", "CacheWriteTokens", "CacheReadTokens",
                "TotalTokens", "Invocations", "CostUSD")
_COUNTER_COLS = (*TOKEN_COLS, "total_tokens", "invocations")


def _measures():
    return [F.sum(c).cast("bigint").alias(c) for c in _COUNTER_COLS]


def metrics_by_model(model_totals: DataFrame) -> DataFrame:
    """A4: GROUPING SETS ((model_id), ()) over the run's model totals.

    Each model document carries its cost rounded half-even to 4 decimals;
    the grand total is the sum of those rounded values, as a metric service
    summing the documents would report.
    """
    m = model_totals.withColumn("cost4", F.bround(F.col("cost"), 4))
    g = m.rollup("model_id").agg(*_measures(), F.sum("cost4").alias("cost4"),
                                 F.grouping_id().alias("grouping_id"))
    return g.select("model_id", "grouping_id", *_COUNTER_COLS, pricing.usd(F.col("cost4")).alias("cost_usd"))


def metrics_cube(inv: DataFrame) -> DataFrame:
    """A5: CUBE(user, model_id) -- dimension sets [model], [user],
    [user, model], [] -- with six token/invocation measures. The per-event
    total is clamped at 0 for the metric (P13, legacy). Events are summed per
    (user, model) first, so the cube expands those rows, not the events."""
    d = inv.withColumn("total_tokens", F.greatest(sum((F.col(c) for c in TOKEN_COLS[1:]), F.col(TOKEN_COLS[0])),
                                                  F.lit(0).cast("bigint")))
    pairs = d.groupBy("user", "model_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in (*TOKEN_COLS, "total_tokens")],
        F.count(F.lit(1)).alias("invocations"))
    return pairs.cube("user", "model_id").agg(*_measures(), F.grouping_id().alias("grouping_id"))


def window_partials(inv: DataFrame, schedule: str) -> DataFrame:
    """Token sums per (5-minute event-time window, model); rows without a time: null window.

    Cost is linear in the tokens of a model, so it is computed from these sums.
    """
    total = sum((F.col(c) for c in TOKEN_COLS[1:]), F.col(TOKEN_COLS[0]))
    return inv.groupBy(time_bucket(F.col("ts"), schedule).alias("window_start"), "model_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in TOKEN_COLS], F.sum(total).cast("bigint").alias("total_tokens"),
        F.count(F.lit(1)).alias("invocations"), F.max("ts").alias("last_ts"))


def series_total(inv: DataFrame, cfg: MeterConfig) -> DataFrame:
    """Sums per 5-minute event-time window over all models (all five
    token series, invocations and cost)."""
    d = pricing.with_cost(window_partials(inv, cfg.schedule), cfg)
    return d.groupBy("window_start").agg(*_measures(), pricing.usd(F.sum("cost")).alias("cost_usd"))


def series_by_model(inv: DataFrame, cfg: MeterConfig) -> DataFrame:
    """Tokens, invocations and cost per model per 5-minute window."""
    d = pricing.with_cost(window_partials(inv, cfg.schedule), cfg)
    return d.select("window_start", "model_id", "total_tokens", "invocations",
                    pricing.usd(F.col("cost")).alias("cost_usd"))


def metric_rows(by_model: DataFrame) -> DataFrame:
    """Long ``(dims, name, value)`` rows from A4 via ``unpivot``."""
    dims = F.when(F.col("grouping_id") == 1, F.lit("")).otherwise(F.concat(F.lit("ModelId="), F.col("model_id")))
    cols = [F.col(c).cast("double").alias(n) for c, n in zip((*_COUNTER_COLS, "cost_usd"), METRIC_NAMES)]
    wide = by_model.select(dims.alias("dims"), *cols)
    return wide.unpivot(["dims"], list(METRIC_NAMES), "name", "value")
