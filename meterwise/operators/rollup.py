"""Usage rollups (per object, per user/model/month, per model) and spend."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterwise.config import MeterConfig
from meterwise.functions import budget, pricing
from meterwise.functions.pricing import TOKEN_COLS

USAGE_KEYS = ("user", "model_id", "month")
COUNTER_COLS = (*TOKEN_COLS, "total_tokens", "invocations")


def _token_sums(prefix: str = "") -> list:
    return [F.sum(f"{prefix}{c}").cast("bigint").alias(c) for c in TOKEN_COLS]


def total_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("total_tokens", sum((F.col(c) for c in TOKEN_COLS[1:]), F.col(TOKEN_COLS[0])))


def object_rollup(inv: DataFrame, object_col: str = "object_key") -> DataFrame:
    """A1: per (object, user, model, month) partial sums and invocation count."""
    g = inv.groupBy(object_col, *USAGE_KEYS).agg(*_token_sums(), F.count(F.lit(1)).alias("invocations"))
    return total_tokens(g)


def usage_rollup(inv: DataFrame) -> DataFrame:
    """A2: the stored usage row per (user, model_id, month).

    Catalyst plans a partial HashAggregate before the shuffle, so each
    executor ships one row per key it saw, not one per invocation.
    ``last_ts`` is the latest event time in the cell.
    """
    g = inv.groupBy(*USAGE_KEYS).agg(*_token_sums(), F.count(F.lit(1)).alias("invocations"),
                                     F.max("ts").alias("last_ts"))
    return total_tokens(g)


def merge_usage(partials: DataFrame) -> DataFrame:
    """Sum usage partials (ledger rows, object rollups) to usage rows."""
    g = partials.groupBy(*USAGE_KEYS).agg(*_token_sums(),
                                         F.sum("invocations").cast("bigint").alias("invocations"),
                                         F.max("last_ts").alias("last_ts"))
    return total_tokens(g)


def priced_usage(usage: DataFrame, cfg: MeterConfig) -> DataFrame:
    """Usage rows with exact decimal ``cost``."""
    return pricing.with_cost(usage, cfg)


def model_totals(usage: DataFrame, cfg: MeterConfig) -> DataFrame:
    """A3: five measures and cost per model over the input."""
    g = usage.groupBy("model_id").agg(*_token_sums(), F.sum("invocations").cast("bigint").alias("invocations"))
    g = total_tokens(g)
    return pricing.with_cost(g, cfg)


def user_month_spend(priced: DataFrame, cfg: MeterConfig) -> DataFrame:
    """A6 + P11 + P12: each user's month cost across all models and status."""
    g = priced.groupBy("user", "month").agg(F.sum("cost").alias("cost"))
    return g.select(
        "user", "month", "cost",
        pricing.usd(F.col("cost")).alias("cost_usd"),
        budget.pct_of_budget(pricing.usd(F.col("cost")), cfg).alias("pct_of_budget"),
        budget.status(F.col("cost"), cfg).alias("status"))
