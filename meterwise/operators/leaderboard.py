"""Reader leaderboards: top users by spend, top users per model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meterwise.config import MeterConfig
from meterwise.functions import budget, pricing


def month_usage(priced: DataFrame, month: str | None) -> DataFrame:
    """month equality; blank month means all months.

    On the month-partitioned ledger this filter becomes a partition filter.
    """
    if not month:
        return priced
    return priced.where(F.col("month") == F.lit(month))


def spend_leaderboard(priced: DataFrame, cfg: MeterConfig, month: str | None = None) -> DataFrame:
    """Top ``leaderboard_depth`` users by month spend.

    The global top-k plans as TakeOrderedAndProject (a per-partition heap and
    a k-row merge), so no full sort is shuffled. Ties break on the user.
    """
    d = month_usage(priced, month)
    g = d.groupBy("user").agg(F.sum("cost").alias("cost"),
                              F.sum("total_tokens").cast("bigint").alias("total_tokens"),
                              F.sum("invocations").cast("bigint").alias("invocations"))
    top = g.orderBy(F.col("cost").desc(), F.col("user").asc()).limit(cfg.leaderboard_depth)
    return top.select(
        "user",
        pricing.usd(F.col("cost")).alias("cost_usd"),
        budget.pct_of_budget(pricing.usd(F.col("cost")), cfg).alias("pct_of_budget"),
        budget.status(F.col("cost"), cfg).alias("status"),
        "total_tokens", "invocations")


def model_leaderboard(priced: DataFrame, cfg: MeterConfig, month: str | None = None) -> DataFrame:
    """Top ``per_model_depth`` usage rows per model by cost.

    ``row_number() <= k`` over the model partition lets Catalyst insert a
    WindowGroupLimit below the shuffle, so each task keeps only k rows per
    model before exchanging.
    """
    d = month_usage(priced, month)
    w = Window.partitionBy("model_id").orderBy(F.col("cost").desc(), F.col("user").asc())
    r = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.per_model_depth)
    return r.select("model_id", "rank", "user", "input_tokens", "output_tokens",
                    pricing.usd(F.col("cost")).alias("cost_usd"), "invocations")


def top_users_model_month(usage: DataFrame, n: int) -> DataFrame:
    """Top-n users by total tokens per (model, month) (the by-model-month index)."""
    w = Window.partitionBy("model_id", "month").orderBy(F.col("total_tokens").desc(), F.col("user").asc())
    r = usage.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return r.select("model_id", "month", "rank", "user", "total_tokens", "invocations")
