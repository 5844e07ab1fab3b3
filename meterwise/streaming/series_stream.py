"""Late-data policy (ST5): event-time 5-minute series in a stream.

Each micro-batch appends its sums per (window, model) as its own partition,
and readers add them up. A watermark only says which windows are closed: a
record that arrives later still counts, and :func:`late_records` tells how
many did. The series is the same for any number of files per batch.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meterwise.config import MeterConfig
from meterwise.functions import pricing
from meterwise.functions.pricing import TOKEN_COLS
from meterwise.operators import metrics
from meterwise.sources import log_scan
from meterwise.streaming.rollup_stream import log_stream

PARTIALS_SCHEMA = ("window_start timestamp_ntz, model_id string, "
                   + ", ".join(f"{c} bigint" for c in (*TOKEN_COLS, "total_tokens", "invocations"))
                   + ", last_ts timestamp_ntz, batch_id bigint")


def write_series_batch(batch: DataFrame, batch_id: int, out_path: str, cfg: MeterConfig) -> None:
    """Sums of one micro-batch; a replayed batch replaces its own partition."""
    inv = log_scan.decode_invocations(batch, F.date_format(F.col("modified"), "yyyy-MM"), cfg.month_zone)
    parts = metrics.window_partials(inv, cfg.schedule).withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
    (parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("batch_id").parquet(out_path))


def run_series_stream(spark: SparkSession, layout: log_scan.LogLayout, out_path: str, checkpoint: str,
                      cfg: MeterConfig, max_files_per_trigger: int = 1000, start_ts: datetime | None = None):
    src = log_stream(spark, layout, max_files_per_trigger, start_ts)
    q = (src.writeStream.foreachBatch(lambda df, bid: write_series_batch(df, bid, out_path, cfg))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTIALS_SCHEMA).parquet(path)


def _window_end(cfg: MeterConfig):
    return F.col("window_start") + F.expr(f"INTERVAL {cfg.schedule}")


def read_series(spark: SparkSession, path: str, cfg: MeterConfig, watermark: str = "10 minutes") -> DataFrame:
    """One row per window; ``closed`` if its end is ``watermark`` behind the latest event."""
    parts = _partials(spark, path)
    latest = parts.select(F.max("last_ts")).scalar()
    d = pricing.with_cost(parts.groupBy("window_start", "model_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in (*TOKEN_COLS, "total_tokens", "invocations")]), cfg)
    s = d.groupBy("window_start").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in (*TOKEN_COLS, "total_tokens", "invocations")],
        pricing.usd(F.sum("cost")).alias("cost_usd"))
    return s.withColumn("closed", _window_end(cfg) <= latest - F.expr(f"INTERVAL {watermark}"))


def late_records(spark: SparkSession, path: str, cfg: MeterConfig, watermark: str = "10 minutes") -> DataFrame:
    """Records per batch that came after their window was closed by earlier
    batches. Depends on the batches by nature; the series does not."""
    parts = _partials(spark, path)
    heads = parts.groupBy("batch_id").agg(F.max("last_ts").alias("head"))      # one row per batch
    seen = F.max("head").over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1))
    late = F.col("window_end") <= F.col("seen") - F.expr(f"INTERVAL {watermark}")
    d = parts.withColumn("window_end", _window_end(cfg)).join(
        heads.select("batch_id", seen.alias("seen")), "batch_id")
    return d.groupBy("batch_id").agg(F.coalesce(F.sum(F.when(late, F.col("invocations"))), F.lit(0)).alias("late"))
