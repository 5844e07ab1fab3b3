"""The event path (S7, ST7): subscription envelopes as a stream into the rollup's tables.

Envelopes can be delivered more than once and late. Each log event has an id;
the ids of counted events are kept in a table by event day and batch, and a
batch leaves out events whose id an earlier batch has. Only the days of the
batch's own events are looked up, so the look-up does not grow with the age of
the table, and no event is dropped for being late. A batch that runs again
overwrites its own rows everywhere. Damaged payloads, bad messages and records
of another type are counted in the run table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterwise.config import MeterConfig
from meterwise.session import child_names, fresh_path, written
from meterwise.sources import subscription
from meterwise.streaming.rollup_stream import StreamPaths, run_counts, settle, staged

SEEN_SCHEMA = "log_event_id string, day date, batch_id bigint"


def unseen(events: DataFrame, seen: str, batch_id: int) -> DataFrame:
    """``events`` (a written table), each id once, without those of earlier batches; events without an id all stay."""
    spark = events.sparkSession
    known = events.where(F.col("log_event_id").isNotNull())
    once = known.dropDuplicates(["log_event_id"])
    if child_names(spark, seen):
        days = [r[0] for r in known.select("day").distinct().collect()]  # the days of one batch's events
        before = spark.read.schema(SEEN_SCHEMA).parquet(seen).where(F.col("day").isin(days) & (F.col("batch_id") < batch_id))
        once = once.join(before.select("log_event_id"), "log_event_id", "left_anti")
    return once.unionByName(events.where(F.col("log_event_id").isNull()))


def process_envelopes(batch: DataFrame, batch_id: int, paths: StreamPaths, seen: str, cfg: MeterConfig) -> dict:
    """One batch of envelopes: counters, alerts, metrics and counts, as for log objects."""
    spark = batch.sparkSession

    events = subscription.decode_envelopes(batch)
    day = F.coalesce(F.timestamp_millis("event_ms"), F.timestamp_seconds(F.lit(0))).cast("date")
    events = written(events.withColumn("day", day), fresh_path(spark, "events"))
    new = written(unseen(events, seen, batch_id), fresh_path(spark, "events"))
    rows = staged(subscription.event_rows(new, cfg.month_zone), batch_id, paths)
    counts = run_counts(rows).first().asDict()
    settle(rows, counts, batch_id, paths, cfg)
    (new.where(F.col("log_event_id").isNotNull())
        .select("log_event_id", "day", F.lit(int(batch_id)).cast("bigint").alias("batch_id"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(seen))
    return counts


def run_event_stream(spark: SparkSession, folder: str, paths: StreamPaths, seen: str, cfg: MeterConfig,
                     max_files_per_trigger: int = 1000, available_now: bool = True, processing_time: str | None = None):
    """Start the stream over parquet files of envelopes (``region``, ``data``); token alerts are on."""
    cfg = cfg.with_(token_alerts=True)
    schema = "region string, block bigint, data string"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder)
    w = (src.writeStream.foreachBatch(lambda df, b: process_envelopes(df, b, paths, seen, cfg) and None)
            .option("checkpointLocation", paths.checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or cfg.schedule)
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
