"""The scheduled rollup as a Spark batch job (ST1-ST5, ST10, J1, S4).

A file stream lists its whole folder on every trigger; at hundreds of
millions of objects that listing is the bottleneck. The scheduled form
lists only the hour prefixes of the scan window, the way the metered system
does, and remembers processed objects in a marker table:

    cutoff  = greatest(least(checkpoint, now - look-back), now - max look-back)
    objects = region x hour prefixes in [floor(cutoff), floor(now)], modified >= cutoff
              de-duplicated, minus markers (only marker partitions younger than the TTL are read)
    markers += objects, claimed by run_id (partitioned by day, for TTL expiry by partition)
    process_batch(objects, run_id)      -- ledger / alerts / metrics, own run_id partitions

Objects are claimed before they are read. A run that fails at any step and is
repeated with the same ``run_id`` takes what that id has claimed, whatever the
window then is, plus new objects, and overwrites its own partitions: nothing is
counted twice and nothing is lost. Listing, anti-join and claims stay in Spark:
no object name comes to the driver, and none is used as a pattern. The claimed
objects' hour folders (a bounded list) are listed, the reader skips what was
modified outside the claims' times, and the claims pick their rows; a claimed
object that does not arrive fails the run before anything is written. Damaged
objects are counted, marked and do not stop the run.

Names that begin with "_" or "." are hidden from Spark's readers and never listed.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterwise.config import MeterConfig
from meterwise.session import glob_exists
from meterwise.sources import log_scan, record_stream
from meterwise.streaming.rollup_stream import Directory, StreamPaths, process_batch

MARKER_SCHEMA = "path string, modified timestamp, run_id long, processed_at timestamp, day date"


def cutoff_for(now: datetime, checkpoint: datetime | None, cfg: MeterConfig) -> datetime:
    """S5 / ST10 on the driver (one value per run)."""
    lb = now - timedelta(minutes=cfg.lookback_minutes)
    if checkpoint is None:
        return lb
    return max(min(checkpoint, lb), now - timedelta(minutes=cfg.max_lookback_minutes))


def run_scheduled_rollup(spark: SparkSession, layout: log_scan.LogLayout, paths: StreamPaths, markers_path: str,
                         cfg: MeterConfig, run_id: int, now: datetime, checkpoint: datetime | None = None,
                         regions: list[str] | None = None, start_ts: datetime | None = None,
                         robust: bool = True, directory: Directory | None = None, by_record: bool = False) -> dict:
    """One scheduled run. ``start_ts`` (a first run or a deliberate
    catch-up) replaces the look-back rule for the cut-off. ``by_record`` reads
    objects of any size record by record; a damaged archive then stops the
    run before anything is written, whatever ``robust`` says."""
    cutoff = start_ts if start_ts is not None else cutoff_for(now, checkpoint, cfg)
    hours = log_scan.hour_prefixes(cutoff, now)
    found = log_scan.list_objects(spark, log_scan.load_paths(layout, regions, hours))
    fresh = (found.where(F.col("modified") >= F.lit(cutoff))
             .groupBy("path").agg(F.max("modified").alias("modified")))
    since = (now - timedelta(days=cfg.marker_ttl_days)).date()

    def markers() -> DataFrame:
        return spark.read.schema(MARKER_SCHEMA).parquet(markers_path).where(F.col("day") >= F.lit(since))

    if glob_exists(spark, f"{markers_path}/day=*"):
        fresh = fresh.join(markers().select("path"), "path", "left_anti")
    (fresh.select("path", "modified", F.lit(run_id).cast("long").alias("run_id"),
                  F.lit(now).cast("timestamp").alias("processed_at"), F.lit(now.date()).alias("day"))
          .write.mode("append").partitionBy("day").parquet(markers_path))
    claimed = (markers().where(F.col("run_id") == run_id).groupBy("path").agg(F.max("modified").alias("modified")))
    span = claimed.agg(F.min("modified").alias("a"), F.max("modified").alias("b"), F.count(F.lit(1)).alias("n")).first()
    summary = {"run_id": run_id, "cutoff": cutoff.isoformat(), "hours": len(hours), "objects_processed": span["n"],
               "objects_unreadable": 0}
    if not span["n"]:
        return summary
    # hours x regions of one window (and of an earlier attempt of this run)
    folders = [log_scan.literal(r[0]) for r in claimed.select(log_scan.hour_folder(F.col("path"))).distinct().collect()]
    read = record_stream.scan_records if by_record else log_scan.scan_files_robust
    files = read(spark, folders, span["a"], span["b"])
    counts = process_batch(files, run_id, paths, cfg, directory=directory, claimed=claimed, strict=not robust)
    return summary | {k: v for k, v in counts.items() if k != "objects_processed"}
