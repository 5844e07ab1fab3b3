"""Scheduled micro-batch rollup as Structured Streaming (ST1-ST5, ST10,
S10-S13).

    readStream.text(log folder, wholetext) -> foreachBatch {
        decode -> staged narrow rows (the content is read once, here)
        staged rows -> per-batch partials -> ledger partition (month, batch_id)
        prev/new month spend of touched users from snapshot + partials -> alerts
        prev/new tokens of touched (user, model, month) -> token alerts, named by the event that crossed
        model totals of the batch -> metric rows; counts of the batch -> run table }

The file source's checkpointed log replaces the object markers (an object
is read once, late objects are still found); a restarted batch re-writes
its own ``batch_id`` partitions, so replays do not count twice. The month
fallback for records without a usable timestamp is the object's
modification month, never the wall clock, so a replay lands in the same
partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from meterwise.config import MeterConfig
from meterwise.functions import pricing
from meterwise.operators import alerts, enforcement, metrics, rollup
from meterwise.session import fresh_path, path_exists, prepare, read_folders, remove_folder, written
from meterwise.sources import ledger, log_scan, record_stream
from meterwise.streaming import outbox


# Schemas of the sink tables, so a sink with no rows yet still reads.
ALERTS_SCHEMA = ("level string, user string, month string, run bigint, prev_cost_usd double, "
                 "new_cost_usd double, boundary_usd double, subject string, body string, "
                 "attributes map<string,string>, batch_id bigint")
AUDIT_SCHEMA = (f"user string, mode string, detail struct<userId:string,removed:array<{enforcement.ENTRY}>,"
                f"dryrun:array<{enforcement.ENTRY}>,skipped:array<{enforcement.ENTRY}>,"
                f"errored:array<{enforcement.ENTRY}>,reason:string>, at timestamp, expire_at timestamp, "
                "month string, batch_id bigint")
NOTICES_SCHEMA = ("user string, month string, at timestamp, level string, subject string, body string, "
                  "attributes map<string,string>, batch_id bigint")
METRICS_SCHEMA = "dims string, name string, value double, batch_id bigint"
TOKEN_ALERTS_SCHEMA = ("level string, user string, model_id string, month string, record_id string, prev_total bigint, "
                       "new_total bigint, boundary bigint, subject string, body string, "
                       "attributes map<string,string>, batch_id bigint")
RUNS_SCHEMA = ("objects_seen bigint, objects_processed bigint, objects_unreadable bigint, malformed bigint, "
               "records_processed bigint, records_skipped bigint, users_touched bigint, regions string, batch_id bigint")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERTS_SCHEMA).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTICES_SCHEMA).parquet(path)


def read_token_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKEN_ALERTS_SCHEMA).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS_SCHEMA).parquet(path)


@dataclass(frozen=True)
class StreamPaths:
    ledger: str
    alerts: str
    metrics: str
    checkpoint: str
    audit: str = ""
    notices: str = ""
    token_alerts: str = ""
    runs: str = ""
    staged: str = ""
    outbox: str = ""

    @classmethod
    def under(cls, root: str, with_outbox: bool = False) -> "StreamPaths":
        return cls(f"{root}/ledger", f"{root}/alerts", f"{root}/metrics", f"{root}/_checkpoint", f"{root}/audit",
                   f"{root}/notices", f"{root}/token_alerts", f"{root}/runs", f"{root}/_staged",
                   f"{root}/outbox" if with_outbox else "")


@dataclass(frozen=True)
class Directory:
    """The directory tables that enforcement reads."""

    users: DataFrame
    groups: DataFrame
    memberships: DataFrame


def log_stream(spark: SparkSession, layout: log_scan.LogLayout, max_files_per_trigger: int = 1000,
               start_ts: datetime | None = None, robust: bool = False) -> DataFrame:
    """File stream of whole log objects with path and modification time.

    ``maxFilesPerTrigger`` bounds each micro-batch (the catch-up cap of
    ST10); ``start_ts`` drops objects modified before it (the 7-day cap) --
    the file source itself refuses ``modifiedAfter``.
    """
    reader = (prepare(spark).readStream.option("maxFilesPerTrigger", max_files_per_trigger)
              .option("recursiveFileLookup", "true"))
    if robust:
        # bytes + vectorised gunzip with raw-text fallback (see scan_files_robust)
        b = (reader.format("binaryFile")
                   .schema("path string, modificationTime timestamp, length long, content binary")
                   .load(layout.base)).select(
            "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
        src = b.mapInPandas(log_scan._decompress, "path string, modified timestamp, size long, text string, "
                                                  "read_error string")
    else:
        src = reader.text(layout.base, wholetext=True)
        src = src.select(F.col("_metadata.file_path").alias("path"),
                         F.col("_metadata.file_modification_time").alias("modified"),
                         F.col("_metadata.file_size").alias("size"),
                         F.col("value").alias("text"))
    if start_ts is not None:
        src = src.where(F.col("modified") >= F.lit(start_ts))
    return src


def _priced_partials(df: DataFrame, cfg: MeterConfig) -> DataFrame:
    return pricing.with_cost(df, cfg)


def _write_batch(df: DataFrame, path: str, batch_id: int, *parts: str) -> None:
    """Rows of a batch, in place of any the same batch wrote before.

    A table by batch alone gets them in the batch's folder: the batch id is then no
    constant of the compiled code, which would be compiled anew for each batch.
    """
    if not parts:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")
        return
    (df.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint")).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(*parts, "batch_id").parquet(path))


def decoded(batch: DataFrame, cfg: MeterConfig) -> DataFrame:
    """Narrow decoded rows of whole texts, or of the record texts of ``record_stream.scan_records``."""
    month = F.date_format(F.col("modified"), "yyyy-MM")
    if "record" in batch.columns:
        return record_stream.decoded_rows(batch, month, cfg.month_zone)
    if "read_error" not in batch.columns:
        batch = batch.withColumn("read_error", F.lit(None).cast("string"))
    return log_scan.decoded_rows(log_scan.with_path_parts(batch), month, cfg.month_zone)


def stage(batch: DataFrame, batch_id: int, paths: StreamPaths, cfg: MeterConfig, claimed: DataFrame | None = None) -> DataFrame:
    """The batch's decoded rows, written to the staging folder and read back. The batch has whole texts,
    the record texts of ``record_stream.scan_records``, or rows that are decoded already.

    The objects' content is read here and nowhere else; what follows reads a few
    narrow columns per record, and outlives lost executors. ``claimed`` (distinct
    paths) leaves out other objects; it meets the narrow rows, so no content is shuffled.
    """
    rows = batch if "counted" in batch.columns else decoded(batch, cfg)
    if claimed is not None:
        rows = rows.join(claimed.select("path"), "path")
    return staged(rows, batch_id, paths)


def staged(rows: DataFrame, batch_id: int, paths: StreamPaths) -> DataFrame:
    """Decoded rows, written in place of those staged before and read back with their ``batch_id``."""
    spark = rows.sparkSession
    base = paths.staged or fresh_path(spark, "staged")
    remove_folder(spark, base)
    folder = f"{base}/batch_id={int(batch_id)}"
    rows.write.parquet(folder)
    schema = T.StructType([*rows.schema, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).option("basePath", base).parquet(folder)


def run_counts(rows: DataFrame) -> DataFrame:
    """One row of counts of a batch's decoded rows."""
    item = F.col("counted")
    unread = F.col("first") & F.col("read_error").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    per_object = rows.groupBy("path", "region").agg(
        F.count_if(unread).alias("unread"), F.sum(F.when(F.col("first"), F.col("malformed"))).alias("malformed"),
        F.count_if(item).alias("records"), F.count_if(F.col("present") & ~item).alias("skipped"))
    users = rows.where(item).select(F.count_distinct("user")).scalar()
    return per_object.agg(
        F.count(F.lit(1)).alias("objects_seen"), F.count_if(F.col("unread") == 0).alias("objects_processed"),
        F.count_if(F.col("unread") > 0).alias("objects_unreadable"), zero(F.sum("malformed")).alias("malformed"),
        zero(F.sum("records")).alias("records_processed"), zero(F.sum("skipped")).alias("records_skipped"),
        zero(users).alias("users_touched"), F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"))


def process_batch(batch: DataFrame, batch_id: int, paths: StreamPaths, cfg: MeterConfig,
                  ledger_alerts: bool = True, directory: Directory | None = None,
                  claimed: DataFrame | None = None, strict: bool = False, small: bool = False) -> dict:
    """Ledger partials of a batch, then all that follows from them: alerts,
    enforcement (if configured, with a directory), metrics and the batch's counts, which it returns.

    With ``claimed``, every claimed object must arrive: if any is missing, nothing is written and the
    batch fails, to be run again. ``strict`` also fails on an unreadable object. ``small``: one of many small
    batches (see :func:`settle`).
    """
    rows = stage(batch, batch_id, paths, cfg, claimed)
    if claimed is None and not strict:  # nothing to check before the ledger is written
        return settle(rows, None, batch_id, paths, cfg, ledger_alerts, directory, small)
    counts = run_counts(rows).first().asDict()
    if claimed is not None and counts["objects_seen"] != (wanted := claimed.count()):
        raise RuntimeError(f"{wanted} objects are claimed, {counts['objects_seen']} were read")
    if strict and counts["objects_unreadable"]:
        raise RuntimeError(f"{counts['objects_unreadable']} objects cannot be read")
    return settle(rows, counts, batch_id, paths, cfg, ledger_alerts, directory, small)


def settle(rows: DataFrame, counts: dict | None, batch_id: int, paths: StreamPaths, cfg: MeterConfig,
           ledger_alerts: bool = True, directory: Directory | None = None, small: bool = False) -> dict:
    """Write all that follows from a batch's staged rows (of :func:`staged`), each table's partition of this batch.

    ``small`` batches come in their hundreds, with narrow rows that take little time beside their decoding: what
    follows is then evaluated without compiling it (see :func:`uncompiled`).

    Returns the batch's counts; None has them counted while the ledger is written, and the batch's months with
    them: all three read the staged rows alone. Once the ledger has the batch, the sink tables depend on it and not on each other, and their small jobs run
    side by side; a failure of one fails the batch when all have ended.
    """
    spark = rows.sparkSession
    inv = rows.where("counted")
    months = []
    ledger.forget_snapshots(spark, paths.ledger, batch_id)
    first = [lambda: ledger.write_partials(ledger.batch_partials(inv), paths.ledger),
             lambda: months.extend(r[0] for r in inv.select("month").distinct().collect())]
    if counts is None:
        counts = {}
        first.append(lambda: counts.update(run_counts(rows).first().asDict()))
    with uncompiled(spark) if small else nullcontext():
        _side_by_side(first)
        _follow(rows, months, counts, batch_id, paths, cfg, ledger_alerts, directory)
    return counts


def _follow(rows: DataFrame, months: list, counts: dict, batch_id: int, paths: StreamPaths, cfg: MeterConfig,
            ledger_alerts: bool, directory: Directory | None) -> None:
    """What follows from a batch's ledger partition."""
    spark, inv, to_send, sinks = rows.sparkSession, rows.where("counted"), [], []
    # what follows reads the few rows that were written, not a cached shuffle of many small partitions
    parts = ledger.read_batch(spark, paths.ledger, batch_id).where(_among("month", months))
    enforced = directory is not None and cfg.enforcement_configured()
    token_alerts = cfg.token_alerts and bool(paths.token_alerts)
    if ledger_alerts or enforced or token_alerts:
        before = _touched(ledger.month_partials(spark, paths.ledger, months, batch_id - 1), parts)
    if ledger_alerts or enforced:
        ba = _before_after(parts, before, cfg)
        if ledger_alerts:
            sinks.append(lambda: _write_batch(alerts.alert_rows(alerts.spend_alerts(ba, cfg), cfg), paths.alerts, batch_id))
        if enforced:
            sinks.append(lambda: _enforce(ba, rows, batch_id, paths, cfg, directory))
    if token_alerts:
        sinks.append(lambda: _write_batch(_token_alerts(inv, before, cfg), paths.token_alerts, batch_id))
    sinks.append(lambda: _write_batch(
        metrics.metric_rows(metrics.metrics_by_model(rollup.model_totals(parts, cfg))),
        paths.metrics, batch_id))
    if paths.runs:
        sinks.append(lambda: _write_batch(spark.createDataFrame([counts], RUNS_SCHEMA.rsplit(",", 1)[0]), paths.runs, batch_id))
    _side_by_side(sinks)
    if paths.outbox:
        if ledger_alerts:
            to_send.append(outbox.spend_notices(_own(spark, ALERTS_SCHEMA, paths.alerts, batch_id)))
        if enforced:
            to_send.append(outbox.enforcement_notices(_own(spark, NOTICES_SCHEMA, paths.notices, batch_id)))
        if token_alerts:
            to_send.append(outbox.token_notices(_own(spark, TOKEN_ALERTS_SCHEMA, paths.token_alerts, batch_id)))
        outbox.send(to_send, paths.outbox, "rollup", batch_id)
    ledger.write_snapshots(spark, paths.ledger, months, batch_id)


@contextmanager
def uncompiled(spark: SparkSession) -> Iterator[None]:
    """Expressions of this session are interpreted meanwhile.

    Spark keeps the last hundred classes it has compiled. The steps of one batch need more, so each batch would
    compile all of them again, the decoding among them, and none would live long enough to be made fast. Results
    are the same.
    """
    names = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _side_by_side(steps: list) -> None:
    """Run independent steps in a thread each (with this thread's job group); the first failure is raised at the end."""
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(step)) for step in steps]
    for step in running:
        step.result()


def _among(column: str, values: list) -> Column:
    """Whether the column has one of ``values``, null among them."""
    known = F.col(column).isin([v for v in values if v is not None])
    return known | F.col(column).isNull() if None in values else known


def _own(spark: SparkSession, schema: str, path: str, batch_id: int) -> DataFrame:
    """What a batch wrote to a table by batch; the folders of other batches are not listed."""
    return read_folders(spark, schema, path, [f"{path}/batch_id={int(batch_id)}"])


def _token_alerts(inv: DataFrame, before: DataFrame, cfg: MeterConfig) -> DataFrame:
    """ST7: token crossings of a batch, on top of the month totals before it."""
    return alerts.token_alert_rows(alerts.token_crossings_after(inv.withColumn("record_id", F.col("request_id")), before, cfg), cfg)


def _enforce(ba: DataFrame, rows: DataFrame, batch_id: int, paths: StreamPaths, cfg: MeterConfig,
             directory: Directory) -> None:
    """ST8 in the run: each touched user at or over budget gets a decision,
    an audit row and, unless throttled by the last earlier audit, a notice.

    The time of an audit is the latest modification time of the batch's
    objects, so a replayed batch writes the same rows.
    """
    spark = ba.sparkSession
    over = alerts.over_budget(ba.where(F.col("delta") > 0), cfg)
    dec = enforcement.decisions(enforcement.candidates(over, cfg), directory.users, directory.memberships,
                                enforcement.group_targets(directory.groups, cfg), cfg)
    dec = written(dec.withColumn("at", rows.select(F.max("modified")).scalar()),
                  f"{paths.staged}_decisions" if paths.staged else fresh_path(spark, "decisions"))
    prior = spark.createDataFrame([], AUDIT_SCHEMA)
    if path_exists(spark, paths.audit):
        prior = read_audit(spark, paths.audit).where(F.col("batch_id") < F.lit(int(batch_id)))
    due = enforcement.throttle_next(dec, enforcement.latest_audit(prior), cfg)
    _write_batch(enforcement.notices(due, cfg), paths.notices, batch_id)
    _write_batch(enforcement.audit_rows(dec, cfg), paths.audit, batch_id, "month")


def _touched(usage: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of those (user, month) that a batch's partials have."""
    return usage.join(parts.select("user", "month"), ["user", "month"], "left_semi")


def _before_after(parts: DataFrame, before: DataFrame, cfg: MeterConfig) -> DataFrame:
    """Month spend before and after a batch of the users it touched, from its partials and rows that sum to their usage
    ``before`` it. Cost is linear in a model's tokens, so rows of both are priced and summed in one shuffle."""
    zero = F.lit(0).cast("decimal(38,12)")
    cost = F.col("cost")
    now = _priced_partials(parts, cfg).select("user", "month", "batch_id", cost, cost.alias("added"))
    earlier = _priced_partials(before, cfg).select("user", "month", F.lit(None).cast("bigint").alias("batch_id"), cost,
                                                   zero.alias("added"))
    sums = now.unionByName(earlier).where(F.col("user").isNotNull() & F.col("month").isNotNull()).groupBy("user", "month").agg(
        F.max("batch_id").alias("run"), F.sum("added").alias("delta"), F.sum("cost").alias("new_cost"))
    return sums.withColumn("prev_cost", F.greatest(F.col("new_cost") - F.col("delta"), zero))


@dataclass(frozen=True)
class Queries:
    """The streaming queries of one run: the rollup, and the keyed-state alerts if they were asked for."""

    rollup: object
    alerts: object = None

    def all(self) -> list:
        return [q for q in (self.rollup, self.alerts) if q is not None]

    def awaitTermination(self) -> None:  # noqa: N802 (as Spark's own)
        """Until one query ends; its failure is raised, and the others stop."""
        try:
            while all(q.isActive for q in self.all()):
                for q in self.all():
                    q.awaitTermination(5)
            for q in self.all():
                if q.exception() is not None:
                    raise q.exception()
        finally:
            self.stop()

    def stop(self) -> None:
        for q in self.all():
            q.stop()


def run_rollup_stream(spark: SparkSession, layout: log_scan.LogLayout, paths: StreamPaths, cfg: MeterConfig,
                      max_files_per_trigger: int = 1000, start_ts: datetime | None = None,
                      available_now: bool = True, processing_time: str | None = None, robust: bool = False,
                      alerts_mode: str = "ledger", directory: Directory | None = None):
    """Start the rollup stream; with ``available_now`` it processes what is
    there in bounded batches and stops (tests, catch-up), otherwise it runs
    on ``processing_time`` (e.g. ``'5 minutes'``).

    ``alerts_mode='state'`` computes the dollar alerts in a second query
    with keyed state (:mod:`spend_state`) instead of re-reading the ledger
    in each batch; both write the same alert rows to ``paths.alerts``. The
    result then holds both queries.
    """
    alert_query = None
    if alerts_mode == "state":
        from meterwise.streaming import spend_state
        alert_query = spend_state.run_spend_alert_stream(spark, layout, paths.alerts, paths.checkpoint + "_alerts", cfg,
                                           max_files_per_trigger, start_ts, available_now, processing_time, robust,
                                           paths.outbox)
    src = decoded(log_stream(spark, layout, max_files_per_trigger, start_ts, robust), cfg)  # one plan for all batches
    ledger_alerts = alerts_mode == "ledger"
    w = (src.writeStream.foreachBatch(lambda df, bid: process_batch(df, bid, paths, cfg, ledger_alerts, directory, small=True))
            .option("checkpointLocation", paths.checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or cfg.schedule)
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q if alert_query is None else Queries(q, alert_query)
