"""Job entry points (``spark-submit -m``-style CLI and Python API).

    python -m meterwise.jobs rollup  --logs ROOT --account ACCT --work DIR [--regions auto] [--now ISO]
    python -m meterwise.jobs stream  --logs ROOT --account ACCT --work DIR [--trigger '5 minutes']
    python -m meterwise.jobs events  --envelopes DIR --work DIR [--trigger '5 minutes']
    python -m meterwise.jobs report  --work DIR --month YYYY-MM --out DIR [--user REGEX --model M --status S --min-spend X]

``rollup`` and ``stream`` enforce when enforcement is configured and ``--directory`` names a folder with the
parquet tables ``users``, ``groups`` and ``memberships``; ``report`` writes every dashboard dataset.
All of them send their alerts and notices to the table ``outbox`` of the work folder, each once.

``rollup`` is one scheduled run: it reads the high-water mark (the previous
run's time, ST2) and the next run id from the run log in the work folder,
runs :func:`meterwise.streaming.scheduled.run_scheduled_rollup`, and appends
its own entry. The run log is written only after the run's tables, so a
failed run is simply repeated with the same run id.
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import SparkSession, functions as F

from meterwise.config import STATUS_BREACH, MeterConfig, price_entries_from_json
from meterwise.operators import leaderboard, rollup
from meterwise.operators.dashboard import DashboardFilters, DashboardViews
from meterwise.session import glob_exists
from meterwise.sources import ledger, log_scan
from meterwise.sources.raw_records import LOG_DIR
from meterwise.streaming import event_stream, outbox, scheduled
from meterwise.streaming.rollup_stream import Directory, StreamPaths, run_rollup_stream

RUN_LOG_SCHEMA = "run_id long, now timestamp, cutoff string, objects long"


def _layout(logs_root: str, account: str) -> log_scan.LogLayout:
    return log_scan.LogLayout(f"{logs_root.rstrip('/')}/{LOG_DIR.format(account=account)}")


def last_run(spark: SparkSession, work: str) -> tuple[int, datetime | None]:
    """(next run id, previous run time) from the run log."""
    if not glob_exists(spark, f"{work}/run_log/*.parquet"):
        return 1, None
    r = spark.read.schema(RUN_LOG_SCHEMA).parquet(f"{work}/run_log").agg(
        F.max("run_id").alias("id"), F.max("now").alias("now")).collect()[0]
    return (int(r["id"] or 0) + 1), r["now"]


def rollup_run(spark: SparkSession, logs_root: str, account: str, work: str, cfg: MeterConfig,
               regions: list[str] | None = None, now: datetime | None = None,
               start_ts: datetime | None = None, robust: bool = True,
               directory: Directory | None = None, by_record: bool = False) -> dict:
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    run_id, checkpoint = last_run(spark, work)
    summary = scheduled.run_scheduled_rollup(
        spark, _layout(logs_root, account), StreamPaths.under(work, with_outbox=True), f"{work}/markers", cfg, run_id,
        now=now, checkpoint=checkpoint, regions=regions, start_ts=start_ts, robust=robust,
        directory=directory, by_record=by_record)
    (spark.createDataFrame([(run_id, now, summary["cutoff"], summary["objects_processed"])], RUN_LOG_SCHEMA)
          .coalesce(1).write.mode("append").parquet(f"{work}/run_log"))
    return summary


def read_directory(spark: SparkSession, folder: str | None) -> Directory | None:
    """The directory tables below ``folder`` (none without one)."""
    if not folder:
        return None
    return Directory(*[spark.read.parquet(f"{folder}/{t}") for t in ("users", "groups", "memberships")])


def report(spark: SparkSession, work: str, month: str, out: str, cfg: MeterConfig,
           filters: DashboardFilters | None = None, actor: str = "report") -> None:
    """Reader: every dashboard dataset of a month from the ledger (the month
    filter prunes ledger partitions), one folder each below ``out``.

    The leaderboards take all usage of the month; the rest goes through
    ``filters``. ``usage_notices`` has a notice for each user over budget; those
    that tell something new go to the outbox.
    """
    priced = rollup.priced_usage(ledger.read_usage(spark, f"{work}/ledger", month), cfg)
    views = DashboardViews(priced, cfg, filters)
    users = views.users()
    tables = {
        "leaderboard": leaderboard.spend_leaderboard(priced, cfg, month),
        "model_leaderboard": leaderboard.model_leaderboard(priced, cfg, month),
        "detail": views.filtered, "users": users, "kpis": views.kpis(), "top_users": views.top_users(),
        "top_models": views.top_models(), "heatmap": views.heatmap(), "histogram": views.histogram(),
        "usage_notices": views.notices(users.where(F.col("status") == STATUS_BREACH), actor),
    }
    try:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{out}/{name}")
        views.export_csv(f"{out}/users_csv")
        written = spark.read.parquet(f"{out}/usage_notices")
        outbox.send([outbox.usage_notices(written)], f"{work}/outbox", "report")
    finally:
        views.close()


# Options of the configuration: flag, field, how its text is read.
_COUNT, _MONEY, _TEXT, _LIST = int, Decimal, str, lambda v: tuple(x.strip() for x in v.split(",") if x.strip())
OPTIONS = (
    ("--budget", "budget_usd", _MONEY), ("--warn-ratio", "warn_ratio", _MONEY),
    ("--cache-write-multiplier", "cache_write_multiplier", _MONEY), ("--cache-read-multiplier", "cache_read_multiplier", _MONEY),
    ("--lookback-minutes", "lookback_minutes", _COUNT), ("--max-lookback-minutes", "max_lookback_minutes", _COUNT),
    ("--marker-ttl-days", "marker_ttl_days", _COUNT), ("--audit-ttl-days", "audit_ttl_days", _COUNT),
    ("--token-threshold", "token_threshold", _COUNT), ("--top-n", "top_n", _COUNT),
    ("--identity-store", "identity_store_id", _TEXT), ("--group-ids", "group_ids", _LIST), ("--group-names", "group_names", _LIST),
    ("--allow-list", "allow_list", _LIST), ("--renotify-hours", "renotify_hours", _COUNT), ("--throttle", "throttle", _TEXT),
    ("--month-zone", "month_zone", _TEXT), ("--alert-label", "alert_label", _TEXT),
)


def _config(a) -> MeterConfig:
    given = {field: getattr(a, field) for _, field, _ in OPTIONS if getattr(a, field) is not None}
    given |= {"enforce_enabled": a.enforce, "enforce_dry_run": a.dry_run, "token_alerts": a.token_alerts}
    if a.pricing:
        given["prices"] = price_entries_from_json(a.pricing)
    return MeterConfig(**given)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="meterwise.jobs")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("rollup", "stream", "events", "report"):
        s = sub.add_parser(name)
        s.add_argument("--work", required=True)
        for flag, field, read in OPTIONS:
            s.add_argument(flag, dest=field, type=read, default=None)
        s.add_argument("--enforce", action=argparse.BooleanOptionalAction, default=False)
        s.add_argument("--dry-run", action=argparse.BooleanOptionalAction, default=True)
        s.add_argument("--token-alerts", action=argparse.BooleanOptionalAction, default=False)
        s.add_argument("--pricing", default=None, help="JSON {pattern: [in, out(, cw, cr)]}")
        if name in ("rollup", "stream"):
            s.add_argument("--logs", required=True)
            s.add_argument("--account", required=True)
            s.add_argument("--robust", action=argparse.BooleanOptionalAction, default=True,
                           help="count damaged objects and go on (default); otherwise they stop the run")
            s.add_argument("--directory", default=None, help="folder of the parquet tables users, groups, memberships")
        if name == "rollup":
            s.add_argument("--regions", default="auto")
            s.add_argument("--now", default=None)
            s.add_argument("--start", default=None)
            s.add_argument("--by-record", action=argparse.BooleanOptionalAction, default=False,
                           help="objects of any size, read record by record; a damaged archive stops the run")
        if name == "events":
            s.add_argument("--envelopes", required=True)
        if name in ("stream", "events"):
            s.add_argument("--trigger", default="5 minutes")
            s.add_argument("--max-files", type=int, default=1000)
        if name == "report":
            s.add_argument("--month", required=True)
            s.add_argument("--out", required=True)
            s.add_argument("--user", default="")
            s.add_argument("--model", action="append", default=[])
            s.add_argument("--status", action="append", default=[])
            s.add_argument("--min-spend", type=float, default=0.0)
            s.add_argument("--actor", default="report")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    cfg = _config(a)
    if a.cmd == "rollup":
        iso = lambda s: datetime.fromisoformat(s) if s else None
        print(json.dumps(rollup_run(spark, a.logs, a.account, a.work, cfg, log_scan.regions_to_scan(a.regions),
                                    iso(a.now), iso(a.start), a.robust, read_directory(spark, a.directory), a.by_record)))
    elif a.cmd == "stream":
        q = run_rollup_stream(spark, _layout(a.logs, a.account), StreamPaths.under(a.work, with_outbox=True), cfg,
                              max_files_per_trigger=a.max_files, available_now=False,
                              processing_time=a.trigger, robust=a.robust, directory=read_directory(spark, a.directory))
        q.awaitTermination()
    elif a.cmd == "events":
        event_stream.run_event_stream(spark, a.envelopes, StreamPaths.under(a.work, with_outbox=True), f"{a.work}/seen", cfg,
                                      max_files_per_trigger=a.max_files, available_now=False,
                                      processing_time=a.trigger).awaitTermination()
    else:
        report(spark, a.work, a.month, a.out, cfg,
               DashboardFilters(a.user, models=tuple(a.model), statuses=tuple(a.status), min_spend=a.min_spend), a.actor)


if __name__ == "__main__":
    main()
