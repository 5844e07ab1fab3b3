"""Stream = batch, late objects, replay safety (ST1-ST5, E14, trap T6)."""

import gzip
import json
import os
import tempfile
from datetime import datetime


from meterwise.config import MeterConfig
from decimal import Decimal
from meterwise.sources import ledger, log_scan
from meterwise.sources.raw_records import LOG_DIR
from meterwise.streaming import rollup_stream as rs

CFG = MeterConfig(budget_usd=Decimal("0.01"), warn_ratio=Decimal("0.5"))


def _rec(user, model, ts, n):
    return {"timestamp": ts, "modelId": model, "identity": {"arn": f"arn:aws:sts::1:assumed-role/R/{user}"},
            "input": {"inputTokenCount": n, "cacheWriteInputTokenCount": n}, "output": {"outputTokenCount": n}}


def _write(base, region, hour, name, records):
    d = os.path.join(base, region, hour.strftime("%Y/%m/%d/%H"))
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "wb") as f:
        f.write(gzip.compress("\n".join(json.dumps(r) for r in records).encode()))


def _totals(spark, path):
    return {(r["user"], r["model_id"], r["month"]): (r["input_tokens"], r["invocations"])
            for r in ledger.read_usage(spark, path).collect()}


def test_stream_late_object_and_replay(spark):
    root = tempfile.mkdtemp(prefix="mw-stream-")
    base = f"{root}/logs/" + LOG_DIR.format(account="1")
    _write(base, "us-east-1", datetime(2024, 5, 1, 10), "a.json.gz",
           [_rec("alice", "x-opus", "2024-05-01T10:00:00Z", 1000), _rec("bob", "y", "2024-05-01T10:01:00Z", 10)])
    _write(base, "eu-west-1", datetime(2024, 5, 1, 11), "b.json.gz", [_rec("alice", "x-opus", "2024-05-01T11:00:00Z", 2000)])
    lay = log_scan.LogLayout(base)
    paths = rs.StreamPaths.under(f"{root}/run")
    rs.run_rollup_stream(spark, lay, paths, CFG, max_files_per_trigger=1)
    first = _totals(spark, paths.ledger)
    assert first == {("alice", "x-opus", "2024-05"): (3000, 2), ("bob", "y", "2024-05"): (10, 1)}
    # two single-file batches: alice crosses both boundaries in batch 0 (cost 0.03625 >= 0.01)
    al = rs.read_alerts(spark, paths.alerts)
    assert sorted((r["user"], r["level"], r["batch_id"]) for r in al.collect()) == [
        ("alice", "BREACH", 0), ("alice", "WARN", 0)]
    # rerun: nothing new
    rs.run_rollup_stream(spark, lay, paths, CFG, max_files_per_trigger=1)
    assert _totals(spark, paths.ledger) == first
    # a late object lands in an *older* hour directory: found once
    _write(base, "us-east-1", datetime(2024, 5, 1, 9), "late.json.gz", [_rec("carol", "y", "2024-05-01T09:59:00Z", 5)])
    rs.run_rollup_stream(spark, lay, paths, CFG, max_files_per_trigger=1)
    rs.run_rollup_stream(spark, lay, paths, CFG, max_files_per_trigger=1)
    after = _totals(spark, paths.ledger)
    assert after[("carol", "y", "2024-05")] == (5, 1)
    assert after[("alice", "x-opus", "2024-05")] == (3000, 2)


def test_batch_replay_overwrites_own_partition(spark):
    root = tempfile.mkdtemp(prefix="mw-replay-")
    base = f"{root}/logs/" + LOG_DIR.format(account="1")
    _write(base, "us-east-1", datetime(2024, 6, 2, 3), "a.json.gz",
           [_rec("dan", "x-opus", "2024-06-02T03:00:00Z", 700), _rec("dan", "x-opus", "2024-06-02T03:05:00Z", 800)])
    lay = log_scan.LogLayout(base)
    paths = rs.StreamPaths.under(f"{root}/run")
    files = log_scan.scan_files(spark, log_scan.load_paths(lay, None, None))
    rs.process_batch(files, 0, paths, CFG)
    once = _totals(spark, paths.ledger)
    rs.process_batch(files, 0, paths, CFG)        # the same batch replayed after a failure
    assert _totals(spark, paths.ledger) == once == {("dan", "x-opus", "2024-06"): (1500, 2)}
    assert rs.read_alerts(spark, paths.alerts).where("batch_id = 0").count() == 2


def test_keyed_state_alerts_equal_ledger_alerts(spark, sf):
    from meterwise.plans import catalog, fixtures as fx
    from meterwise.session import fresh_path
    from meterwise.streaming import spend_state
    lay = catalog.f2_layout(spark, sf)
    root = fresh_path(spark, "tests", "state")
    paths = rs.StreamPaths.under(f"{root}/ledger_run")
    rs.run_rollup_stream(spark, lay, paths, fx.F1_CFG, max_files_per_trigger=200)
    spend_state.run_spend_alert_stream(spark, lay, f"{root}/alerts", f"{root}/_ck", fx.F1_CFG, max_files_per_trigger=200)
    cols = ["user", "month", "level", "prev_cost_usd", "new_cost_usd", "boundary_usd", "subject", "body", "batch_id"]
    a = sorted(tuple(r) for r in rs.read_alerts(spark, paths.alerts).select(*cols).collect())
    b = sorted(tuple(r) for r in rs.read_alerts(spark, f"{root}/alerts").select(*cols).collect())
    assert a == b and len(a) > 0


def test_scheduled_rollup_overlapping_windows(spark):
    from meterwise.streaming import scheduled
    root = tempfile.mkdtemp(prefix="mw-sched-")
    base = f"{root}/logs/" + LOG_DIR.format(account="1")
    _write(base, "us-east-1", datetime(2024, 5, 1, 9), "a.json.gz", [_rec("alice", "x-opus", "2024-05-01T09:58:00Z", 1000)])
    _write(base, "us-east-1", datetime(2024, 5, 1, 10), "b.json.gz", [_rec("bob", "y", "2024-05-01T10:01:00Z", 10)])
    _write(base, "us-east-1", datetime(2024, 5, 1, 7), "old.json.gz", [_rec("old", "y", "2024-05-01T07:00:00Z", 1)])
    lay = log_scan.LogLayout(base)
    paths = rs.StreamPaths.under(f"{root}/run")
    markers = f"{root}/markers"
    r1 = scheduled.run_scheduled_rollup(spark, lay, paths, markers, CFG, 1, datetime(2024, 5, 1, 10, 5))
    assert r1["objects_processed"] == 2 and r1["hours"] == 2       # hour 7 is outside the window
    r2 = scheduled.run_scheduled_rollup(spark, lay, paths, markers, CFG, 2, datetime(2024, 5, 1, 10, 10),
                                        checkpoint=datetime(2024, 5, 1, 10, 5))
    assert r2["objects_processed"] == 0                              # overlap removed by markers
    _write(base, "us-east-1", datetime(2024, 5, 1, 10), "c.json.gz", [_rec("alice", "x-opus", "2024-05-01T10:09:00Z", 2000)])
    r3 = scheduled.run_scheduled_rollup(spark, lay, paths, markers, CFG, 3, datetime(2024, 5, 1, 10, 15),
                                        checkpoint=datetime(2024, 5, 1, 10, 10))
    assert r3["objects_processed"] == 1
    assert _totals(spark, paths.ledger) == {("alice", "x-opus", "2024-05"): (3000, 2), ("bob", "y", "2024-05"): (10, 1)}
    assert sorted((r["level"], r["batch_id"]) for r in rs.read_alerts(spark, paths.alerts).collect()) == [
        ("BREACH", 1), ("WARN", 1)]


def test_robust_stream_reads_plain_gz_named_object(spark):
    root = tempfile.mkdtemp(prefix="mw-robust-stream-")
    base = f"{root}/logs/" + LOG_DIR.format(account="1")
    _write(base, "us-east-1", datetime(2024, 5, 1, 10), "a.json.gz", [_rec("alice", "x-opus", "2024-05-01T10:00:00Z", 5)])
    d = os.path.join(base, "us-east-1", "2024/05/01/10")
    with open(os.path.join(d, "plain.json.gz"), "w") as f:
        f.write(json.dumps(_rec("bob", "y", "2024-05-01T10:02:00Z", 6)))
    paths = rs.StreamPaths.under(f"{root}/run")
    rs.run_rollup_stream(spark, log_scan.LogLayout(base), paths, CFG, robust=True)
    assert _totals(spark, paths.ledger) == {("alice", "x-opus", "2024-05"): (5, 1), ("bob", "y", "2024-05"): (6, 1)}


def test_rollup_job_keeps_high_water_mark(spark):
    from meterwise import jobs
    root = tempfile.mkdtemp(prefix="mw-job-")
    base = f"{root}/logs/" + LOG_DIR.format(account="7")
    _write(base, "us-east-1", datetime(2024, 5, 1, 10), "a.json.gz", [_rec("alice", "x-opus", "2024-05-01T10:00:00Z", 5)])
    work = f"{root}/work"
    s1 = jobs.rollup_run(spark, f"{root}/logs", "7", work, CFG, now=datetime(2024, 5, 1, 10, 5))
    assert s1["run_id"] == 1 and s1["objects_processed"] == 1
    _write(base, "us-east-1", datetime(2024, 5, 1, 10), "b.json.gz", [_rec("alice", "x-opus", "2024-05-01T10:06:00Z", 7)])
    s2 = jobs.rollup_run(spark, f"{root}/logs", "7", work, CFG, now=datetime(2024, 5, 1, 10, 10))
    assert s2["run_id"] == 2 and s2["objects_processed"] == 1
    assert s2["cutoff"] == "2024-05-01T09:55:00"          # min(checkpoint 10:05, now - 15 min)
    assert _totals(spark, f"{work}/ledger") == {("alice", "x-opus", "2024-05"): (12, 2)}
    jobs.report(spark, work, "2024-05", f"{root}/report", CFG)
    assert spark.read.parquet(f"{root}/report/leaderboard").count() == 1


def test_processing_time_trigger(spark):
    root = tempfile.mkdtemp(prefix="mw-trigger-")
    base = f"{root}/logs/" + LOG_DIR.format(account="1")
    _write(base, "us-east-1", datetime(2024, 7, 1, 8), "a.json.gz", [_rec("erin", "y", "2024-07-01T08:00:00Z", 11)])
    paths = rs.StreamPaths.under(f"{root}/run")
    q = rs.run_rollup_stream(spark, log_scan.LogLayout(base), paths, CFG, available_now=False,
                             processing_time="1 second")
    try:
        q.processAllAvailable()
        _write(base, "eu-west-1", datetime(2024, 7, 1, 9), "b.json.gz", [_rec("erin", "y", "2024-07-01T09:00:00Z", 4)])
        q.processAllAvailable()
    finally:
        q.stop()
    assert _totals(spark, paths.ledger) == {("erin", "y", "2024-07"): (15, 2)}



def test_rollup_stream_with_keyed_state_alerts(spark):
    root = tempfile.mkdtemp(prefix="mw-statemode-")
    base = f"{root}/logs/" + LOG_DIR.format(account="1")
    _write(base, "us-east-1", datetime(2024, 5, 1, 10), "a.json.gz",
           [_rec("alice", "x-opus", "2024-05-01T10:00:00Z", 1000), _rec("bob", "y", "2024-05-01T10:01:00Z", 10)])
    lay = log_scan.LogLayout(base)
    paths = rs.StreamPaths.under(f"{root}/run")
    rs.run_rollup_stream(spark, lay, paths, CFG, alerts_mode="state")
    assert _totals(spark, paths.ledger)[("alice", "x-opus", "2024-05")] == (1000, 1)
    al = rs.read_alerts(spark, paths.alerts).collect()
    assert sorted((r["user"], r["level"]) for r in al) == [("alice", "BREACH"), ("alice", "WARN")]
    assert all(r["subject"].startswith("[Spend ") and r["attributes"]["user"] == "alice" for r in al)


def test_series_counts_every_record_and_marks_closed_windows(spark):
    from meterwise.streaming import series_stream
    root = tempfile.mkdtemp(prefix="mw-series-")
    base = f"{root}/logs/" + LOG_DIR.format(account="1")
    times = ["2024-05-01T10:01:00Z", "2024-05-01T10:03:00Z", "2024-05-01T10:07:00Z", "2024-05-01T10:16:00Z",
             "2024-05-01T10:31:00Z", "2024-05-01T10:44:00Z"]
    _write(base, "us-east-1", datetime(2024, 5, 1, 10), "a.json.gz",
           [_rec("u", "y", t, 10 * (i + 1)) for i, t in enumerate(times)])
    out = f"{root}/series"
    series_stream.run_series_stream(spark, log_scan.LogLayout(base), out, f"{root}/_ck", CFG)
    got = sorted((r["window_start"].strftime("%H:%M"), r["input_tokens"], r["invocations"], r["closed"])
                 for r in series_stream.read_series(spark, out, CFG).collect())
    # brute force: 5-minute buckets, closed once the watermark (last event 10:44 - 10 min = 10:34) passes their end
    buckets = {}
    for i, t in enumerate(times):
        m = int(t[14:16])
        start = m - m % 5
        buckets.setdefault(start, [0, 0])
        buckets[start][0] += 10 * (i + 1)
        buckets[start][1] += 1
    expect = sorted((f"10:{s:02d}", v[0], v[1], s + 5 <= 34) for s, v in buckets.items())
    assert got == expect


def test_series_does_not_depend_on_the_batch_size(spark):
    from meterwise.streaming import series_stream
    root = tempfile.mkdtemp(prefix="mw-series-")
    base = f"{root}/logs/" + LOG_DIR.format(account="1")
    for k, minute in enumerate([50, 1, 30, 2]):                  # file order is not event order
        _write(base, "us-east-1", datetime(2024, 5, 1, 10), f"{k}.json.gz",
               [_rec("u", "y", f"2024-05-01T10:{minute:02d}:00Z", 10)])
    lay, rows = log_scan.LogLayout(base), []
    for cap in (1, 4):
        out = f"{root}/series{cap}"
        series_stream.run_series_stream(spark, lay, out, f"{root}/_ck{cap}", CFG, max_files_per_trigger=cap)
        rows.append(sorted(map(tuple, series_stream.read_series(spark, out, CFG).collect())))
        late = sum(r["late"] for r in series_stream.late_records(spark, out, CFG).collect())
        assert late <= 3 and (cap == 1 or late == 0)
    assert rows[0] == rows[1] and sum(r[6] for r in rows[0]) == 4


def test_batches_decide_audit_and_throttle(spark):
    root = tempfile.mkdtemp(prefix="mw-enforce-")
    base = f"{root}/logs/" + LOG_DIR.format(account="1")
    cfg = CFG.with_(enforce_enabled=True, identity_store_id="s", group_ids=("g1",), allow_list=("carol",))
    directory = rs.Directory(
        spark.createDataFrame([("alice", "ua"), ("carol", "uc")], "user_name string, user_id string"),
        spark.createDataFrame([], "display_name string, group_id string"),
        spark.createDataFrame([("g1", "ua", "m1"), ("g1", "uc", "m3")], "group_id string, user_id string, membership_id string"))
    paths, lay = rs.StreamPaths.under(f"{root}/run"), log_scan.LogLayout(base)
    for k, hours in enumerate((0, 1, 30)):       # the second follows within the 24 hours, the third does not
        _write(base, "us-east-1", datetime(2024, 5, 1, 10), f"{k}.json.gz",
               [_rec(u, "x-opus", "2024-05-01T10:00:00Z", 1000) for u in ("alice", "bob", "carol")])
        when = datetime(2024, 5, 1, 11).timestamp() + 3600 * hours
        os.utime(os.path.join(base, "us-east-1", "2024/05/01/10", f"{k}.json.gz"), (when, when))
        rs.run_rollup_stream(spark, lay, paths, cfg, directory=directory)
    audit = sorted((r["batch_id"], r["user"], r["mode"]) for r in rs.read_audit(spark, paths.audit).collect())
    assert audit == [(b, u, m) for b in range(3) for u, m in (("alice", "DRYRUN"), ("bob", "ERROR"))]
    told = sorted((r["batch_id"], r["user"], r["level"]) for r in rs.read_notices(spark, paths.notices).collect())
    assert told == [(0, "alice", "DRYRUN"), (2, "alice", "DRYRUN")]


def test_stream_token_alerts_name_the_event_for_any_batch_size(spark):
    root = tempfile.mkdtemp(prefix="mw-tokens-")
    base = f"{root}/logs/" + LOG_DIR.format(account="1")
    for h in range(4):  # modified in event order, as objects are delivered
        recs = [{**_rec("u", "m", f"2024-05-01T{h:02d}:{m:02d}:00Z", 100), "requestId": f"r{h}{m}"} for m in (0, 20, 40)]
        _write(base, "us-east-1", datetime(2024, 5, 1, h), "a.json.gz", recs)
        os.utime(os.path.join(base, f"us-east-1/2024/05/01/{h:02d}/a.json.gz"), (1714521600 + h, 1714521600 + h))
    cfg = CFG.with_(token_alerts=True, token_threshold=3000)
    lay, told = log_scan.LogLayout(base), []
    for files in (1, 100):
        paths = rs.StreamPaths.under(f"{root}/run{files}")
        rs.run_rollup_stream(spark, lay, paths, cfg, max_files_per_trigger=files)
        told.append(sorted((r["level"], r["record_id"], r["prev_total"], r["new_total"])
                           for r in rs.read_token_alerts(spark, paths.token_alerts).collect()))
    # 300 tokens a call (input, output, cache write): 1,500 with the 5th, 3,000 with the 10th
    assert told == [[("BREACH", "r30", 2700, 3000), ("WARN", "r120", 1200, 1500)]] * 2


def test_jobs_enforce_and_report_every_dataset(spark):
    from meterwise import jobs
    root = tempfile.mkdtemp(prefix="mw-jobs-")
    base, work = f"{root}/logs/" + LOG_DIR.format(account="7"), f"{root}/work"
    _write(base, "us-east-1", datetime(2024, 5, 1, 10), "a.json.gz",
           [_rec("alice", "x-opus", "2024-05-01T10:00:00Z", 1000), _rec("bob", "y", "2024-05-01T10:01:00Z", 10)])
    for name, row, ddl in (("users", ("alice", "u-1"), "user_name string, user_id string"),
                           ("groups", ("Devs", "g-1"), "display_name string, group_id string"),
                           ("memberships", ("g-1", "u-1", "m-1"), "group_id string, user_id string, membership_id string")):
        spark.createDataFrame([row], ddl).write.parquet(f"{root}/directory/{name}")
    cfg = CFG.with_(enforce_enabled=True, identity_store_id="s", group_names=("Devs",))
    done = jobs.rollup_run(spark, f"{root}/logs", "7", work, cfg, now=datetime(2024, 5, 1, 10, 5),
                           directory=jobs.read_directory(spark, f"{root}/directory"))
    assert (done["objects_processed"], done["records_processed"], done["users_touched"], done["regions"]) == (1, 2, 2, "us-east-1")
    audit = rs.read_audit(spark, f"{work}/audit").collect()
    assert [(r["user"], r["mode"]) for r in audit] == [("alice", "DRYRUN")]
    jobs.report(spark, work, "2024-05", f"{root}/report", cfg, jobs.DashboardFilters("ALI"))
    rows = {n: spark.read.parquet(f"{root}/report/{n}").collect() for n in sorted(os.listdir(f"{root}/report")) if n != "users_csv"}
    assert sorted(rows) == ["detail", "heatmap", "histogram", "kpis", "leaderboard", "model_leaderboard", "top_models",
                            "top_users", "usage_notices", "users"]
    assert len(rows["leaderboard"]) == 2 and [r["user"] for r in rows["users"]] == ["alice"]
    assert "  User           : alice\n" in rows["usage_notices"][0]["body"] and "Triggered by" in rows["usage_notices"][0]["body"]
    assert spark.read.option("header", True).csv(f"{root}/report/users_csv").count() == 1
