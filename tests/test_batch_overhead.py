"""What a small batch costs beside its rows: tasks, state partitions, listings, texts held at once."""

import base64
import gzip
import os
import tempfile
from datetime import datetime
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import Row

from meterwise.config import MeterConfig
from meterwise.operators import alerts
from meterwise.sources import ledger, log_scan, subscription
from meterwise.sources.raw_records import LOG_DIR
from meterwise.streaming import rollup_stream as rs, spend_state
from tests.test_streaming import _rec, _write

CFG = MeterConfig(budget_usd=Decimal("0.01"), warn_ratio=Decimal("0.5"))
PARTITIONS = "spark.sql.shuffle.partitions"


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, "61")
    yield 61
    spark.conf.set(PARTITIONS, before)


def _logs(root):
    base = f"{root}/logs/" + LOG_DIR.format(account="1")
    for h in range(3):
        _write(base, "us-east-1", datetime(2024, 5, 1, h), f"{h}.json.gz",
               [_rec(f"u{i}", "x-opus", f"2024-05-01T{h:02}:00:00Z", 400) for i in range(20)])
    return log_scan.LogLayout(base)


def test_settling_a_small_batch_runs_few_tasks(spark, many_partitions):
    root = tempfile.mkdtemp(prefix="mw-tasks-")
    files = log_scan.scan_files(spark, log_scan.load_paths(_logs(root), None, None))
    paths, sc = rs.StreamPaths.under(f"{root}/run", with_outbox=True), spark.sparkContext
    sc.setJobGroup("settle-tasks", "settle")
    try:
        rs.process_batch(files, 0, paths, CFG)
    finally:
        sc._jsc.clearJobGroup()
    status = sc.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("settle-tasks") for s in status.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s is not None and s.numCompletedTasks) < many_partitions
    assert rs.read_alerts(spark, paths.alerts).count() == 40


def test_a_batch_reads_back_its_own_partials_only(spark):
    path = tempfile.mkdtemp(prefix="mw-own-") + "/ledger"
    row = "user string, model_id string, month string, input_tokens long, output_tokens long, cache_write_tokens long, " \
          "cache_read_tokens long, invocations long, last_ts timestamp_ntz, batch_id long"
    rows = [("a", "m", "2024-05", 1, 2, 3, 4, 5, None, 0), ("a", "m", None, 1, 1, 1, 1, 1, None, 1),
            ("b", "m", "2024-06", 2, 2, 2, 2, 2, None, 1)]
    ledger.write_partials(spark.createDataFrame(rows, row), path)
    got = ledger.read_batch(spark, path, 1)
    assert sorted((r["user"], r["month"], r["invocations"], r["batch_id"]) for r in got.collect()) == [
        ("a", None, 1, 1), ("b", "2024-06", 2, 1)]
    assert ledger.read_batch(spark, path, 7).count() == 0
    months = got.where(rs._among("month", [None])).collect()
    assert [r["user"] for r in months] == ["a"]


def test_keyed_state_has_a_partition_a_core(spark, many_partitions):
    root = tempfile.mkdtemp(prefix="mw-state-")
    spend_state.run_spend_alert_stream(spark, _logs(root), f"{root}/alerts", f"{root}/ck", CFG, max_files_per_trigger=2)
    dealt = [d for d in os.listdir(f"{root}/ck/state/0") if d.isdigit()]
    assert len(dealt) == spark.sparkContext.defaultParallelism
    assert spark.conf.get(PARTITIONS) == str(many_partitions)
    assert rs.read_alerts(spark, f"{root}/alerts").count() == 40


def test_a_stream_lists_its_objects_in_few_tasks(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.unset(name)
    rs.log_stream(spark, _logs(tempfile.mkdtemp(prefix="mw-list-")))
    assert int(spark.conf.get(name)) <= 4 * spark.sparkContext.defaultParallelism


def test_envelopes_are_unpacked_a_few_at_a_time():
    texts = [f"text {i}" for i in range(200)] + [None]
    packed = pd.DataFrame({"id": range(201), "raw": [t and gzip.compress(t.encode()) for t in texts]})
    got = list(subscription._gunzip([packed]))
    assert max(len(g) for g in got) <= subscription.ENVELOPES_HELD < 200
    out = pd.concat(got)
    assert list(out["id"]) == list(range(201)) and list(out["payload"][:-1]) == texts[:-1]
    assert list(out["error"])[-1] == "missing" and out["error"][:-1].isna().all()
    sent = list(subscription._gzip_b64([pd.DataFrame({"payload": texts[:-1]})]))
    assert max(len(g) for g in sent) <= subscription.ENVELOPES_HELD
    assert [gzip.decompress(base64.b64decode(d)).decode() for d in pd.concat(sent)["data"]] == texts[:-1]


def test_a_key_meets_its_state_by_rows_with_one_lookup():
    class Held:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def update(self, value):
            self.calls.append("update")
            self.value = value

    unit, step = int(spend_state.UNIT), spend_state.SpendCrossing(Decimal("2"), Decimal("4"))
    step.total = held = Held()
    ran = [list(step.handleInputRows(("u", "2024-05"), iter([Row(units=str(n)) for n in batch]), None))
           for batch in ([unit], [unit // 2, unit // 2], [0], [3 * unit])]
    assert [[(r["level"], Decimal(r["prev_cost"]), Decimal(r["new_cost"])) for r in rows] for rows in ran] == [
        [], [("WARN", 1, 2)], [], [("BREACH", 2, 5)]]
    assert held.calls == ["get", "update"] * 4 and int(held.value[0]) == 5 * unit


def _jobs(sc, group, step):
    sc.setJobGroup(group, group)
    try:
        step()
    finally:
        sc._jsc.clearJobGroup()
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_a_batch_runs_few_jobs(spark):
    root = tempfile.mkdtemp(prefix="mw-jobs-")
    files = log_scan.scan_files(spark, log_scan.load_paths(_logs(root), None, None))
    paths = rs.StreamPaths.under(f"{root}/run")
    assert _jobs(spark.sparkContext, "few-jobs", lambda: rs.process_batch(files, 3, paths, CFG)) <= 19
    assert rs.read_alerts(spark, paths.alerts).where("batch_id = 3").count() == 40


def test_spend_before_a_batch_counts_its_users_only_and_in_one_shuffle(spark):
    part = "user string, model_id string, month string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long"
    parts = spark.createDataFrame([("a", "x-opus", "2024-05", 100, 0, 0, 0, 7), ("a", "x-haiku", "2024-05", 100, 0, 0, 0, 7),
                                   ("b", "x-opus", "2024-06", 10, 0, 0, 0, 7), (None, "x-opus", "2024-05", 10, 0, 0, 0, 7)],
                                  part + ", batch_id long")
    before = spark.createDataFrame([("a", "x-opus", "2024-05", 300, 0, 0, 0), ("a", "x-opus", "2024-05", 300, 0, 0, 0),
                                    ("a", "x-opus", "2024-04", 9000, 0, 0, 0), ("c", "x-opus", "2024-05", 5, 0, 0, 0)], part)
    got = rs._before_after(parts, rs._touched(before, parts), CFG)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    cost = {m: rs._priced_partials(spark.createDataFrame([("a", m, "2024-05", 1, 0, 0, 0)], part), CFG).first()["cost"]
            for m in ("x-opus", "x-haiku")}
    both = cost["x-opus"] + cost["x-haiku"]
    assert {(r["user"], r["month"]): (r["delta"], r["prev_cost"], r["new_cost"], r["run"]) for r in got.collect()} == {
        ("a", "2024-05"): (100 * both, 600 * cost["x-opus"], 600 * cost["x-opus"] + 100 * both, 7),
        ("b", "2024-06"): (10 * cost["x-opus"], 0, 10 * cost["x-opus"], 7)}


def test_settling_a_small_batch_compiles_next_to_nothing(spark):
    root = tempfile.mkdtemp(prefix="mw-compiled-")
    files = log_scan.scan_files(spark, log_scan.load_paths(_logs(root), None, None))
    paths, cfg = rs.StreamPaths.under(f"{root}/run", with_outbox=True), CFG.with_(token_alerts=True, token_threshold=1000)
    rows, compiled = rs.stage(files, 0, paths, cfg), spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()
    before, kept = compiled.getCount(), spark.conf.get("spark.sql.codegen.wholeStage")
    rs.settle(rows, None, 0, paths, cfg, small=True)
    assert compiled.getCount() - before <= 20
    assert spark.conf.get("spark.sql.codegen.wholeStage") == kept
    assert rs.read_alerts(spark, paths.alerts).count() == 40 and rs.read_token_alerts(spark, paths.token_alerts).count() == 40


def test_token_crossings_of_batches_are_those_of_all_events(spark):
    cols = "user string, model_id string, month string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long"
    cfg = CFG.with_(token_threshold=100)
    t = lambda h, m=0: datetime(2024, 5, 1, h, m)
    events = [("a", t(1), 1, 60), ("a", t(1, 1), 2, 30), ("a", None, 0, 5), ("b", t(2), 3, 250), ("c", t(2), 4, 30), ("d", t(3), 5, 120),
              ("a", t(4), 6, 20), ("c", t(4), 7, 19), ("d", t(4), 8, 120), ("c", t(5), 9, 1), ("c", t(5, 1), 10, 80)]
    inv = spark.createDataFrame([(u, "m", "2024-05", n, 0, 0, 0, ts, str(i).zfill(2)) for u, ts, i, n in events],
                                cols + ", ts timestamp_ntz, record_id string")
    plain = lambda d: {tuple(r[c] for c in ("user", "level", "boundary", "record_id", "prev_total", "new_total")) for r in d.collect()}
    got = set()
    for first, last in (("00", "05"), ("06", "08"), ("09", "10")):
        batch = inv.where((inv.record_id >= first) & (inv.record_id <= last))
        got |= plain(alerts.token_crossings_after(batch, inv.where(inv.record_id < first).select(batch.columns[:7]), cfg))
    assert got == plain(alerts.token_crossings(inv, cfg)) and len(got) == 8
    # up and down within an hour: each event that crosses counts
    dip = spark.createDataFrame([("e", "m", "2024-05", n, 0, 0, 0, t(1, i), str(i)) for i, n in enumerate((60, -30))],
                                cols + ", ts timestamp_ntz, record_id string")
    assert plain(alerts.token_crossings_after(dip, dip.limit(0), cfg)) == {("e", "WARN", 50, "0", 0, 60)}
