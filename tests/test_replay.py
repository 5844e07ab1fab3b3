"""No run loses data: crash and repeat at each step, damaged and multi-member archives, missing times."""

import gzip
import os
import tempfile
from datetime import datetime

import pytest

from meterwise.config import MeterConfig
from meterwise.functions import invocation
from meterwise.operators import alerts, metrics
from meterwise.session import work_root
from meterwise.sources import log_scan
from meterwise.sources.raw_records import LOG_DIR
from meterwise.streaming import rollup_stream as rs
from meterwise.streaming import scheduled
from tests.test_streaming import _rec, _totals, _write

CFG = MeterConfig()
HOUR = datetime(2024, 5, 1, 10)


def _logs():
    root = tempfile.mkdtemp(prefix="mw-replay-")
    return root, f"{root}/logs/" + LOG_DIR.format(account="1")


@pytest.mark.parametrize("step", ["after_markers", "after_run"])
def test_crash_and_repeat_gives_the_exact_ledger(spark, monkeypatch, step):
    root, base = _logs()
    paths, markers = rs.StreamPaths.under(f"{root}/run"), f"{root}/markers"
    run = lambda run_id, now, **k: scheduled.run_scheduled_rollup(
        spark, log_scan.LogLayout(base), paths, markers, CFG, run_id, now, **k)
    _write(base, "us-east-1", HOUR, "a.json.gz", [_rec("a", "y", "2024-05-01T10:00:00Z", 100)])
    if step == "after_markers":
        with monkeypatch.context() as m:
            m.setattr(scheduled, "process_batch", lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                run(1, datetime(2024, 5, 1, 10, 5))
    else:
        run(1, datetime(2024, 5, 1, 10, 5))  # the run log is not written: the id is used again
    _write(base, "us-east-1", HOUR, "b.json.gz", [_rec("b", "y", "2024-05-01T10:06:00Z", 7)])
    # far later: the first object has left the look-back window
    again = run(1, datetime(2024, 5, 1, 10, 10), start_ts=datetime(2024, 5, 1, 10))
    assert again["objects_processed"] == 2
    assert _totals(spark, paths.ledger) == {("a", "y", "2024-05"): (100, 1), ("b", "y", "2024-05"): (7, 1)}
    assert run(2, datetime(2024, 5, 1, 10, 15))["objects_processed"] == 0
    assert run(1, datetime(2024, 5, 3, 10, 0))["objects_processed"] == 2  # what run 1 claimed, outside any window
    assert _totals(spark, paths.ledger) == {("a", "y", "2024-05"): (100, 1), ("b", "y", "2024-05"): (7, 1)}


def test_damaged_and_multi_member_objects(spark):
    root, base = _logs()
    _write(base, "us-east-1", HOUR, "a.json.gz", [_rec("a", "y", "2024-05-01T10:00:00Z", 1)])
    folder = os.path.join(base, "us-east-1", "2024/05/01/10")
    import json
    two = b"".join(gzip.compress((json.dumps(_rec(u, "y", "2024-05-01T10:01:00Z", 2)) + "\n").encode()) for u in ("b", "c"))
    with open(os.path.join(folder, "two.json.gz"), "wb") as f:
        f.write(two)
    with open(os.path.join(folder, "cut.json.gz"), "wb") as f:
        f.write(two[:30])
    paths = rs.StreamPaths.under(f"{root}/run")
    done = scheduled.run_scheduled_rollup(spark, log_scan.LogLayout(base), paths, f"{root}/markers", CFG, 1, datetime(2024, 5, 1, 10, 5))
    assert (done["objects_processed"], done["objects_unreadable"]) == (3, 1)
    assert _totals(spark, paths.ledger) == {(u, "y", "2024-05"): (n, 1) for u, n in (("a", 1), ("b", 2), ("c", 2))}
    files = log_scan.scan_files_robust(spark, [folder])
    bad = log_scan.decode_records(files).groupBy("path").agg({"malformed": "max"}).collect()
    assert sorted(r[1] for r in bad) == [0, 0, 1]


def test_times_in_basic_form_and_fallback(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(
        ['"20240315T101500Z"', '"20240315T1015"', '"20240315"', '"20240315T101500.250+0530"', '"2024-03-15T10:15:00Z"', '"soon"', "null"])], "i int, t string")
    got = rows.selectExpr("i", "parse_json(concat('{\"timestamp\":', t, '}')) AS rec")
    from pyspark.sql import functions as F
    fallback = F.lit("2024-01-01 00:00:00").cast("timestamp")
    told = [str(r[0]) for r in got.orderBy("i").select(invocation.event_time(F.col("rec"), fallback)).collect()]
    assert told == ["2024-03-15 10:15:00", "2024-03-15 10:15:00", "2024-03-15 00:00:00", "2024-03-15 04:45:00.250000",
                    "2024-03-15 10:15:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00"]


def test_rows_without_a_time_still_count(spark):
    df = spark.sql("""SELECT 'u' AS user, '2024-01' AS month, 'm' AS model_id, CAST(t AS timestamp_ntz) AS ts,
                             1000000L AS input_tokens, 0L AS output_tokens, 0L AS cache_write_tokens,
                             0L AS cache_read_tokens
                      FROM VALUES ('2024-01-01 00:07:31'), (NULL) AS x(t)""")
    delta = {str(r["run"]): float(r["delta"]) for r in alerts.spend_delta(df, CFG).collect()}
    assert delta == {"None": 3.0, "2024-01-01 00:05:00": 3.0}
    after = alerts.spend_before_after(alerts.spend_delta(df, CFG)).orderBy("run").collect()
    assert [float(r["new_cost"]) for r in after] == [3.0, 6.0]
    assert metrics.series_by_model(df, CFG).count() == 2


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda *a, **k: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_root(Session())


ODD_NAMES = ["plain.json.gz", "br[1]x.json.gz", "cur{a,b}.json.gz", "sp ace%20.json.gz", "st*r.json.gz", "q?.json.gz",
             "back\\slash.json.gz", "p#h.json.gz"]


@pytest.mark.parametrize("robust", [True, False])
def test_names_are_never_patterns(spark, robust):
    root, base = _logs()
    for i, name in enumerate(ODD_NAMES):
        _write(base, "us-east-1", HOUR, name, [_rec(f"u{i}", "y", "2024-05-01T10:00:00Z", 1)])
    paths = rs.StreamPaths.under(f"{root}/run")
    done = scheduled.run_scheduled_rollup(spark, log_scan.LogLayout(base), paths, f"{root}/markers", CFG, 1,
                                          datetime(2024, 5, 1, 10, 5), robust=robust)
    assert done["objects_processed"] == done["objects_seen"] == len(ODD_NAMES)
    assert sorted(k[0] for k in _totals(spark, paths.ledger)) == [f"u{i}" for i in range(len(ODD_NAMES))]
    assert [r.asDict() for r in rs.read_runs(spark, paths.runs).select("objects_seen", "records_processed", "users_touched",
                                                                      "regions").collect()] == [
        {"objects_seen": 8, "records_processed": 8, "users_touched": 8, "regions": "us-east-1"}]


def test_a_claimed_object_that_is_gone_fails_the_run(spark, monkeypatch):
    root, base = _logs()
    paths = rs.StreamPaths.under(f"{root}/run")
    for name in "ab":
        _write(base, "us-east-1", HOUR, f"{name}.json.gz", [_rec(name, "y", "2024-05-01T10:00:00Z", 1)])
    read = log_scan.scan_files_robust

    def lose_one(*a, **k):
        os.remove(os.path.join(base, "us-east-1/2024/05/01/10/b.json.gz"))
        return read(*a, **k)
    monkeypatch.setattr(log_scan, "scan_files_robust", lose_one)
    with pytest.raises(RuntimeError, match="2 objects are claimed, 1 were read"):
        scheduled.run_scheduled_rollup(spark, log_scan.LogLayout(base), paths, f"{root}/markers", CFG, 1, datetime(2024, 5, 1, 10, 5))
    assert not os.path.exists(paths.ledger)


def test_month_totals_read_a_bounded_number_of_partials(spark, monkeypatch):
    from pyspark.sql import functions as F

    from meterwise.sources import ledger
    monkeypatch.setattr(ledger, "SNAPSHOT_EVERY", 3)
    root, _ = _logs()
    path, month = f"{root}/ledger", "2024-05"

    def batch(k, n):
        ledger.forget_snapshots(spark, path, k)
        rows = spark.createDataFrame([(k, "u", "m", month, n, 0, 0, 0)], "batch_id long, user string, model_id string, month string, "
                                     "input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long")
        ledger.write_partials(ledger.batch_partials(rows.withColumn("ts", F.lit(None).cast("timestamp_ntz"))), path)
        ledger.write_snapshots(spark, path, [month], k)

    def total(upto):
        df = ledger.month_partials(spark, path, [month], upto)
        return df.agg(F.sum("input_tokens")).first()[0], len({os.path.dirname(f) for f in df.inputFiles()})

    want, folders = 0, []
    for k in range(14):
        batch(k, 10 ** (k % 5))
        want += 10 ** (k % 5)
        got, n = total(k)
        assert got == want
        folders.append(n)
    assert max(folders) <= 4  # one snapshot and fewer than SNAPSHOT_EVERY partials, or those that fill it
    batch(13, 10 ** 3)                       # the last batch again
    assert total(13)[0] == want
    batch(7, 5 + 10 ** 2)                    # an old batch again, with more in it: the snapshots that hold it go
    assert total(13)[0] == want + 5 and total(6)[0] == sum(10 ** (k % 5) for k in range(7))
