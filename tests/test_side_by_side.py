"""The sink tables of a batch are written side by side once its ledger partition is there."""

import tempfile
import threading

import pytest

from meterwise.streaming import rollup_stream as rs
from tests.test_batch_overhead import CFG, _logs
from meterwise.sources import log_scan


def test_sinks_of_a_batch_are_written_at_the_same_time(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="mw-side-")
    files = log_scan.scan_files(spark, log_scan.load_paths(_logs(root), None, None))
    paths, write, together = rs.StreamPaths.under(f"{root}/run"), rs._write_batch, threading.Barrier(3)

    def meet(*args):
        together.wait(60)  # alerts, metrics and the run's counts; one after another they would not meet
        write(*args)

    monkeypatch.setattr(rs, "_write_batch", meet)
    rs.process_batch(files, 0, paths, CFG)
    assert rs.read_alerts(spark, paths.alerts).count() == 40
    assert rs.read_metrics(spark, paths.metrics).count() and rs.read_runs(spark, paths.runs).count() == 1


def test_a_failing_sink_fails_the_batch_when_all_have_ended(spark):
    done, sc = [], spark.sparkContext
    sc.setLocalProperty("mw.side", "here")
    try:
        with pytest.raises(ZeroDivisionError):
            rs._side_by_side([lambda: 1 / 0, lambda: done.append(sc.getLocalProperty("mw.side"))])
    finally:
        sc.setLocalProperty("mw.side", None)
    assert done == ["here"]


def test_a_batch_is_counted_while_its_ledger_is_written(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="mw-side-")
    files = log_scan.scan_files(spark, log_scan.load_paths(_logs(root), None, None))
    paths, together = rs.StreamPaths.under(f"{root}/run"), threading.Barrier(2)

    def meets(step):
        def run(*args):
            together.wait(60)  # one after the other they would not meet
            return step(*args)
        return run

    monkeypatch.setattr(rs, "run_counts", meets(rs.run_counts))
    monkeypatch.setattr(rs.ledger, "write_partials", meets(rs.ledger.write_partials))
    counts = rs.process_batch(files, 0, paths, CFG)
    assert counts["records_processed"] == 60 and counts["objects_seen"] == 3
    assert [r.asDict() for r in rs.read_runs(spark, paths.runs).drop("batch_id").collect()] == [counts]
