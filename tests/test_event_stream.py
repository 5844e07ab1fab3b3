"""The event path: envelopes delivered again, damaged payloads, bad messages, a batch that runs again."""

import base64
import gzip
import json
import tempfile
from decimal import Decimal

from meterwise.config import MeterConfig
from meterwise.streaming import event_stream
from meterwise.streaming import rollup_stream as rs
from tests.test_streaming import _rec, _totals

CFG = MeterConfig(budget_usd=Decimal("100"), token_threshold=1000, token_alerts=True)
DAY = 1714521600000  # 2024-05-01


def _envelope(events):
    doc = {"logGroup": "g", "logStream": "s", "logEvents": events}
    return base64.b64encode(gzip.compress(json.dumps(doc).encode())).decode()


def _event(i, user="u", n=100, message=None, at=DAY):
    rec = {**_rec(user, "m", "2024-05-01T00:00:00Z", n), "requestId": f"r{i}"}
    return {"id": f"e{i}" if i is not None else None, "timestamp": at + (i or 0) * 1000,
            "message": json.dumps(rec) if message is None else message}


def _batch(spark, *envelopes):
    return spark.createDataFrame([("us-east-1", 0, e) for e in envelopes], "region string, block long, data string")


def test_replays_and_damage(spark):
    root = tempfile.mkdtemp(prefix="mw-events-")
    paths, seen = rs.StreamPaths.under(root), f"{root}/seen"
    first = _batch(spark, _envelope([_event(1), _event(2), _event(2)]), "no base64 of gzip",
                   _envelope([_event(3, message="{"), _event(4, message="[1]"), _event(5, message='{"schemaType": "Other"}')]),
                   _envelope([_event(None), _event(None)]))
    counts = event_stream.process_envelopes(first, 0, paths, seen, CFG)
    assert _totals(spark, paths.ledger) == {("u", "m", "2024-05"): (400, 4)}
    assert (counts["records_processed"], counts["records_skipped"], counts["malformed"], counts["objects_unreadable"]) == (4, 1, 1, 1)
    # an envelope comes again with a new event, another is late by a day
    second = _batch(spark, _envelope([_event(1), _event(2), _event(6, n=50)]), _envelope([_event(7, n=1, at=DAY - 86_400_000)]))
    for _ in range(2):  # and the batch runs again
        event_stream.process_envelopes(second, 1, paths, seen, CFG)
        assert _totals(spark, paths.ledger) == {("u", "m", "2024-05"): (451, 6)}
    event_stream.process_envelopes(second, 2, paths, seen, CFG)
    assert _totals(spark, paths.ledger) == {("u", "m", "2024-05"): (451, 6)}
    # 300 tokens a call: 800 and 1,000 are crossed inside the first batch
    alerts = rs.read_token_alerts(spark, paths.token_alerts).collect()
    assert sorted((r["level"], r["prev_total"], r["new_total"], r["batch_id"]) for r in alerts) == [
        ("BREACH", 900, 1200, 0), ("WARN", 600, 900, 0)]
    assert sorted(r["records_processed"] for r in rs.read_runs(spark, paths.runs).collect()) == [0, 2, 4]
