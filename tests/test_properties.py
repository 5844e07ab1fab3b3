"""Property tests against brute force on small random inputs (SURVEY §5
invariants): the chunked token crossings equal a plain running sum, spend
alerts fire at most once per boundary for non-negative spend, and top-N +
Others keeps the total."""

from datetime import datetime, timedelta
from decimal import Decimal

from hypothesis import HealthCheck, given, settings, strategies as st

from meterwise.config import MeterConfig
from meterwise.operators import alerts, dashboard

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

events = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.sampled_from(["m1", "m2"]),
                            st.integers(0, 5 * 24 * 60), st.integers(0, 400)), min_size=1, max_size=60)


def _brute_crossings(rows, threshold, ratio):
    warn = int(threshold * ratio)
    out, totals = set(), {}
    for rid, (u, m, minute, tok) in sorted(enumerate(rows), key=lambda x: (x[1][2], x[0])):
        key = (u, m)
        prev = totals.get(key, 0)
        new = prev + tok
        totals[key] = new
        for level, b in (("WARN", warn), ("BREACH", threshold)):
            if prev < b <= new:
                out.add((u, m, level, rid, prev, new))
    return out


@SETTINGS
@given(events)
def test_chunked_token_crossings_equal_running_sum(spark, rows):
    cfg = MeterConfig(token_threshold=1000, warn_ratio=Decimal("0.8"))
    t0 = datetime(2024, 3, 1)
    df = spark.createDataFrame(
        [(i, u, m, "2024-03", t0 + timedelta(minutes=mi), tok, 0, 0, 0) for i, (u, m, mi, tok) in enumerate(rows)],
        "record_id long, user string, model_id string, month string, ts timestamp_ntz, input_tokens long, "
        "output_tokens long, cache_write_tokens long, cache_read_tokens long")
    got = {(r["user"], r["model_id"], r["level"], r["record_id"], r["prev_total"], r["new_total"])
           for r in alerts.token_crossings(df, cfg).collect()}
    assert got == _brute_crossings(rows, 1000, 0.8)


USAGE = ("record_id long, user string, model_id string, month string, ts timestamp_ntz, input_tokens long, "
         "output_tokens long, cache_write_tokens long, cache_read_tokens long")


def test_crossings_of_events_without_a_time_and_in_a_hot_hour(spark):
    cfg = MeterConfig(token_threshold=1000, warn_ratio=Decimal("0.8"))
    t0 = datetime(2024, 3, 1)
    # one user, one instant, and some events without any time, which come first
    rows = [(i, "hot", "m", "2024-03", None if i % 50 == 0 else t0, 3, 0, 0, 0) for i in range(500)]
    rows += [(1000, "big", "m", "2024-03", None, 2000, 0, 0, 0)]
    got = sorted((r["user"], r["level"], r["record_id"], r["prev_total"], r["new_total"])
                 for r in alerts.token_crossings(spark.createDataFrame(rows, USAGE).repartition(6), cfg).collect())
    order = sorted(range(500), key=lambda i: (i % 50 != 0, i))
    assert got == [("big", "BREACH", 1000, 0, 2000), ("big", "WARN", 1000, 0, 2000),
                   ("hot", "BREACH", order[333], 999, 1002), ("hot", "WARN", order[266], 798, 801)]


def test_crossings_on_top_of_earlier_totals(spark):
    cfg = MeterConfig(token_threshold=1000, warn_ratio=Decimal("0.8"))
    rows = [(1, "u", "m", "2024-03", datetime(2024, 3, 1), 10, 0, 0, 0), (2, "v", "m", "2024-03", datetime(2024, 3, 1), 10, 0, 0, 0)]
    start = spark.createDataFrame([("u", "m", "2024-03", 795), ("v", "m", "2024-03", 800)],
                                  "user string, model_id string, month string, start long")
    got = alerts.token_crossings(spark.createDataFrame(rows, USAGE), cfg, start=start).collect()
    assert [(r["user"], r["level"], r["prev_total"], r["new_total"]) for r in got] == [("u", "WARN", 795, 805)]


def test_a_running_sum_spans_ranges(spark):
    from meterwise.operators import prefix
    rows = [("hot" if i % 3 else None, i % 40, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, o int, v long").repartition(5)
    got = {(r["k"], r["o"], r["v"]): r["s"] for r in prefix.running_sum(df, ["k"], ["o", "v"], "v", "s").collect()}
    want = {}
    for k in ("hot", None):
        total = 0
        for row in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]):
            total += row[2]
            want[row] = total
    assert got == want


runs = st.lists(st.tuples(st.sampled_from(["u1", "u2", "hot"]), st.integers(0, 50),
                          st.decimals(min_value=0, max_value=3, places=2)), min_size=1, max_size=40)


@SETTINGS
@given(runs)
def test_spend_alerts_once_per_boundary(spark, rs):
    cfg = MeterConfig(budget_usd=Decimal("4"), warn_ratio=Decimal("0.8"))
    agg = {}
    for u, run, d in rs:
        agg[(u, run)] = agg.get((u, run), Decimal(0)) + d
    df = spark.createDataFrame([(u, "2024-01", run, d) for (u, run), d in agg.items()],
                               "user string, month string, run int, delta decimal(38,12)")
    got = [(r["user"], r["level"], r["run"]) for r in alerts.spend_alerts(alerts.spend_before_after(df), cfg).collect()]
    assert len(got) == len(set((u, lv) for u, lv, _ in got))          # at most one per (user, boundary)
    expect = set()
    for u in {k[0] for k in agg}:
        tot = Decimal(0)
        for run in sorted(r for (uu, r) in agg if uu == u):
            d = agg[(u, run)]
            prev, tot = tot, tot + d
            for level, b in (("WARN", Decimal("3.2")), ("BREACH", Decimal("4"))):
                if d > 0 and prev < b <= tot:
                    expect.add((u, level, run))
    assert set(got) == expect


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([f"u{i}" for i in range(12)]), st.integers(0, 500)), min_size=1, max_size=40),
       st.integers(1, 6))
def test_top_n_with_others_keeps_total(spark, rows, n):
    df = spark.createDataFrame([(u, Decimal(c), c) for u, c in rows], "user string, cost decimal(38,12), total_tokens long")
    out = dashboard.top_n_with_others(df, "user", n, ["cost", "total_tokens"]).collect()
    assert sum(r["total_tokens"] for r in out) == sum(c for _, c in rows)
    groups = len({u for u, _ in rows})
    assert len(out) == min(groups, n) + (1 if groups > n else 0)
