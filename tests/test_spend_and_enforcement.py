"""Budget boundaries, alerts, ledger replay and enforcement edge rows
(FIXTURES.md E8, E9, E11-E14) plus invariants."""

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from meterwise.config import MeterConfig, PriceEntry
from meterwise.functions import budget, pricing
from meterwise.operators import alerts, dashboard, enforcement
from meterwise.sources import ledger
from meterwise.session import fresh_path

CFG = MeterConfig(budget_usd=Decimal("4.00"), warn_ratio=Decimal("0.8"))


def test_status_boundaries(spark):  # E8
    df = spark.createDataFrame([(Decimal("3.2"),), (Decimal("4.0"),), (Decimal("3.19"),)], "c decimal(38,12)")
    assert [r[0] for r in df.select(budget.status(F.col("c"), CFG)).collect()] == ["Warning", "Breach", "Normal"]


def test_one_run_crosses_both(spark):  # E9
    d = spark.createDataFrame([("u", "2024-01", 1, Decimal("1.0")), ("u", "2024-01", 2, Decimal("3.5")),
                               ("u", "2024-01", 3, Decimal("0"))], "user string, month string, run int, delta decimal(38,12)")
    a = alerts.spend_alerts(alerts.spend_before_after(d), CFG)
    assert sorted((r["run"], r["level"]) for r in a.collect()) == [(2, "BREACH"), (2, "WARN")]


def test_price_lookup_first_match(spark):
    cfg = MeterConfig()
    df = spark.createDataFrame([("a.claude-opus-sonnet", 1_000_000, 0, 0, 0), ("zzz", 0, 1_000_000, 0, 0),
                                (None, 0, 0, 1_000_000, 1_000_000)],
                               "model_id string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long")
    a = {r["model_id"]: r["cost"] for r in pricing.with_cost(df, cfg).collect()}
    b = {r["model_id"]: (r["matched_pattern"], r["rate_in"]) for r in pricing.with_rates(df, cfg).collect()}
    assert b == {"a.claude-opus-sonnet": ("opus", Decimal("0.000005")), "zzz": (None, Decimal("0.000003")),
                 None: (None, Decimal("0.000003"))}
    assert a["a.claude-opus-sonnet"] == Decimal("5") and a["zzz"] == Decimal("15")
    assert a[None] == Decimal("3.75") + Decimal("0.3")


def test_ledger_replay_is_idempotent(spark):  # E14
    path = fresh_path(spark, "tests", "ledger")
    inv = spark.createDataFrame(
        [(1, "u", "m", "2024-01", 1, 2, 0, 0, datetime(2024, 1, 2)), (2, "u", "m", "2024-01", 3, 4, 0, 0, datetime(2024, 1, 3))],
        "batch_id long, user string, model_id string, month string, input_tokens long, output_tokens long, "
        "cache_write_tokens long, cache_read_tokens long, ts timestamp")
    parts = ledger.batch_partials(inv)
    ledger.write_partials(parts, path)
    ledger.write_partials(parts.where("batch_id = 2"), path)
    u = ledger.read_usage(spark, path).collect()
    assert [(r["input_tokens"], r["output_tokens"], r["invocations"]) for r in u] == [(4, 6, 2)]


def test_top_n_with_others_sums_to_total(spark):
    df = spark.createDataFrame([(f"u{i}", Decimal(i), i) for i in range(1, 8)], "user string, cost decimal(38,12), total_tokens long")
    out = dashboard.top_n_with_others(df, "user", 3, ["cost", "total_tokens"]).orderBy("rank").collect()
    assert [r["user"] for r in out] == ["u7", "u6", "u5", "Others (4)"]
    assert sum(r["cost_usd"] for r in out) == 28.0
    assert len(dashboard.top_n_with_others(df, "user", 10, ["cost", "total_tokens"]).collect()) == 7


def _audits(spark, rows):
    return spark.createDataFrame(rows, "user string, month string, at timestamp, mode string")


def test_throttle_gap_rule(spark):  # E12, E13
    t0 = datetime(2024, 1, 1)
    every5 = [("u", "m", t0 + timedelta(minutes=5 * i), "DRYRUN") for i in range(300)]
    n = enforcement.throttle(_audits(spark, every5), CFG).where("notify").count()
    assert n == 1
    mixed = [("u", "m", t0, "DRYRUN"), ("u", "m", t0 + timedelta(minutes=20), "SKIPPED"),
             ("u", "m", t0 + timedelta(minutes=40), "DRYRUN")]
    assert enforcement.throttle(_audits(spark, mixed), CFG).where("notify").count() == 2
    twice = [("u", "m", t0, "ERROR"), ("u", "m", t0 + timedelta(hours=24), "ERROR"),
             ("u", "m", t0 + timedelta(hours=25), "REMOVED"), ("u", "m", t0 + timedelta(hours=26), "REMOVED")]
    assert enforcement.throttle(_audits(spark, twice), CFG).where("notify").count() == 4


def test_decisions_precedence(spark):  # E11 (without a failing delete: REMOVED wins)
    cfg = CFG.with_(enforce_enabled=True, enforce_dry_run=False, identity_store_id="s",
                    group_ids=("g1", "g2"), group_names=("G3", "missing"))
    over = spark.createDataFrame([("alice", "2024-01"), ("bob", "2024-01"), ("carol", "2024-01"), ("unknown", "2024-01")],
                                 "user string, month string")
    users = spark.createDataFrame([("alice", "ua"), ("bob", "ub")], "user_name string, user_id string")
    groups = spark.createDataFrame([("G3", "g3"), ("Other", "g9")], "display_name string, group_id string")
    mem = spark.createDataFrame([("g1", "ua", "m1"), ("g3", "ua", "m3"), ("g9", "ub", "m9")],
                                "group_id string, user_id string, membership_id string")
    targets = enforcement.group_targets(groups, cfg)
    assert sorted((r["ord"], r["group_id"]) for r in targets.collect()) == [(0, "g1"), (1, "g2"), (2, "g3")]
    dec = enforcement.decisions_text(enforcement.decisions(enforcement.candidates(over, cfg), users, mem, targets, cfg))
    got = {r["user"]: r for r in dec.collect()}
    assert set(got) == {"alice", "bob", "carol"}
    assert got["alice"]["mode"] == "REMOVED"
    assert got["alice"]["removed_groups"] == "g1 (g1, membership=m1); G3 (g3, membership=m3)"
    assert got["alice"]["skipped_groups"] == "g2 (g2, reason=not_a_member)"
    assert got["bob"]["mode"] == "SKIPPED"
    assert got["carol"]["mode"] == "ERROR" and got["carol"]["reason"] == "user_unresolved"
    off = enforcement.candidates(over, CFG)
    assert off.count() == 0


def test_price_table_of_any_size(spark):
    entries = tuple(PriceEntry(f"m{i:03d}", (str(i + 1), str(2 * i + 1))) for i in range(400))
    cfg = MeterConfig(prices=entries + MeterConfig().prices)
    df = spark.createDataFrame([(f"x-m{i:03d}-y", 1000, 10, 5, 7) for i in range(0, 400, 7)]
                               + [("opus", 1, 1, 1, 1), ("zzz", 3, 3, 3, 3), ("x-M003-m001", 1000, 10, 5, 7)],
                               "model_id string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long")
    got = {r["model_id"]: r["cost"] for r in pricing.with_cost(df, cfg).collect()}
    million = Decimal(1_000_000)
    cost = lambda i: (Decimal(1000) * (i + 1) + Decimal(10) * (2 * i + 1) + Decimal(5) * (i + 1) * Decimal("1.25")
                      + Decimal(7) * (i + 1) * Decimal("0.10")) / million
    assert got == {**{f"x-m{i:03d}-y": cost(i) for i in range(0, 400, 7)}, "x-M003-m001": cost(1),
                   "opus": (Decimal(5) + 25 + Decimal("6.25") + Decimal("0.5")) / million,
                   "zzz": 3 * (Decimal(3) + 15 + Decimal("3.75") + Decimal("0.3")) / million}


def test_dashboard_views_share_one_cached_detail(spark, sf):
    from meterwise.plans import catalog, fixtures as fx
    v = dashboard.DashboardViews(catalog.f1_priced(spark, sf), fx.F1_CFG, fx.TABLE_FILTERS)
    try:
        k = v.kpis().collect()[0]
        assert k["users"] == v.users().select("user").distinct().count()
        top = v.top_users().collect()
        assert abs(sum(r["cost_usd"] for r in top) - k["total_spend_usd"]) < 1e-9
        assert v.heatmap().count() == min(fx.F1_CFG.top_n, k["users"]) * k["models"]
        assert v.histogram().agg(F.sum("users")).collect()[0][0] == v.users().count()
    finally:
        v.close()


def test_per_window_throttle_is_an_ordered_fold(spark):
    import random
    from datetime import datetime, timedelta
    rng = random.Random(4)
    rows = []
    for u in range(12):
        t = datetime(2024, 1, 1)
        for _ in range(rng.randint(1, 60)):
            t += timedelta(minutes=rng.choice([5, 5, 300, 1435, 1440, 1500]))
            rows.append((f"u{u}", "2024-01", t, rng.choice(["DRYRUN"] * 5 + ["ERROR", "SKIPPED", "REMOVED"]), rng.random() > 0.1))
    want, last = {}, {}
    for user, month, at, mode, can in sorted(rows):
        before = last.get(user)
        quiet = before is not None and before[1] == mode and (at - before[0]).total_seconds() < 24 * 3600
        send = can and (mode == "REMOVED" or (mode in ("DRYRUN", "ERROR") and not quiet))
        if send:
            last[user] = (at, mode)
        want[user, at] = send
    df = spark.createDataFrame(rows, "user string, month string, at timestamp, mode string, notifiable boolean")
    got = {(r["user"], r["at"]): r["notify"] for r in enforcement.throttle(df, CFG.with_(throttle="per_window")).collect()}
    assert got == want and got != {(r["user"], r["at"]): r["notify"] for r in enforcement.throttle(df, CFG).collect()}
