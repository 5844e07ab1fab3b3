"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each reads the driver tables (or data Spark derives from them) and returns
a DataFrame whose column names match the oracle SQL in
:mod:`meterwise.plans.oracle`. Money leaves as DOUBLE cast from exact
decimals; counters as BIGINT; times as ``yyyy-MM-dd HH:mm:ss`` text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterwise.config import price_entries_from_json
from meterwise.functions import budget, pricing, text
from meterwise.functions.models import short_model
from meterwise.functions.pricing import TOKEN_COLS
from meterwise.operators import alerts, dashboard, leaderboard, metrics, rollup
from meterwise.plans import fixtures as fx
from meterwise.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _ts_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# -------------------------------------------------------------------------
# shared building blocks
# -------------------------------------------------------------------------
def f1_inv(spark, sf):
    return tables.invocations_from_events(spark, sf)


def f1_usage(spark, sf):
    return rollup.usage_rollup(f1_inv(spark, sf))


def f1_priced(spark, sf):
    return rollup.priced_usage(f1_usage(spark, sf), fx.F1_CFG)


def f3_usage(spark, sf):
    return rollup.usage_rollup(tables.invocations_from_orders(spark, sf))


def f1_detail(spark, sf):
    return dashboard.with_user_spend(dashboard.detail_frame(f1_priced(spark, sf)), fx.F1_CFG)


def _detail_out(d: DataFrame) -> DataFrame:
    return d.select(*dashboard.DETAIL_COLS)


def _row_status_out(d: DataFrame) -> DataFrame:
    return d.select(*dashboard.DETAIL_COLS, "user_month_spend", "pct", "pct_display", "status")


def f1_user_table(spark, sf, flt=None):
    d = f1_detail(spark, sf)
    d = dashboard.apply_filters(d, flt or fx.TABLE_FILTERS)
    return dashboard.user_spend_table(d, fx.F1_CFG)


def _user_table_out(u: DataFrame) -> DataFrame:
    return u.select("user", "month", "cost_usd", *TOKEN_COLS, "total_tokens", "invocations",
                    "pct", "pct_display", "status")


# -------------------------------------------------------------------------
# step 1: minimum slice
# -------------------------------------------------------------------------
@register("user_month_spend")
def q_user_month_spend(spark, sf):
    """A6 + P8-P12: each user's month spend over all models and status."""
    return rollup.user_month_spend(f1_priced(spark, sf), fx.F1_CFG).drop("cost")


@register("usage_rollup")
def q_usage_rollup(spark, sf):
    """A2: stored usage row per (user, model_id, month)."""
    u = f1_usage(spark, sf)
    return u.select(*rollup.USAGE_KEYS, *rollup.COUNTER_COLS)


@register("row_cost")
def q_row_cost(spark, sf):
    """P10: exact cost per usage row."""
    p = f1_priced(spark, sf)
    return p.select(*rollup.USAGE_KEYS, *TOKEN_COLS, pricing.usd(F.col("cost")).alias("cost_usd"))


@register("model_rates")
def q_model_rates(spark, sf):
    """First-match rates per observed model."""
    u = f1_usage(spark, sf)
    per_model = u.groupBy("model_id").agg(F.sum("invocations").cast("bigint").alias("invocations"))
    r = pricing.with_rates(per_model, fx.F1_CFG)
    return r.select("model_id", "matched_pattern", "invocations",
                    *[(F.col(n) * F.lit(1_000_000)).cast("double").alias(n) for n in pricing.RATE_NAMES])


@register("price_override")
def q_price_override(spark, sf):
    """Cost per model under a price table given as JSON, with two, three and four rates a row
    and in no sorted order, and under a text that is none (the default table)."""
    usage = f1_usage(spark, sf)
    rows = None
    for name, value in fx.PRICE_TEXTS:
        cfg = fx.F1_CFG.with_(prices=price_entries_from_json(value))
        part = rollup.model_totals(usage, cfg).select(F.lit(name).alias("prices"), "model_id", "total_tokens",
                                                      pricing.usd(F.col("cost")).alias("cost_usd"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@register("price_table")
def q_price_table(spark, sf):
    """The normalized price table with the invocations each entry
    priced (first match; the fallback row has pattern NULL)."""
    u = f1_usage(spark, sf)
    per_model = u.groupBy("model_id").agg(F.sum("invocations").alias("n"))
    matched = per_model.withColumn("pattern", pricing.matched_pattern(F.col("model_id"), fx.F1_CFG))
    counts = matched.groupBy("pattern").agg(F.sum("n").cast("bigint").alias("invocations"))
    p = pricing.price_frame(spark, fx.F1_CFG)
    from meterwise.functions.broadcast import bounded
    # counts has at most one row per price pattern (+ the fallback row)
    j = p.join(bounded(counts, len(fx.F1_CFG.prices) + 1), p["pattern"].eqNullSafe(counts["pattern"]),
               "left").drop(counts["pattern"])
    return j.select("priority", "pattern", *[F.col(n).cast("double").alias(n) for n in pricing.RATE_NAMES],
                    F.coalesce(F.col("invocations"), F.lit(0).cast("bigint")).alias("invocations"))


@register("budget_status")
def q_budget_status(spark, sf):
    """P11 on F3 (orders, 80 months, budget 2.00): status per user-month."""
    p = rollup.priced_usage(f3_usage(spark, sf), fx.F3_CFG)
    return rollup.user_month_spend(p, fx.F3_CFG).select("user", "month", "cost_usd", "status")


@register("budget_pct")
def q_budget_pct(spark, sf):
    """Reader percent and dashboard display percent per user-month."""
    p = rollup.priced_usage(f3_usage(spark, sf), fx.F3_CFG)
    s = rollup.user_month_spend(p, fx.F3_CFG)
    frac = budget.budget_fraction(F.col("cost_usd"), fx.F3_CFG)
    return s.select("user", "month", "cost_usd", "pct_of_budget",
                    budget.pct_display(frac).alias("pct_display"))


@register("over_budget_users")
def q_over_budget_users(spark, sf):
    """F8: user-months at or over budget."""
    s = rollup.user_month_spend(f1_priced(spark, sf), fx.F1_CFG)
    return alerts.over_budget(s, fx.F1_CFG, "cost").select("user", "month", "cost_usd")


# -------------------------------------------------------------------------
# step 2: rollups and leaderboards
# -------------------------------------------------------------------------
@register("model_totals")
def q_model_totals(spark, sf):
    """A3: five measures, invocations and cost per model."""
    m = rollup.model_totals(f1_usage(spark, sf), fx.F1_CFG)
    return m.select("model_id", *TOKEN_COLS, "total_tokens", "invocations",
                    pricing.usd(F.col("cost")).alias("cost_usd"))


def f1_priced_month(spark, sf, month):
    """Priced usage of one month; the month is pushed to the scan as a ts range."""
    inv = tables.invocations_from_events(spark, sf, month)
    return rollup.priced_usage(rollup.usage_rollup(inv), fx.F1_CFG)


@register("leaderboard")
def q_leaderboard(spark, sf):
    """Top 25 users by month spend."""
    return leaderboard.spend_leaderboard(f1_priced_month(spark, sf, fx.F1_MONTH), fx.F1_CFG, fx.F1_MONTH)


@register("model_leaderboard")
def q_model_leaderboard(spark, sf):
    """Top 10 users per model."""
    return leaderboard.model_leaderboard(f1_priced_month(spark, sf, fx.F1_MONTH), fx.F1_CFG, fx.F1_MONTH)


@register("top_users_model_month")
def q_top_users_model_month(spark, sf):
    """Top users by total tokens per (model, month), on F3."""
    return leaderboard.top_users_model_month(f3_usage(spark, sf), fx.TOP_MODEL_MONTH_N)


@register("detail_rows")
def q_detail_rows(spark, sf):
    """Dashboard detail rows (11 columns)."""
    return _detail_out(dashboard.detail_frame(f1_priced(spark, sf)))


@register("detail_with_user_spend")
def q_detail_with_user_spend(spark, sf):
    """All-model user-month spend on each row, row status."""
    return _row_status_out(f1_detail(spark, sf))


@register("user_spend_table")
def q_user_spend_table(spark, sf):
    """A10: per (user, month) over filtered rows, status recomputed."""
    return _user_table_out(f1_user_table(spark, sf))


@register("short_model")
def q_short_model(spark, sf):
    """Short model names on F3, where two ids share one short name."""
    u = f3_usage(spark, sf)
    g = u.groupBy("model_id").agg(F.sum("invocations").cast("bigint").alias("invocations"))
    return g.select("model_id", short_model(F.col("model_id")).alias("model"), "invocations")


@register("usage_normalise")
def q_usage_normalise(spark, sf):
    """F3 usage stored without cache counters -> zero-filled BIGINTs."""
    u = f3_usage(spark, sf).drop("cache_write_tokens", "cache_read_tokens", "total_tokens")
    n = rollup.total_tokens(dashboard.normalise_usage(u).drop("total_tokens"))
    return n.select(*rollup.USAGE_KEYS, *rollup.COUNTER_COLS)


# -------------------------------------------------------------------------
# step 3: filters, KPIs, top-N, pivot, histogram, notices, what-if
# -------------------------------------------------------------------------
@register("user_search")
def q_user_search(spark, sf):
    """case-insensitive regex search on the user label."""
    d = dashboard.user_search(f1_detail(spark, sf), fx.SEARCH.user_query, fx.SEARCH.regex)
    return _row_status_out(d)


@register("dashboard_filters")
def q_dashboard_filters(spark, sf):
    """F5 + F6: model and status membership, minimum all-model spend."""
    return _row_status_out(dashboard.apply_filters(f1_detail(spark, sf), fx.FILTERS))


@register("kpi_tiles")
def q_kpi_tiles(spark, sf):
    """Users, models, spend, tokens, warning and breach counts."""
    d = dashboard.apply_filters(f1_detail(spark, sf), fx.TABLE_FILTERS)
    return dashboard.kpi_tiles(d, fx.F1_CFG)


@register("top_users_others")
def q_top_users_others(spark, sf):
    """Top 15 users by spend plus an Others (k) row."""
    d = dashboard.apply_filters(f1_detail(spark, sf), fx.TABLE_FILTERS)
    return dashboard.top_n_with_others(d, "user", fx.F1_CFG.top_n, ["cost", "total_tokens"])


@register("top_models_others")
def q_top_models_others(spark, sf):
    """Top models by spend (Others only when there are more than N)."""
    d = dashboard.apply_filters(f1_detail(spark, sf), fx.TABLE_FILTERS)
    return dashboard.top_n_with_others(d, "model", fx.F1_CFG.top_n, ["cost", "input_tokens", "output_tokens"])


@register("user_model_heatmap")
def q_user_model_heatmap(spark, sf):
    """A13 + J4 + T3 + P18: top users x models pivot, long form, log1p."""
    return dashboard.user_model_heatmap(f1_detail(spark, sf), fx.F1_CFG.top_n)


@register("spend_histogram")
def q_spend_histogram(spark, sf):
    """Per-user spend in 40 equal-width bins."""
    return dashboard.spend_histogram(f1_user_table(spark, sf), fx.HIST_BINS)


@register("usage_notice")
def q_usage_notice(spark, sf):
    """R3 + J9: usage notices for the users whose all-model spend is in
    Breach, built from the filtered rows."""
    full = f1_detail(spark, sf)
    d = dashboard.apply_filters(full, fx.TABLE_FILTERS)
    u = dashboard.user_spend_table(d, fx.F1_CFG)
    sel = full.where(F.col("status") == "Breach").select("user", "month").distinct()
    return dashboard.usage_notices(u, d, sel, fx.F1_CFG, fx.ACTOR)


@register("what_if_budget")
def q_what_if_budget(spark, sf):
    """Status counts under several candidate budgets."""
    s = rollup.user_month_spend(f1_priced(spark, sf), fx.F1_CFG)
    return dashboard.what_if_budget(s, list(fx.WHAT_IF_BUDGETS), fx.F1_CFG)


# -------------------------------------------------------------------------
# step 4: metrics
# -------------------------------------------------------------------------
@register("metrics_by_model")
def q_metrics_by_model(spark, sf):
    """A4: per-model + total metric documents."""
    return metrics.metrics_by_model(rollup.model_totals(f1_usage(spark, sf), fx.F1_CFG))


@register("metrics_cube")
def q_metrics_cube(spark, sf):
    """A5: CUBE(user, model) of token and invocation measures."""
    return metrics.metrics_cube(f1_inv(spark, sf))


@register("series_5m_total")
def q_series_5m_total(spark, sf):
    """5-minute event-time totals."""
    s = metrics.series_total(f1_inv(spark, sf), fx.F1_CFG)
    return s.withColumn("window_start", _ts_text(F.col("window_start")))


@register("series_5m_by_model")
def q_series_5m_by_model(spark, sf):
    """5-minute event-time series per model."""
    s = metrics.series_by_model(f1_inv(spark, sf), fx.F1_CFG)
    return s.withColumn("window_start", _ts_text(F.col("window_start")))


@register("metric_rows")
def q_metric_rows(spark, sf):
    """Long metric rows (dims, name, value)."""
    return metrics.metric_rows(q_metrics_by_model(spark, sf))


# -------------------------------------------------------------------------
# step 6: before/after spend and alerts
# -------------------------------------------------------------------------
def _f1_before_after(spark, sf):
    d = alerts.spend_delta(f1_inv(spark, sf), fx.F1_CFG)
    return alerts.spend_before_after(d)


@register("spend_delta")
def q_spend_delta(spark, sf):
    """Cost added per (user, month) by each 5-minute run."""
    d = alerts.spend_delta(f1_inv(spark, sf), fx.F1_CFG)
    return d.select("user", "month", _ts_text(F.col("run")).alias("run"),
                    pricing.usd(F.col("delta")).alias("delta_usd"))


@register("spend_before_after")
def q_spend_before_after(spark, sf):
    """Prev and new month spend around each run."""
    b = _f1_before_after(spark, sf)
    return b.select("user", "month", _ts_text(F.col("run")).alias("run"),
                    pricing.usd(F.col("delta")).alias("delta_usd"),
                    pricing.usd(F.col("prev_cost")).alias("prev_usd"),
                    pricing.usd(F.col("new_cost")).alias("new_usd"))


@register("spend_alerts")
def q_spend_alerts(spark, sf):
    """ST6 + F7: first crossings of warn level and budget, per run."""
    a = alerts.spend_alerts(_f1_before_after(spark, sf), fx.F1_CFG)
    return a.select("user", "month", _ts_text(F.col("run")).alias("run"), "level",
                    pricing.usd(F.col("boundary")).alias("boundary_usd"),
                    pricing.usd(F.col("prev_cost")).alias("prev_usd"),
                    pricing.usd(F.col("new_cost")).alias("new_usd"))


@register("token_crossings")
def q_token_crossings(spark, sf):
    """W2 / ST7: per-event token boundary crossings per (user, model, month)."""
    return alerts.token_crossings(f1_inv(spark, sf), fx.F1_CFG)


# -------------------------------------------------------------------------
# step 5: raw invocation logs (fixture F2 written by Spark from events)
# -------------------------------------------------------------------------
from meterwise.functions import invocation as inv_fn  # noqa: E402
from meterwise.functions import variant as V  # noqa: E402
from meterwise.sources import log_scan, raw_records, record_stream  # noqa: E402

F2_REGIONS = ("us-east-1", "eu-west-1")


def f2_layout(spark, sf):
    root = raw_records.write_log_fixture(spark, sf)
    return log_scan.LogLayout(raw_records.log_base(root), hive=True)


def f2_files(spark, sf, regions=None, hours=None):
    lay = f2_layout(spark, sf)
    files = log_scan.scan_files(spark, log_scan.load_paths(lay, regions, hours))
    return log_scan.with_path_parts(files)


def _file_month(files_df):
    return F.date_format(F.col("modified"), "yyyy-MM")


def f2_invocations(spark, sf, regions=None):
    files = f2_files(spark, sf, regions)
    return log_scan.decode_invocations(files, _file_month(files))


def _inv_out(d):
    return d.select("request_id", _ts_text(F.col("ts")).alias("ts"), "user", "model_id", "month", *TOKEN_COLS)


def f2_records(spark, sf):
    """Raw records in memory (parsed VARIANT), without the file layer: the
    well-formed ones and, with ids "odd-...", those of every other form."""
    r = raw_records.raw_records(spark, sf).select("event_id", "json")
    odd = raw_records.odd_records(spark, sf).select("event_id", F.replace("json", F.lit('"req-'), F.lit('"odd-')).alias("json"))
    return r.unionByName(odd).select("event_id", F.parse_json("json").alias("rec"))


@register("log_scan")
def q_log_scan(spark, sf):
    """One row per log object (region, hour, object key), read whole."""
    f = f2_files(spark, sf)
    return f.select("object_key", "region", "hour", ((F.col("size") > 0) & (F.length("text") > 0)).alias("has_content"))


@register("decode_records")
def q_decode_records(spark, sf):
    """S6 + P1-P7 + F1: every file shape decoded back to invocations."""
    return _inv_out(f2_invocations(spark, sf))


def f2_record_stream(spark, sf):
    records = record_stream.scan_records(spark, log_scan.load_paths(f2_layout(spark, sf), None, None))
    return log_scan.with_path_parts(record_stream.decode_scanned(records))


@register("decode_streamed")
def q_decode_streamed(spark, sf):
    """S6 record by record: every file shape without a whole text in memory."""
    recs = f2_record_stream(spark, sf)
    recs = recs.where(F.col("rec").isNotNull())
    return _inv_out(inv_fn.canonical(recs, _file_month(recs), "rec", "offset", F.col("modified")))


@register("malformed_streamed")
def q_malformed_streamed(spark, sf):
    """S6 / F2 record by record: records and malformed items of each object."""
    return f2_record_stream(spark, sf).groupBy("object_key").agg(
        F.count("rec").alias("records"), F.sum("malformed").alias("malformed"))


@register("region_pruned_scan")
def q_region_pruned_scan(spark, sf):
    """Only the listed region directories are loaded and decoded."""
    return _inv_out(f2_invocations(spark, sf, list(F2_REGIONS))).withColumnRenamed("request_id", "request_id")


@register("identity_label")
def q_identity_label(spark, sf):
    """User label from the identity block (all ARN shapes)."""
    r = f2_records(spark, sf)
    return r.select(V.text(V.field(F.col("rec"), "$.requestId")).alias("request_id"),
                    inv_fn.identity_label(F.col("rec")).alias("user"))


@register("token_extract")
def q_token_extract(spark, sf):
    """Four token counts through the fallback chain."""
    r = inv_fn.with_tokens(f2_records(spark, sf), "rec")
    return r.select(V.text(V.field(F.col("rec"), "$.requestId")).alias("request_id"), *TOKEN_COLS)


@register("token_coerce")
def q_token_coerce(spark, sf):
    """Integer coercion (numeric strings, numbers) of the four counts."""
    r = inv_fn.with_tokens(f2_records(spark, sf), "rec")
    kind = V.kind(V.first_truthy(*[V.field(F.col("rec"), p) for p in inv_fn.INPUT_FIELDS]))
    return r.select(V.text(V.field(F.col("rec"), "$.requestId")).alias("request_id"),
                    F.coalesce(kind, F.lit("MISSING")).alias("input_kind"), *TOKEN_COLS)


@register("month_bucket")
def q_month_bucket(spark, sf):
    """P5: month of the timestamp as written."""
    r = f2_records(spark, sf)
    return r.select(V.text(V.field(F.col("rec"), "$.requestId")).alias("request_id"),
                    inv_fn.month_bucket(F.col("rec"), F.lit("1970-01")).alias("month"))


@register("stream_usage_last_wins")
def q_stream_usage_last_wins(spark, sf):
    """Usage object from the output body (last usage wins in arrays)."""
    r = f2_records(spark, sf)
    u = inv_fn.usage_object(F.col("rec"))
    return r.select(V.text(V.field(F.col("rec"), "$.requestId")).alias("request_id"),
                    *[F.coalesce(V.to_int(V.field(u, "$." + f)), F.lit(0).cast("bigint")).alias("usage_" + f)
                      for f in inv_fn.USAGE_FIELDS])


@register("schema_type_filter")
def q_schema_type_filter(spark, sf):
    """records kept by the schema-type rule, with their schemaType."""
    r = f2_records(spark, sf)
    kept = r.where(inv_fn.schema_type_ok(F.col("rec")))
    return kept.select(V.text(V.field(F.col("rec"), "$.requestId")).alias("request_id"),
                       V.text(V.field(F.col("rec"), "$.schemaType")).alias("schema_type"))


@register("object_rollup")
def q_object_rollup(spark, sf):
    """A1: per (object, user, model, month) partial sums."""
    d = f2_invocations(spark, sf)
    return rollup.object_rollup(d, "object_key")


@register("malformed_count")
def q_malformed_count(spark, sf):
    """per object, records decoded and lines dropped as malformed."""
    dec = log_scan.decode_records(f2_files(spark, sf))
    return dec.groupBy("object_key").agg(
        F.count("rec").alias("records"), F.max("malformed").alias("malformed"))


@register("hour_prefixes")
def q_hour_prefixes(spark, sf):
    """S3: hour prefixes from floor(first event) to floor(last event)."""
    ev = tables.table(spark, sf, "events").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return log_scan.hour_prefixes_df(ev)


@register("scan_window")
def q_scan_window(spark, sf):
    """S5 / ST10: scan cut-off of each scheduled run, with the previous run
    as checkpoint (none for the first run), 15 min / 7 day look-backs."""
    runs = f1_inv(spark, sf).select(F.window("ts", fx.F1_CFG.schedule).start.alias("now")).distinct()
    d = log_scan.previous_run(runs, "now")
    cut = log_scan.scan_window(F.col("now"), F.col("checkpoint"), fx.F1_CFG.lookback_minutes,
                               fx.F1_CFG.max_lookback_minutes)
    return d.select(_ts_text(F.col("now")).alias("now"), _ts_text(F.col("checkpoint")).alias("checkpoint"),
                    _ts_text(cut).alias("cutoff"))


@register("modified_since")
def q_modified_since(spark, sf):
    """Two deliveries of the log, days 1-14 and then the rest; the objects
    modified after the last one of the first delivery."""
    base = raw_records.log_base(fresh_path(spark, "runs", "deliveries"))
    records, day = raw_records.raw_records(spark, sf, by_object=True), F.dayofmonth("ts")
    raw_records.write_logs(records.where(day < 15), base, "overwrite", by_object=True)
    everything = log_scan.load_paths(log_scan.LogLayout(base, hive=True), None, None)
    last = log_scan.list_objects(spark, everything).agg(F.max("modified")).first()[0]
    raw_records.write_logs(records.where(day >= 15), base, "append", by_object=True)
    files = log_scan.scan_files_robust(spark, everything, since=last + timedelta(milliseconds=1))
    return log_scan.with_path_parts(files).select("object_key")


@register("run_summary")
def q_run_summary(spark, sf):
    """The counts that a scheduled run itself wrote (objects seen and
    read, damaged lines, records, users, regions)."""
    runs = rollup_stream.read_runs(spark, _scheduled_run(spark, sf).runs)
    return runs.select("objects_seen", "regions", "objects_processed", "objects_unreadable", "malformed",
                       "records_processed", "records_skipped", "users_touched")


# -------------------------------------------------------------------------
# subscription payloads, ledger, streaming, sinks
# -------------------------------------------------------------------------
from meterwise.session import fresh_path  # noqa: E402
from meterwise.sources import ledger, subscription  # noqa: E402
from meterwise.streaming import outbox, rollup_stream, series_stream  # noqa: E402


@register("decode_subscription")
def q_decode_subscription(spark, sf):
    """base64+gzip envelopes (written once by Spark from events) ->
    log events -> invocations."""
    env = spark.read.parquet(raw_records.write_envelope_fixture(spark, sf))
    ev = subscription.decode_envelopes(env)
    return _inv_out(subscription.subscription_invocations(ev))


@register("event_rollup")
def q_event_rollup(spark, sf):
    """S7 as a stream: envelopes delivered twice, some of them late, into counters; nothing counts twice."""
    return ledger.read_usage(spark, _event_run(spark, sf).ledger).select(*rollup.USAGE_KEYS, *rollup.COUNTER_COLS)


@register("event_token_alerts")
def q_event_token_alerts(spark, sf):
    """ST7 on the event path: token alerts of the envelope stream (columns no batch boundary changes)."""
    return rollup_stream.read_token_alerts(spark, _event_run(spark, sf).token_alerts).select(
        "level", "user", "model_id", "month", "boundary", "subject")


def _event_run(spark, sf):
    from meterwise.streaming import event_stream
    root = fresh_path(spark, "runs", "events")
    env = spark.read.parquet(raw_records.write_envelope_fixture(spark, sf))
    env.write.parquet(f"{root}/in")
    env.where(F.col("block") % 3 == 0).write.mode("append").parquet(f"{root}/in")  # delivered again
    paths = rollup_stream.StreamPaths.under(root)
    event_stream.run_event_stream(spark, f"{root}/in", paths, f"{root}/seen", fx.F1_CFG, max_files_per_trigger=4)
    return paths


@register("usage_counters")
def q_usage_counters(spark, sf):
    """Per-day batches written to the ledger, one batch replayed, read
    back as counters (the replay changes nothing)."""
    path = fresh_path(spark, "runs", "ledger")
    inv = f1_inv(spark, sf).withColumn("batch_id", F.dayofmonth("ts").cast("bigint"))
    parts = ledger.batch_partials(inv)
    ledger.write_partials(parts, path)
    ledger.write_partials(parts.where(F.col("batch_id") == 15), path)   # replay of one batch
    u = ledger.read_usage(spark, path)
    return u.select(*rollup.USAGE_KEYS, *rollup.COUNTER_COLS)


@register("usage_month_scan")
def q_usage_month_scan(spark, sf):
    """S8 + F3: month-partitioned usage table read for one month (the month
    filter is a partition filter)."""
    path = fresh_path(spark, "runs", "usage")
    inv = tables.invocations_from_orders(spark, sf).withColumn("batch_id", F.lit(0).cast("bigint"))
    ledger.write_partials(ledger.batch_partials(inv), path)
    u = ledger.read_usage(spark, path, fx.F3_MONTH)
    return u.select(*rollup.USAGE_KEYS, *rollup.COUNTER_COLS)


def _stream_run(spark, sf, max_files=500):
    lay = f2_layout(spark, sf)
    paths = rollup_stream.StreamPaths.under(fresh_path(spark, "runs", "stream"))
    rollup_stream.run_rollup_stream(spark, lay, paths, fx.F1_CFG, max_files_per_trigger=max_files)
    return paths


@register("stream_rollup")
def q_stream_rollup(spark, sf):
    """ST1-ST3: the rollup stream (availableNow, bounded batches) over the
    log folder; ledger totals equal the one-shot batch rollup."""
    paths = _stream_run(spark, sf)
    return ledger.read_usage(spark, paths.ledger).select(*rollup.USAGE_KEYS, *rollup.COUNTER_COLS)


_ALERT_COLS = ("level", "user", "month", "boundary_usd", "subject")


@register("scheduled_rollup")
def q_scheduled_rollup(spark, sf):
    """ST1 as a scheduled batch run: hour-prefix listing of the scan window,
    marker anti-join, ledger partition of the run. One catch-up run from the
    first event hour to the last event; totals equal the one-shot rollup."""
    paths = _scheduled_run(spark, sf)
    return ledger.read_usage(spark, paths.ledger).select(*rollup.USAGE_KEYS, *rollup.COUNTER_COLS)


def _scheduled_run(spark, sf):
    from meterwise.streaming import scheduled
    b = tables.table(spark, sf, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()[0]
    root = fresh_path(spark, "runs", "scheduled")
    paths = rollup_stream.StreamPaths.under(root)
    scheduled.run_scheduled_rollup(spark, f2_layout(spark, sf), paths, f"{root}/markers", fx.F1_CFG, 1,
                                   now=b["b"], start_ts=b["a"].replace(minute=0, second=0, microsecond=0))
    return paths


@register("stream_token_alerts")
def q_stream_token_alerts(spark, sf):
    """ST7 in the stream: token alerts that the batches wrote; which event crossed depends on the
    order of delivery, so the columns are those no batch boundary changes."""
    paths = rollup_stream.StreamPaths.under(fresh_path(spark, "runs", "token_alerts"))
    rollup_stream.run_rollup_stream(spark, f2_layout(spark, sf), paths, fx.F1_CFG.with_(token_alerts=True),
                                    max_files_per_trigger=500)
    return rollup_stream.read_token_alerts(spark, paths.token_alerts).select(
        "level", "user", "model_id", "month", "boundary", "subject")


@register("notice_outbox")
def q_notice_outbox(spark, sf):
    """S12 + R3: the outbox after a stream with spend and token alerts and a report of usage notices,
    all of which are sent again at the end; which batch crossed decides the texts, so subjects only."""
    paths = rollup_stream.StreamPaths.under(fresh_path(spark, "runs", "outbox"), with_outbox=True)
    rollup_stream.run_rollup_stream(spark, f2_layout(spark, sf), paths, fx.F1_CFG.with_(token_alerts=True),
                                    max_files_per_trigger=500)
    usage = outbox.usage_notices(q_usage_notice(spark, sf))
    outbox.send([usage], paths.outbox, "report")
    found = [outbox.spend_notices(rollup_stream.read_alerts(spark, paths.alerts)),
             outbox.token_notices(rollup_stream.read_token_alerts(spark, paths.token_alerts))]
    outbox.send([*found, usage], paths.outbox, "report")
    return outbox.read_outbox(spark, paths.outbox).select("kind", "level", "user", "month", "subject")


@register("token_alert_text")
def q_token_alert_text(spark, sf):
    """Subject and body of the token alerts."""
    r = alerts.token_alert_rows(alerts.token_crossings(f1_inv(spark, sf), fx.F1_CFG), fx.F1_CFG)
    return r.select("level", "user", "model_id", "month", "record_id", "subject", "body")


@register("stream_spend_alerts")
def q_stream_spend_alerts(spark, sf):
    """ST6 in a stream with keyed state (transformWithState, RocksDB):
    running month cost per (user, month), crossings per micro-batch."""
    from meterwise.streaming import spend_state
    root = fresh_path(spark, "runs", "state_alerts")
    spend_state.run_spend_alert_stream(spark, f2_layout(spark, sf), f"{root}/alerts", f"{root}/_checkpoint",
                                       fx.F1_CFG, max_files_per_trigger=500)
    return rollup_stream.read_alerts(spark, f"{root}/alerts").select(*_ALERT_COLS)


@register("alerts_sink")
def q_alerts_sink(spark, sf):
    """Alerts the stream wrote; amounts and bodies tell of the batch that
    crossed, so the columns are those no batch boundary changes."""
    paths = _stream_run(spark, sf)
    return rollup_stream.read_alerts(spark, paths.alerts).select(*_ALERT_COLS)


@register("late_data_policy")
def q_late_data_policy(spark, sf):
    """ST5: 5-minute series of the stream; a window is closed 10 minutes
    behind the latest event, and records that come later still count."""
    root = fresh_path(spark, "runs", "series")
    series_stream.run_series_stream(spark, f2_layout(spark, sf), f"{root}/out", f"{root}/_checkpoint", fx.F1_CFG,
                                    max_files_per_trigger=500)
    s = series_stream.read_series(spark, f"{root}/out", fx.F1_CFG)
    return s.withColumn("window_start", _ts_text(F.col("window_start")))


@register("alert_text")
def q_alert_text(spark, sf):
    """Subject and body of the spend alerts."""
    a = alerts.spend_alerts(_f1_before_after(spark, sf), fx.F1_CFG)
    r = alerts.alert_rows(a, fx.F1_CFG)
    return r.select("level", "user", "month", _ts_text(F.col("run")).alias("run"), "subject", "body")


@register("csv_export")
def q_csv_export(spark, sf):
    """User spend table written as CSV with a header, read back."""
    cols = ["user", "month", "cost_usd", "pct_display", "status", "total_tokens", "input_tokens",
            "output_tokens", "invocations"]
    path = fresh_path(spark, "runs", "csv")
    t = f1_user_table(spark, sf).select(*cols)
    t.write.option("header", True).csv(path)
    return spark.read.schema(t.schema).option("header", True).csv(path)


@register("unprocessed_objects")
def q_unprocessed_objects(spark, sf):
    """Objects listed by two overlapping scans, de-duplicated,
    minus the objects a previous run marked as processed (days 1-14)."""
    files = f2_files(spark, sf).select("path", "object_key", "hour")
    markers_path = fresh_path(spark, "runs", "markers")
    (files.where(F.substring("hour", 9, 2).cast("int") < 15)
          .select("path", F.current_timestamp().alias("processed_at"))
          .write.parquet(markers_path))
    markers = spark.read.parquet(markers_path).select("path")
    listed = files.unionByName(files.where(F.substring("hour", 9, 2).cast("int") >= 10))  # overlapping windows
    cand = listed.dropDuplicates(["path"])
    return cand.join(markers, "path", "left_anti").select("object_key")


@register("marker_expiry")
def q_marker_expiry(spark, sf):
    """ST4: object markers (one per order, written at the order date) kept
    while younger than the 45-day TTL at the latest marker time."""
    o = tables.table(spark, sf, "orders").select(
        F.concat(F.lit("obj-"), F.col("o_orderkey").cast("string")).alias("object"),
        F.col("o_orderdate").alias("processed_at"))
    as_of = o.select(F.max("processed_at")).scalar()
    keep = o.where(F.col("processed_at") >= as_of - F.expr(f"INTERVAL {fx.F1_CFG.marker_ttl_days} DAYS"))
    return keep.select("object", _ts_text(F.col("processed_at")).alias("processed_at"))


# -------------------------------------------------------------------------
# step 7: enforcement decisions
# -------------------------------------------------------------------------
from meterwise.operators import enforcement  # noqa: E402


def _over_budget_f1(spark, sf):
    s = rollup.user_month_spend(f1_priced(spark, sf), fx.ENFORCE_CFG)
    return alerts.over_budget(s, fx.ENFORCE_CFG, "cost")


def _decisions(spark, sf):
    cfg = fx.ENFORCE_CFG
    cands = enforcement.candidates(_over_budget_f1(spark, sf), cfg)
    targets = enforcement.group_targets(tables.directory_groups(spark, sf), cfg)
    return enforcement.decisions(cands, tables.directory_users(spark, sf),
                                 tables.directory_memberships(spark, sf), targets, cfg)


@register("enforcement_candidates")
def q_enforcement_candidates(spark, sf):
    """F9 + F10: over-budget user-months minus the allow-list."""
    c = enforcement.candidates(_over_budget_f1(spark, sf), fx.ENFORCE_CFG)
    return c.select("user", "month", "cost_usd")


@register("group_targets")
def q_group_targets(spark, sf):
    """Configured group ids and resolved names, de-duplicated."""
    return enforcement.group_targets(tables.directory_groups(spark, sf), fx.ENFORCE_CFG)


@register("enforcement_decisions")
def q_enforcement_decisions(spark, sf):
    """ST8 + ST9 + J5 + J7 + P17: decision per over-budget user-month."""
    return enforcement.decisions_text(_decisions(spark, sf))


def _audit_history(spark, sf):
    """Every run in which an enforcement candidate is touched and at/over
    budget writes an audit row with its decision."""
    b = _f1_before_after(spark, sf)
    runs = alerts.over_budget(b.where(F.col("delta") > 0), fx.ENFORCE_CFG, "new_cost").select("user", "month", "run")
    dec = _decisions(spark, sf)
    return runs.join(dec, ["user", "month"]).withColumnRenamed("run", "at")


@register("enforcement_throttle")
def q_enforcement_throttle(spark, sf):
    """Which audit rows send a notice (24 h gap rule)."""
    t = enforcement.throttle(_audit_history(spark, sf), fx.ENFORCE_CFG)
    return t.select("user", "month", _ts_text(F.col("at")).alias("at"), "mode", "notify")


@register("enforcement_per_window")
def q_enforcement_per_window(spark, sf):
    """W5, ``per_window``: which audit rows send a notice when silence is counted from the last notice sent."""
    t = enforcement.throttle(_audit_history(spark, sf), fx.ENFORCE_CFG.with_(throttle="per_window"))
    return t.select("user", "month", _ts_text(F.col("at")).alias("at"), "mode", "notify")


@register("enforcement_notices")
def q_enforcement_notices(spark, sf):
    """Enforcement notices that pass the throttle."""
    t = enforcement.throttle(_audit_history(spark, sf), fx.ENFORCE_CFG)
    n = enforcement.notices(t, fx.ENFORCE_CFG)
    return n.select("user", "month", _ts_text(F.col("at")).alias("at"), "level", "subject", "body")


@register("enforcement_audit")
def q_enforcement_audit(spark, sf):
    """S11 + J8: audit table (partitioned by month) and its latest row per
    (user, month)."""
    path = fresh_path(spark, "runs", "audit")
    enforcement.audit_rows(_audit_history(spark, sf), fx.ENFORCE_CFG).write.partitionBy("month").parquet(path)
    last = enforcement.latest_audit(spark.read.parquet(path))
    return last.select("user", "month", "mode", _ts_text(F.col("at")).alias("at"),
                       _ts_text(F.col("expire_at")).alias("expire_at"),
                       F.col("detail.userId").alias("user_id"))


@register("enforcement_run")
def q_enforcement_run(spark, sf):
    """ST8 / S11 in the stream, dry-run off: last audit of each (user, month)
    that the batches of the rollup stream wrote."""
    paths = rollup_stream.StreamPaths.under(fresh_path(spark, "runs", "enforce"))
    rollup_stream.run_rollup_stream(
        spark, f2_layout(spark, sf), paths, fx.REMOVE_CFG, max_files_per_trigger=500,
        directory=rollup_stream.Directory(tables.directory_users(spark, sf), tables.directory_groups(spark, sf),
                                          tables.directory_memberships(spark, sf)))
    last = enforcement.latest_audit(rollup_stream.read_audit(spark, paths.audit))
    return last.select("user", "month", "mode", F.col("detail.userId").alias("user_id"),
                       F.col("detail.reason").alias("reason"),
                       text.group_list(F.col("detail.removed")).alias("removed_groups"),
                       text.group_list(F.col("detail.skipped")).alias("skipped_groups"))
