"""Before/after spend per run, edge-triggered dollar alerts, and the legacy
per-(user, model, month) token crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterwise.config import MeterConfig
from meterwise.functions import budget, pricing, text
from meterwise.functions.pricing import TOKEN_COLS
from meterwise.operators import prefix


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def time_bucket(ts: Column, width: str) -> Column:
    """Start of the epoch-aligned window of ``width`` ("5 minutes"), of the type of ``ts``; null stays null."""
    n, unit = width.split()
    micros = int(n) * _SECONDS[unit.rstrip("s")] * 1_000_000
    into = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(micros))
    zero = F.lit(0)
    return ts - F.make_dt_interval(zero, zero, zero, (into / 1_000_000).cast("decimal(18,6)"))


def run_start(ts: Column, schedule: str) -> Column:
    """The scheduled run an invocation belongs to (event-time tumbling).

    Rows without a time keep a null run, which comes before all others
    (``F.window`` would drop them).
    """
    return time_bucket(ts, schedule)


def spend_delta(inv: DataFrame, cfg: MeterConfig, run_col: str | None = None) -> DataFrame:
    """Cost added per (user, month) by each run.

    ``inv`` holds invocations or partials of them. Tokens are summed per model
    first and those sums are priced (cost is linear in a model's tokens). Runs
    are the ``cfg.schedule`` windows of event time unless a ``run_col`` (e.g. a
    stream batch id) is given.
    """
    run = F.col(run_col) if run_col else run_start(F.col("ts"), cfg.schedule)
    per_model = inv.groupBy("user", "month", run.alias("run"), "model_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in TOKEN_COLS])
    return pricing.with_cost(per_model, cfg).groupBy("user", "month", "run").agg(F.sum("cost").alias("delta"))


def spend_before_after(delta: DataFrame) -> DataFrame:
    """Prev and new month spend around every run.

    new = running sum of the run deltas (the absolute month total after the
    run), prev = max(new - delta, 0). Input is already one row per
    (user, month, run), so each window partition holds at most the number of
    runs in a month.
    """
    w = (Window.partitionBy("user", "month").orderBy("run")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = delta.withColumn("new_cost", F.sum("delta").over(w))
    return d.withColumn("prev_cost", F.greatest(F.col("new_cost") - F.col("delta"), F.lit(0).cast("decimal(38,12)")))


def spend_alerts(before_after: DataFrame, cfg: MeterConfig) -> DataFrame:
    """ST6 + F7: WARN when prev < budget*ratio <= new, BREACH when
    prev < budget <= new; both can fire in one run; runs with delta <= 0 are
    skipped. Money columns stay exact decimals here."""
    d = before_after.where(F.col("delta") > 0)
    levels = F.array(
        F.struct(F.lit("WARN").alias("level"), F.lit(cfg.warn_usd).cast("decimal(38,12)").alias("boundary")),
        F.struct(F.lit("BREACH").alias("level"), F.lit(cfg.budget_usd).cast("decimal(38,12)").alias("boundary")))
    x = d.select("user", "month", "run", "delta", "prev_cost", "new_cost", F.explode(levels).alias("b"))
    x = x.select("user", "month", "run", "delta", "prev_cost", "new_cost", "b.level", "b.boundary")
    return x.where((F.col("prev_cost") < F.col("boundary")) & (F.col("boundary") <= F.col("new_cost")))


def over_budget(before_after_or_spend: DataFrame, cfg: MeterConfig, cost_col: str = "new_cost") -> DataFrame:
    """F8: at/over budget (level-triggered)."""
    return before_after_or_spend.where(F.col(cost_col) >= F.lit(cfg.budget_usd).cast("decimal(38,12)"))


def alert_rows(alerts: DataFrame, cfg: MeterConfig) -> DataFrame:
    """P16 + S12 shape: level, user, month, subject, body, attributes."""
    prev = pricing.usd(F.col("prev_cost"))
    new = pricing.usd(F.col("new_cost"))
    bnd = pricing.usd(F.col("boundary"))
    pct = budget.pct_of_budget(new, cfg)
    warn_pct = int(cfg.warn_ratio * 100)
    return alerts.select(
        "level", "user", "month", "run",
        prev.alias("prev_cost_usd"), new.alias("new_cost_usd"), bnd.alias("boundary_usd"),
        text.spend_subject(F.col("level"), F.col("user"), bnd, F.col("month"), cfg.alert_label).alias("subject"),
        text.spend_body(F.col("level"), F.col("user"), F.col("month"), prev, new, pct, bnd,
                        float(cfg.budget_usd), warn_pct).alias("body"),
        F.create_map(F.lit("user"), F.col("user"), F.lit("level"), F.col("level")).alias("attributes"))


def token_crossings(inv: DataFrame, cfg: MeterConfig, start: DataFrame | None = None) -> DataFrame:
    """W2 / ST7: per (user, model, month) running token total, per event in
    (ts, record_id) order; WARN when prev < int(T*r) <= new, BREACH when
    prev < T <= new. Events without a time come first.

    ``start`` (user, model_id, month, start) holds totals from before these
    events (a stream's earlier batches).

    Scale: a two-level prefix sum. Events are first summed per
    (key, hour chunk); a window over those chunk totals (at most the hours
    of a month per key) gives each chunk's starting total. Only chunks that
    contain a crossing are expanded back to events -- an equi-join whose
    broadcast AQE decides from the measured size -- and their running sums
    come from :func:`prefix.running_sum`, which splits them by range: neither
    a hot user nor a hot hour lands whole in one task.
    """
    keys = ["user", "model_id", "month"]
    ev = inv.select(*keys, "ts", "record_id",
                    sum((F.col(c) for c in TOKEN_COLS[1:]), F.col(TOKEN_COLS[0])).alias("tokens"),
                    F.date_trunc("hour", F.col("ts")).alias("chunk"))
    chunks = ev.groupBy(*keys, "chunk").agg(F.sum("tokens").alias("chunk_tokens"))
    wc = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunks = chunks.withColumn("after", F.sum("chunk_tokens").over(wc))
    if start is not None:
        chunks = (chunks.join(start.select(*keys, "start"), keys, "left")
                  .withColumn("after", F.col("after") + F.coalesce("start", F.lit(0))).drop("start"))
    chunks = chunks.withColumn("before", F.col("after") - F.col("chunk_tokens"))
    levels = F.array(F.struct(F.lit("WARN").alias("level"), F.lit(cfg.warn_tokens).cast("bigint").alias("boundary")),
                     F.struct(F.lit("BREACH").alias("level"), F.lit(cfg.token_threshold).cast("bigint").alias("boundary")))
    hit = (chunks.select(*keys, "chunk", "before", "after", F.explode(levels).alias("b"))
                 .where((F.col("before") < F.col("b.boundary")) & (F.col("b.boundary") <= F.col("after")))
                 .select(*[F.col(k).alias(f"_{k}") for k in (*keys, "chunk")], "before", "b.level", "b.boundary"))
    # each event of a crossing chunk meets the (at most two) boundaries
    # crossed inside it; one running sum per (key, chunk, level)
    same = F.col("chunk").eqNullSafe(F.col("_chunk"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    x = ev.join(hit, same).select(*keys, "chunk", "level", "boundary", "before", "ts", "record_id", "tokens")
    y = prefix.running_sum(x, [*keys, "chunk", "level"], ["ts", "record_id"], "tokens", "into")
    y = (y.withColumn("new_total", F.col("before") + F.col("into"))
          .withColumn("prev_total", F.col("new_total") - F.col("tokens")))
    y = y.where((F.col("prev_total") < F.col("boundary")) & (F.col("boundary") <= F.col("new_total")))
    return y.select(*keys, "level", "boundary", "record_id", "prev_total", "new_total")


def token_crossings_after(inv: DataFrame, before: DataFrame, cfg: MeterConfig) -> DataFrame:
    """The crossings of :func:`token_crossings` in a batch of events, on top of the month totals before it.

    ``before`` holds rows that sum to those totals, of the batch's keys and maybe more. Few keys can cross in one
    batch: the others, by the sums of their positive and of their negative events, are left out first, and only the
    events of those few are dealt by ranges for their running sums.
    """
    keys = ["user", "model_id", "month"]
    tokens = sum((F.col(c) for c in TOKEN_COLS[1:]), F.col(TOKEN_COLS[0]))
    none = F.lit(0).cast("bigint")
    rows = inv.select(*keys, none.alias("held"), F.greatest(tokens, none).alias("up"), F.least(tokens, none).alias("down")).unionByName(
        before.select(*keys, tokens.alias("held"), none.alias("up"), none.alias("down")))
    sums = rows.groupBy(*keys).agg(F.sum("held").alias("start"), F.sum("up").alias("up"), F.sum("down").alias("down"))
    levels = (("WARN", cfg.warn_tokens), ("BREACH", cfg.token_threshold))
    low, high = F.col("start") + F.col("down"), F.col("start") + F.col("up")
    can = [(low < F.lit(b).cast("bigint")) & (F.lit(b).cast("bigint") <= high) for _, b in levels]
    cross = sums.where(can[0] | can[1]).select(*[F.col(k).alias(f"_{k}") for k in keys], "start")
    same = (F.col("user") == F.col("_user")) & (F.col("model_id") == F.col("_model_id")) & (F.col("month") == F.col("_month"))
    x = inv.join(cross, same).select(*keys, "start", "ts", "record_id", tokens.alias("tokens"))
    y = prefix.running_sum(x, keys, ["ts", "record_id"], "tokens", "into")
    y = (y.withColumn("new_total", F.col("start") + F.col("into"))
          .withColumn("prev_total", F.col("new_total") - F.col("tokens")))
    b = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(t).cast("bigint").alias("boundary")) for n, t in levels]))
    y = y.select(*keys, "record_id", "prev_total", "new_total", b.alias("b"))
    y = y.where((F.col("prev_total") < F.col("b.boundary")) & (F.col("b.boundary") <= F.col("new_total")))
    return y.select(*keys, "b.level", "b.boundary", "record_id", "prev_total", "new_total")


def token_alert_rows(crossings: DataFrame, cfg: MeterConfig) -> DataFrame:
    """P16 + S12: token alerts with subject, body and attributes."""
    c = F.col
    return crossings.select(
        "level", "user", "model_id", "month", c("record_id").cast("string").alias("record_id"), "prev_total", "new_total",
        "boundary",
        text.token_subject(c("level"), c("user"), c("model_id"), c("month"), c("boundary"), cfg.alert_label).alias("subject"),
        text.token_body(c("level"), c("user"), c("model_id"), c("month"), c("prev_total"), c("new_total"), c("boundary"),
                        cfg.token_threshold, int(cfg.warn_ratio * 100)).alias("body"),
        F.create_map(F.lit("user"), c("user"), F.lit("level"), c("level"), F.lit("kind"), F.lit("tokens")).alias("attributes"))
