"""Dashboard datasets: detail rows, filters, user table, KPIs, top-N with
Others, user x model heatmap, spend histogram, usage notices, what-if."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterwise.config import STATUS_BREACH, STATUS_NORMAL, STATUS_WARNING, MeterConfig
from meterwise.functions import budget, pricing, text
from meterwise.functions.models import short_model
from meterwise.functions.pricing import TOKEN_COLS

DETAIL_COLS = ("user", "model", "month", *TOKEN_COLS, "total_tokens", "cost_usd",
               "invocations", "last_updated_utc")
# Fixed value: text shown when a row has no update time.
NO_TIME = "—"


def normalise_usage(usage: DataFrame) -> DataFrame:
    """Absent counter columns become 0, nulls become 0, all BIGINT."""
    cols = set(usage.columns)
    out = usage
    for c in (*TOKEN_COLS, "total_tokens", "invocations"):
        if c not in cols:
            out = out.withColumn(c, F.lit(0).cast("bigint"))
        else:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")))
    return out


def last_updated_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss UTC``; missing -> em dash."""
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), F.lit(NO_TIME))


def detail_frame(priced: DataFrame) -> DataFrame:
    """Dashboard base frame: one row per usage row, short model, row cost."""
    return priced.select(
        "user", "model_id", short_model(F.col("model_id")).alias("model"), "month",
        *TOKEN_COLS, "total_tokens", "invocations", "cost",
        pricing.usd(F.col("cost")).alias("cost_usd"),
        last_updated_text(F.col("last_ts")).alias("last_updated_utc"))


def with_user_spend(detail: DataFrame, cfg: MeterConfig) -> DataFrame:
    """User-month spend over all models on every row, then the row-level
    fraction, display percent and status (from *unfiltered* spend, T10).

    The window partition is one (user, month): a handful of model rows.
    """
    w = Window.partitionBy("user", "month")
    d = detail.withColumn("user_month_cost", F.sum("cost").over(w))
    frac = budget.budget_fraction(pricing.usd(F.col("user_month_cost")), cfg)
    return (d.withColumn("user_month_spend", pricing.usd(F.col("user_month_cost")))
             .withColumn("pct", frac)
             .withColumn("pct_display", budget.pct_display(F.col("pct")))
             .withColumn("status", budget.fraction_status(F.col("pct"), cfg)))


@dataclass(frozen=True)
class DashboardFilters:
    user_query: str = ""
    regex: bool = True            # the dashboard matches a regex (T19)
    models: tuple[str, ...] = ()  # empty -> no filter
    statuses: tuple[str, ...] = ()
    min_spend: float = 0.0


def user_search(d: DataFrame, query: str, regex: bool = True) -> DataFrame:
    """case-insensitive containment (regex by default); null -> no match."""
    if not query:
        return d
    if regex:
        return d.where(F.coalesce(F.col("user").rlike("(?i)" + query), F.lit(False)))
    return d.where(F.coalesce(F.lower(F.col("user")).contains(query.lower()), F.lit(False)))


def apply_filters(d: DataFrame, flt: DashboardFilters) -> DataFrame:
    """F4-F6. The min-spend test uses the pre-filter all-model spend."""
    chosen = [(flt.models, F.col("model").isin(*flt.models)),
              (flt.statuses, F.col("status").isin(*flt.statuses)),
              (flt.min_spend > 0, F.col("user_month_spend") >= F.lit(float(flt.min_spend)))]
    for wanted, test in chosen:
        d = d.where(test) if wanted else d
    return user_search(d, flt.user_query, flt.regex)


def user_spend_table(filtered: DataFrame, cfg: MeterConfig) -> DataFrame:
    """A10: per (user, month) over the filtered rows; status recomputed."""
    g = filtered.groupBy("user", "month").agg(
        F.sum("cost").alias("cost"),
        *[F.sum(c).cast("bigint").alias(c) for c in (*TOKEN_COLS, "total_tokens", "invocations")])
    frac = budget.budget_fraction(pricing.usd(F.col("cost")), cfg)
    return (g.withColumn("cost_usd", pricing.usd(F.col("cost")))
             .withColumn("pct", frac)
             .withColumn("pct_display", budget.pct_display(F.col("pct")))
             .withColumn("status", budget.fraction_status(F.col("pct"), cfg)))


def kpi_tiles(filtered: DataFrame, cfg: MeterConfig) -> DataFrame:
    """A11 in one aggregation pass: the filtered user-month spend comes from
    a window on the (user, month) partition and is counted once per pair."""
    w = Window.partitionBy("user", "month")
    first = Window.partitionBy("user", "month").orderBy("model_id")
    d = (filtered.withColumn("_um", pricing.usd(F.sum("cost").over(w)))
                 .withColumn("_first", F.row_number().over(first) == 1))
    frac = budget.budget_fraction(F.col("_um"), cfg)
    warn = float(cfg.warn_ratio)
    return d.agg(
        F.count_distinct("user").alias("users"),
        F.count_distinct("model").alias("models"),
        pricing.usd(F.sum("cost")).alias("total_spend_usd"),
        F.sum("total_tokens").cast("bigint").alias("total_tokens"),
        F.count_if(F.col("_first") & (frac >= F.lit(warn)) & (frac < F.lit(1.0))).cast("bigint").alias("warnings"),
        F.count_if(F.col("_first") & (frac >= F.lit(1.0))).cast("bigint").alias("breaches"))


def top_n_with_others(d: DataFrame, group_col: str, n: int, value_cols: list[str],
                      money: tuple[str, ...] = ("cost",)) -> DataFrame:
    """Top ``n`` groups by the first value, the rest folded into one
    ``Others (k)`` row placed last; no Others row when there are <= n groups.
    Rows without a group take no part.

    The winners come from a TakeOrderedAndProject and the totals from a plain
    aggregate of the same grouped rows, whose shuffle is read twice. Others is
    the totals less the winners, a sum over n + 1 rows.
    """
    grouped = (d.where(F.col(group_col).isNotNull()).groupBy(group_col)
                .agg(*[F.sum(c).alias(c) for c in value_cols]))
    order = [F.col(value_cols[0]).desc(), F.col(group_col).asc()]
    top = (grouped.orderBy(*order).limit(n)
                  .withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("_k", F.lit(1).cast("bigint")))
    totals = (grouped.agg(*[F.sum(c).cast(grouped.schema[c].dataType).alias(c) for c in value_cols],
                          F.count(group_col).alias("_k"))
                     .withColumn(group_col, F.lit(None).cast("string")).withColumn("rank", F.lit(None).cast("int")))
    rest = F.col("rank").isNull()
    everything = Window.partitionBy(F.lit(0))  # n + 1 rows
    left = lambda c: F.when(rest, F.sum(F.when(rest, F.col(c)).otherwise(-F.col(c))).over(everything)).otherwise(F.col(c))
    rows = top.unionByName(totals).select(group_col, "rank", left("_k").alias("_k"), *[left(c).alias(c) for c in value_cols])
    label = F.coalesce(F.col(group_col), F.concat(F.lit("Others ("), F.col("_k").cast("string"), F.lit(")")))
    outs = [pricing.usd(F.col(c)).alias(c + "_usd") if c in money else F.col(c).cast("bigint").alias(c) for c in value_cols]
    return (rows.where(~rest | (F.col("_k") > 0))
                .select(label.alias(group_col), F.coalesce("rank", F.lit(n + 1)).alias("rank"), *outs))


def top_users(d: DataFrame, n: int) -> DataFrame:
    """The top-n users by filtered spend (n rows, ties on the user)."""
    g = d.groupBy("user").agg(F.sum("cost").alias("cost"))
    return (g.orderBy(F.col("cost").desc(), F.col("user").asc()).limit(n)
             .withColumn("user_rank", F.row_number().over(Window.orderBy(F.col("cost").desc(), F.col("user").asc())))
             .select("user", "user_rank"))


def user_model_heatmap(d: DataFrame, n: int) -> DataFrame:
    """A13 + J4 + P18: top-n users x every model they used, absent cells 0,
    long form with ln(1 + cost) (a colour scale, kept to 12 decimals).

    One scan: cells are summed per (user, model), folded into one row per
    user, and only the n users with the highest spend leave that stage
    (TakeOrderedAndProject). The last steps see n rows, each as long as the
    number of models. Rows without a user or a model take no part.
    """
    cells = (d.where(F.col("user").isNotNull() & F.col("model").isNotNull())
              .groupBy("user", "model").agg(F.sum("cost").alias("c")))
    users = cells.groupBy("user").agg(F.sum("c").alias("cost"),
                                      F.map_from_entries(F.collect_list(F.struct("model", "c"))).alias("by_model"))
    order = [F.col("cost").desc(), F.col("user").asc()]
    top = users.orderBy(*order).limit(n)
    top = top.select("user", "by_model", F.row_number().over(Window.orderBy(*order)).alias("user_rank"),
                     F.array_distinct(F.flatten(F.collect_list(F.map_keys("by_model")).over(
                         Window.partitionBy(F.lit(0))))).alias("models"))
    long = top.select("user", "user_rank", "by_model", F.explode("models").alias("model"))
    cost = pricing.usd(F.coalesce(F.try_element_at("by_model", F.col("model")), F.lit(0).cast("decimal(38,12)")))
    return (long.select("user", "model", cost.alias("cost_usd"), "user_rank")
                .withColumn("log_cost", F.bround(F.log1p(F.col("cost_usd")), 12)))


def spend_histogram(users: DataFrame, bins: int = 40) -> DataFrame:
    """Per-user spend in ``bins`` equal-width bins between min and max.

    The per-user table (one row per user-month) is cut from its lineage with
    a reliable ``checkpoint()`` in the shared checkpoint folder, so min/max
    -- one scalar subquery, inlined as literals, no join -- and the binning
    read it instead of recomputing the pipeline. Empty bins are omitted.
    """
    from meterwise.session import work_root
    work_root(users.sparkSession)                 # a checkpoint folder exists
    users = users.select("cost_usd").checkpoint()
    mm = users.select(F.struct(F.min("cost_usd").alias("lo"), F.max("cost_usd").alias("hi"))).scalar()
    lo, hi = mm.getField("lo"), mm.getField("hi")
    span = hi - lo
    b = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("cost_usd") - lo) / span * F.lit(bins)), F.lit(bins - 1))).cast("bigint")
    h = users.select(b.alias("bin"), lo.alias("_lo"), span.alias("_span"))
    g = h.groupBy("bin", "_lo", "_span").agg(F.count(F.lit(1)).alias("users"))
    return g.select("bin",
                    (F.col("_lo") + F.col("_span") * F.col("bin") / F.lit(float(bins))).alias("bin_lo"),
                    (F.col("_lo") + F.col("_span") * (F.col("bin") + 1) / F.lit(float(bins))).alias("bin_hi"),
                    "users")


def usage_notices(users_tbl: DataFrame, filtered: DataFrame, selected: DataFrame,
                  cfg: MeterConfig, actor: str) -> DataFrame:
    """R3 + J9: one notice per selected (user, month): spend, percent, token
    breakdown and the per-model lines (models of that pair, a bounded list)."""
    pick = users_tbl.join(selected.select("user", "month"), ["user", "month"], "left_semi")
    per_model = (filtered.join(selected.select("user", "month"), ["user", "month"], "left_semi")
                 .groupBy("user", "month")
                 .agg(F.sort_array(F.collect_list(F.struct(
                     F.col("model"), F.col("cost_usd"), F.col("total_tokens"), F.col("invocations")))).alias("models")))
    line = lambda m: F.concat(
        F.lit("    - "), m["model"], F.lit(": $"), F.format_number(m["cost_usd"], 2),
        F.lit(" ("), F.format_number(m["total_tokens"], 0), F.lit(" tok, "),
        F.format_number(m["invocations"], 0), F.lit(" inv)"))
    j = pick.join(per_model, ["user", "month"], "left")
    b = float(cfg.budget_usd)
    pct = (F.col("cost_usd") / F.lit(b) * F.lit(100.0)) if b else F.lit(0.0)
    lines = F.array_join(F.transform(F.coalesce(F.col("models"), F.array()), line), "\n")
    subject = F.concat(F.lit(f"[{cfg.alert_label} USAGE] "), F.col("user"), F.lit(" • $"),
                       F.format_number(F.col("cost_usd"), 2), F.lit(" spend ("), F.col("month"), F.lit(")"))
    return j.select(
        "user", "month", "cost_usd", pct.alias("pct_of_budget"), "total_tokens", *TOKEN_COLS, "invocations",
        F.size(F.coalesce(F.col("models"), F.array())).alias("n_models"),
        F.substring(subject, 1, 100).alias("subject"),
        lines.alias("per_model_text"),
        text.usage_body(F.col("user"), F.col("month"), F.col("cost_usd"), b, pct, F.col("total_tokens"),
                        tuple(F.col(c) for c in TOKEN_COLS), F.col("invocations"), lines, F.lit(actor)).alias("body"),
        F.lit(actor).alias("actor"))


def what_if_budget(user_spend: DataFrame, budgets: list[float], cfg: MeterConfig) -> DataFrame:
    """Status counts under several budgets; stored counters untouched.

    Each user-month row fans out to the (short, fixed) list of scenario
    budgets with ``explode`` -- no join.
    """
    arr = F.array(*[F.lit(float(b)) for b in budgets])
    x = user_spend.select("cost_usd", F.explode(arr).alias("budget_usd"))
    frac = F.col("cost_usd") / F.greatest(F.col("budget_usd"), F.lit(1e-9))
    warn = float(cfg.warn_ratio)
    st = (F.when(frac >= 1.0, F.lit(STATUS_BREACH)).when(frac >= warn, F.lit(STATUS_WARNING))
           .otherwise(F.lit(STATUS_NORMAL)))
    return x.groupBy("budget_usd", st.alias("status")).agg(F.count(F.lit(1)).alias("users"))


class DashboardViews:
    """All dashboard datasets from one cached priced-detail frame.

    The detail (usage rows with short model, row cost and the all-model
    user-month spend of W1) is computed once and cached -- it is one row per
    (user, model, month), small next to the raw logs -- and every view reads
    it. Call :meth:`close` to release the cache.
    """

    def __init__(self, priced: DataFrame, cfg: MeterConfig, filters: DashboardFilters | None = None):
        self.cfg = cfg
        self.filters = filters or DashboardFilters()
        self.detail = with_user_spend(detail_frame(priced), cfg).cache()
        self.filtered = apply_filters(self.detail, self.filters)

    def users(self) -> DataFrame:
        return user_spend_table(self.filtered, self.cfg)

    def kpis(self) -> DataFrame:
        return kpi_tiles(self.filtered, self.cfg)

    def top_users(self) -> DataFrame:
        return top_n_with_others(self.filtered, "user", self.cfg.top_n, ["cost", "total_tokens"])

    def top_models(self) -> DataFrame:
        return top_n_with_others(self.filtered, "model", self.cfg.top_n, ["cost", "input_tokens", "output_tokens"])

    def heatmap(self) -> DataFrame:
        return user_model_heatmap(self.filtered, self.cfg.top_n)

    def histogram(self, bins: int = 40) -> DataFrame:
        return spend_histogram(self.users(), bins)

    def notices(self, selected: DataFrame, actor: str) -> DataFrame:
        return usage_notices(self.users(), self.filtered, selected, self.cfg, actor)

    def export_csv(self, path: str) -> None:
        cols = ["user", "month", "cost_usd", "pct_display", "status", "total_tokens", "input_tokens",
                "output_tokens", "invocations"]
        self.users().select(*cols).write.mode("overwrite").option("header", True).csv(path)

    def close(self) -> None:
        self.detail.unpersist()
