"""Over-budget enforcement decisions (ST8, ST9, J5-J8, W5, F9, F10, S11).

Nothing is deleted: each decision carries the *would-be* action (REMOVED
with dry-run off) instead of calling an identity service. The directory
(users, groups, memberships) comes in as tables.

Sizes: targets come from the configured ids + names, one array value read
inside the plan; memberships are joined on user_id (a shuffle AQE may turn
into a broadcast from the measured size); per-user lists are bounded by the
number of targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meterwise.config import UNKNOWN_USER, MeterConfig
from meterwise.functions import broadcast as bc, text

ENTRY = "struct<ord:int,group:string,group_id:string,membership_id:string,reason:string>"


def candidates(over_budget: DataFrame, cfg: MeterConfig) -> DataFrame:
    """F9 + F10: over-budget (user, month) pairs that may be enforced:
    feature configured, not allow-listed, not unknown/empty/null."""
    spark = over_budget.sparkSession
    if not cfg.enforcement_configured():
        return over_budget.limit(0)
    d = over_budget.where(F.col("user").isNotNull() & ~F.col("user").isin(UNKNOWN_USER, ""))
    if cfg.allow_list:
        allow = spark.createDataFrame([(u,) for u in cfg.allow_list], "user string")
        d = d.join(bc.bounded(allow, len(cfg.allow_list)), "user", "left_anti")
    return d


def group_targets(groups: DataFrame, cfg: MeterConfig) -> DataFrame:
    """Explicit ids first (label = id), then names resolved by
    display name; first occurrence per group id wins; unresolved names are
    skipped."""
    spark = groups.sparkSession
    ids = [(i, g, g) for i, g in enumerate(cfg.group_ids)]
    names = [(len(ids) + i, n) for i, n in enumerate(cfg.group_names)]
    id_df = spark.createDataFrame(ids, "ord int, label string, group_id string")
    name_df = spark.createDataFrame(names, "ord int, label string")
    resolved = name_df.join(groups, name_df["label"] == groups["display_name"]).select("ord", "label", "group_id")
    allt = id_df.unionByName(resolved)
    w = Window.partitionBy("group_id").orderBy("ord")
    return allt.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def decisions(cands: DataFrame, users: DataFrame, memberships: DataFrame, targets: DataFrame,
              cfg: MeterConfig) -> DataFrame:
    """ST8 + ST9 + J5 + J7 + P17: one decision per candidate (user, month).

    No targets -> ERROR ``no_groups_resolved``; user not in the directory
    -> ERROR ``user_unresolved`` (both without notice); otherwise every
    target is a member (DRYRUN, or REMOVED when dry-run is off) or skipped
    as ``not_a_member``. Precedence REMOVED > ERROR > DRYRUN > SKIPPED.
    """
    # the configured targets as one array value, read inside the plan (a scalar subquery)
    entry = F.struct(F.col("ord").cast("int").alias("ord"), F.col("label").alias("group"), "group_id",
                     F.lit(None).cast("string").alias("membership_id"), F.lit("not_a_member").alias("reason"))
    tl = targets.select(F.sort_array(F.collect_list(entry)).alias("t")).scalar()
    empty = F.array().cast(f"array<{ENTRY}>")
    res = cands.select("user", "month").join(users, F.col("user") == users["user_name"], "left").drop("user_name")
    mem = (res.where(F.col("user_id").isNotNull()).select("user", "month", "user_id")
              .join(memberships, "user_id").withColumn("targets", tl)
              .withColumn("hit", F.filter("targets", lambda t: t["group_id"] == F.col("group_id")))
              .where(F.size("hit") > 0).withColumn("hit", F.element_at("hit", 1))
              .groupBy("user", "month")
              .agg(F.sort_array(F.collect_list(F.struct(
                  F.col("hit.ord").alias("ord"), F.col("hit.group").alias("group"), "group_id", "membership_id",
                  F.lit(None).cast("string").alias("reason")))).alias("members")))
    d = res.join(mem, ["user", "month"], "left").withColumn("targets", tl)
    none = F.size("targets") == 0
    d = d.select("user", "month", F.when(~none, F.col("user_id")).alias("user_id"), "targets",
                 F.when(none, F.lit("no_groups_resolved"))
                  .when(F.col("user_id").isNull(), F.lit("user_unresolved")).alias("reason"),
                 F.coalesce(F.col("members"), empty).alias("members"))
    member_ids = F.transform(F.col("members"), lambda e: e["group_id"])
    resolved = F.col("reason").isNull()
    skipped = F.when(resolved, F.filter("targets", lambda t: ~F.array_contains(member_ids, t["group_id"]))).otherwise(empty)
    acted = F.when(resolved, F.col("members")).otherwise(empty)
    dry = bool(cfg.enforce_dry_run)
    d = d.select("user", "month", "user_id", "reason",
                 (empty if dry else acted).alias("removed"),
                 (acted if dry else empty).alias("dryrun"),
                 skipped.alias("skipped"), empty.alias("errored"))
    mode = (F.when(F.col("reason").isNotNull(), F.lit("ERROR"))
             .when(F.size("removed") > 0, F.lit("REMOVED"))
             .when(F.size("errored") > 0, F.lit("ERROR"))
             .when(F.size("dryrun") > 0, F.lit("DRYRUN"))
             .otherwise(F.lit("SKIPPED")))
    return d.withColumn("mode", mode).withColumn("notifiable", F.col("reason").isNull() & (F.col("mode") != "SKIPPED"))


def decisions_text(dec: DataFrame) -> DataFrame:
    """Flat form: group lists rendered as ``name (id[, membership=..][, reason=..])``."""
    return dec.select("user", "month", "mode", "user_id", "reason",
                      text.group_list(F.col("removed")).alias("removed_groups"),
                      text.group_list(F.col("dryrun")).alias("dryrun_groups"),
                      text.group_list(F.col("skipped")).alias("skipped_groups"),
                      text.group_list(F.col("errored")).alias("errored_groups"))


def throttle(audits: DataFrame, cfg: MeterConfig, at_col: str = "at") -> DataFrame:
    """W5 + J8: notify per audit row. SKIPPED is silent; REMOVED always
    notifies; DRYRUN/ERROR notify unless the previous audit of the same
    (user, month) has the same mode and is less than the re-notify window
    old (a gap rule: every run rewrites the time). Pre-resolution ERRORs
    never notify. ``cfg.throttle = 'per_window'`` chooses :func:`throttle_per_window`."""
    if cfg.throttle == "per_window":
        return throttle_per_window(audits, cfg, at_col)
    w = Window.partitionBy("user", "month").orderBy(at_col)
    d = (audits.withColumn("prev_mode", F.lag("mode").over(w))
               .withColumn("prev_at", F.lag(at_col).over(w)))
    return _with_notify(d, cfg, at_col)


def throttle_per_window(audits: DataFrame, cfg: MeterConfig, at_col: str = "at") -> DataFrame:
    """Trap T9's other reading: after a notice of a mode, DRYRUN and ERROR audits of the same mode
    stay silent until the re-notify window since that *sent* notice has passed; REMOVED always sends,
    SKIPPED never does, and neither does an audit that is not notifiable.

    Whether an audit sends depends on all earlier sends, which no frame can
    express: the audits of a (user, month), at most one per run, are folded in
    order, and the fold keeps the times of the notices only.
    """
    can = F.col("notifiable") if "notifiable" in audits.columns else F.lit(True)
    step = F.struct(F.col(at_col).cast("timestamp").alias("at"), "mode", F.coalesce(can, F.lit(False)).alias("can"))
    none = F.lit(None)
    start = F.struct(none.cast("timestamp").alias("at"), none.cast("string").alias("mode"),
                     F.array().cast("array<timestamp>").alias("sent"))
    window_s = int(cfg.renotify_hours) * 3600

    def fold(acc, x):
        quiet = (acc["mode"] == x["mode"]) & (x["at"].cast("double") - acc["at"].cast("double") < window_s)
        send = x["can"] & ((x["mode"] == "REMOVED")
                           | (x["mode"].isin("DRYRUN", "ERROR") & ~F.coalesce(quiet, F.lit(False))))
        return F.when(send, F.struct(x["at"].alias("at"), x["mode"].alias("mode"),
                                     F.concat(acc["sent"], F.array(x["at"])).alias("sent"))).otherwise(acc)

    sent = (audits.groupBy("user", "month").agg(F.array_sort(F.collect_list(step)).alias("steps"))
            .select("user", "month", F.aggregate("steps", start, fold, lambda acc: acc["sent"]).alias("_sent")))
    return (audits.join(sent, ["user", "month"])
            .withColumn("notify", F.array_contains("_sent", F.col(at_col).cast("timestamp")) & F.coalesce(can, F.lit(False))
                        & F.col("mode").isin("REMOVED", "DRYRUN", "ERROR")).drop("_sent"))


def throttle_next(audits: DataFrame, prior: DataFrame, cfg: MeterConfig, at_col: str = "at") -> DataFrame:
    """W5 for one run: its audits against the last earlier one of the same
    (user, month), as :func:`latest_audit` gives it."""
    last = prior.select("user", "month", F.col("mode").alias("prev_mode"), F.col("at").alias("prev_at"))
    return _with_notify(audits.join(last, ["user", "month"], "left"), cfg, at_col)


def _with_notify(d: DataFrame, cfg: MeterConfig, at_col: str) -> DataFrame:
    gap = F.col(at_col).cast("timestamp").cast("long") - F.col("prev_at").cast("timestamp").cast("long")
    window_s = int(cfg.renotify_hours) * 3600
    repeat = (F.col("prev_mode") == F.col("mode")) & (gap < F.lit(window_s))
    notify = (F.when(F.col("mode") == "REMOVED", F.lit(True))
               .when(F.col("mode").isin("DRYRUN", "ERROR"), ~F.coalesce(repeat, F.lit(False)))
               .otherwise(F.lit(False)))
    if "notifiable" in d.columns:
        notify = notify & F.col("notifiable")
    return d.withColumn("notify", notify)


def audit_rows(history: DataFrame, cfg: MeterConfig, at_col: str = "at") -> DataFrame:
    """Audit rows with detail and expiry (``at`` + audit TTL)."""
    detail = F.struct(F.col("user_id").alias("userId"), "removed", "dryrun", "skipped", "errored",
                      F.col("reason").alias("reason"))
    return history.select("user", "month", "mode", detail.alias("detail"), F.col(at_col).alias("at"),
                          (F.col(at_col) + F.expr(f"INTERVAL {int(cfg.audit_ttl_days)} DAYS")).alias("expire_at"))


def latest_audit(audit: DataFrame) -> DataFrame:
    """The last audit row per (user, month)."""
    g = audit.groupBy("user", "month").agg(F.max_by(F.struct("mode", "at", "expire_at", "detail"), F.col("at")).alias("a"))
    return g.select("user", "month", "a.mode", "a.at", "a.expire_at", "a.detail")


def notices(throttled: DataFrame, cfg: MeterConfig, at_col: str = "at") -> DataFrame:
    """P16 + S12: the enforcement notices that are actually sent (notify),
    with subject, body and attributes user / level / kind."""
    d = throttled.where(F.col("notify"))
    return d.select(
        "user", "month", F.col(at_col).alias("at"), F.col("mode").alias("level"),
        text.enforcement_subject(F.col("mode"), F.col("user"), F.col("month"), cfg.alert_label).alias("subject"),
        text.enforcement_body(F.col("mode"), F.col("user"), F.col("user_id"), F.col("month"),
                              text.group_list(F.col("removed")), text.group_list(F.col("dryrun")),
                              text.group_list(F.col("errored"))).alias("body"),
        F.create_map(F.lit("user"), F.col("user"), F.lit("level"), F.col("mode"),
                     F.lit("kind"), F.lit("enforcement")).alias("attributes"))
