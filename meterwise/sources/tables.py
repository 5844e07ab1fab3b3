"""Driver tables and the canonical invocation fixtures built from them.

Canonical invocation schema (one row per model call):
    record_id BIGINT, ts TIMESTAMP_NTZ, user STRING, model_id STRING,
    month STRING, input_tokens, output_tokens, cache_write_tokens,
    cache_read_tokens BIGINT
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterwise.session import prepare

# Fixed values of the test fixtures (FIXTURES.md).
# events.event_type -> model id
EVENT_MODEL = (
    ("click", "x.claude-opus-4"),
    ("view", "x.claude-sonnet-4"),
    ("purchase", "x.claude-haiku-4"),
)
OTHER_MODEL = "y.other"
# orders.o_orderpriority leading digit -> model id; priority 4 uses the
# inference-profile ARN form of the default-priced model.
ORDER_MODEL = (
    ("1", "x.claude-opus-4"),
    ("2", "x.claude-sonnet-4"),
    ("3", "x.claude-haiku-4"),
    ("4", "arn:aws:inference:us-east-1:000000000000:inference-profile/y.other"),
    ("5", "y.other"),
)

INVOCATION_COLS = ("record_id", "ts", "user", "model_id", "month", "input_tokens",
                   "output_tokens", "cache_write_tokens", "cache_read_tokens")


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (read-only input). The DataFrame is reused per session,
    so its footer/schema is resolved once, not on every query."""
    prepare(spark)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _TABLES[key] = df
    return df


def _map_values(col: Column, pairs, default: str | None) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def month_of_ntz(ts: Column) -> Column:
    """First seven characters of the timestamp as text (YYYY-MM)."""
    return F.substring(ts.cast("string"), 1, 7)


def month_range(ts: Column, month: str) -> Column:
    """``month = m`` as a half-open time range on the timestamp, so the
    predicate reaches the parquet scan (``PushedFilters``, row-group skipping)
    instead of filtering a derived text column after the read."""
    from datetime import datetime
    start = datetime.strptime(month + "-01", "%Y-%m-%d")
    end = start.replace(year=start.year + (start.month == 12), month=start.month % 12 + 1)
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def invocations_from_events(spark: SparkSession, sf_dir: str, month: str | None = None) -> DataFrame:
    """Fixture F1: ``events`` -> one invocation per event (optionally one month)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    if month:
        ev = ev.where(month_range(F.col("ts"), month))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        F.col("event_id").alias("record_id"),
        F.col("ts"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"),
        _map_values(F.col("event_type"), EVENT_MODEL, OTHER_MODEL).alias("model_id"),
        month_of_ntz(F.col("ts")).alias("month"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("output_tokens"),
        (k * 100).alias("cache_write_tokens"),
        (k * 1000).alias("cache_read_tokens"),
    )


def invocations_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture F3: ``orders`` -> multi-month invocations without cache tokens."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                              "o_orderdate", "o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("user"),
        _map_values(F.substring("o_orderpriority", 1, 1), ORDER_MODEL, None).alias("model_id"),
        month_of_ntz(F.col("o_orderdate")).alias("month"),
        F.floor(F.col("o_totalprice")).cast("bigint").alias("input_tokens"),
        F.floor(F.col("o_totalprice") / 10).cast("bigint").alias("output_tokens"),
        F.lit(0).cast("bigint").alias("cache_write_tokens"),
        F.lit(0).cast("bigint").alias("cache_read_tokens"),
    )


# --------------------------------------------------------------------------
# Directory tables for enforcement (users, groups, memberships).
# --------------------------------------------------------------------------
def directory_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` -> (user_name, user_id); the BUILDING segment has no
    directory entry, so some over-budget users stay unresolved."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (c.where(F.col("c_mktsegment") != "BUILDING")
             .select(F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("user_name"),
                     F.concat(F.lit("u-"), F.col("c_custkey").cast("string")).alias("user_id")))


def directory_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` -> (display_name, group_id)."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.select(F.col("n_name").alias("display_name"),
                    F.concat(F.lit("g-"), F.col("n_nationkey").cast("string")).alias("group_id"))


def directory_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is a member of its nation's group; customers with an
    account balance above 5000 are also members of the next nation's group."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    first = c.select(F.col("c_custkey"), F.col("c_nationkey").alias("g"))
    second = c.where(F.col("c_acctbal") > 5000).select(
        F.col("c_custkey"), ((F.col("c_nationkey") + 1) % 25).alias("g"))
    both = first.unionByName(second)
    return both.select(
        F.concat(F.lit("g-"), F.col("g").cast("string")).alias("group_id"),
        F.concat(F.lit("u-"), F.col("c_custkey").cast("string")).alias("user_id"),
        F.concat(F.lit("m-"), F.col("c_custkey").cast("string"), F.lit("-"), F.col("g").cast("string")).alias("membership_id"))
