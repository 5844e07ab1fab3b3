"""Price resolution (first substring match wins) and exact USD cost.

Rates are stored per million tokens as DECIMAL(10,6); cost uses per-token
rates at scale 12 so ``tokens * rate`` is exact in DECIMAL(35,12) and a sum of
costs stays exact in DECIMAL(38,12). Doubles appear only at the output edge.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from meterwise.config import MeterConfig

TOKEN_DEC = T.DecimalType(18, 0)
RATE_DEC = T.DecimalType(10, 6)        # USD per 1M tokens
TOKEN_RATE_DEC = T.DecimalType(16, 12)  # USD per token
MONEY_DEC = T.DecimalType(38, 12)
RATE_NAMES = ("rate_in", "rate_out", "rate_cw", "rate_cr")
TOKEN_COLS = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")
_MILLION = Decimal(1_000_000)


def price_frame(spark: SparkSession, cfg: MeterConfig) -> DataFrame:
    """Normalized price table: priority, pattern, four rates per 1M tokens.

    The fallback rate is the last row with ``pattern = NULL``.
    """
    rows = [(i, p, *r) for i, p, r in cfg.normalized_prices()]
    rows.append((len(rows), None, *cfg.fallback_rates()))
    schema = T.StructType([T.StructField("priority", T.IntegerType(), False),
                           T.StructField("pattern", T.StringType(), True)]
                          + [T.StructField(n, RATE_DEC, False) for n in RATE_NAMES])
    return spark.createDataFrame(rows, schema)


def _token_rate(r: Decimal) -> Column:
    from meterwise.functions.literals import dec
    return dec(r / _MILLION, "decimal(16,12)")


def resolved(model: Column, cfg: MeterConfig) -> Column:
    """The first entry whose pattern is in ``model``, else the fallback: pattern and four per-token rates.

    The table is one literal array (Catalyst folds it), searched per row, so a
    table of any size is one short expression and needs no join.
    """
    def entry(pattern: str | None, rates) -> Column:
        return F.struct(F.lit(pattern).cast("string").alias("pattern"),
                        *[_token_rate(r).alias(n) for r, n in zip(rates, RATE_NAMES)])

    mid = F.lower(F.coalesce(model, F.lit("")))
    fallback = entry(None, cfg.fallback_rates())
    entries = [entry(p, r) for _, p, r in cfg.normalized_prices()]
    if not entries:
        return fallback
    return F.coalesce(F.try_element_at(F.filter(F.array(*entries), lambda e: mid.contains(e["pattern"])), F.lit(1)), fallback)


def matched_pattern(model: Column, cfg: MeterConfig) -> Column:
    return resolved(model, cfg)["pattern"]


def cost_usd(tokens: list[Column], rates: Column) -> Column:
    """Exact USD cost DECIMAL(38,12) of four token counts at the rates of :func:`resolved`."""
    terms = [F.coalesce(t, F.lit(0)).cast(TOKEN_DEC) * rates[n] for t, n in zip(tokens, RATE_NAMES)]
    return (terms[0] + terms[1] + terms[2] + terms[3]).cast(MONEY_DEC)


def with_cost(df: DataFrame, cfg: MeterConfig, model_col: str = "model_id",
              out: str = "cost") -> DataFrame:
    """Add the exact decimal ``cost`` column to a usage-shaped DataFrame."""
    priced = df.withColumn("_rates", resolved(F.col(model_col), cfg))  # looked up once a row
    return priced.withColumn(out, cost_usd([F.col(c) for c in TOKEN_COLS], F.col("_rates"))).drop("_rates")


def with_rates(df: DataFrame, cfg: MeterConfig, model_col: str = "model_id") -> DataFrame:
    """Add ``matched_pattern`` and the four per-token rates."""
    r = df.withColumn("_rates", resolved(F.col(model_col), cfg))
    return r.select(*df.columns, F.col("_rates.pattern").alias("matched_pattern"), *[f"_rates.{n}" for n in RATE_NAMES])


def usd(c: Column) -> Column:
    """Exact decimal money -> DOUBLE at the output edge."""
    return c.cast("double")
