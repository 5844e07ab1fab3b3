"""Budget status and percent of budget."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from meterwise.config import STATUS_BREACH, STATUS_NORMAL, STATUS_WARNING, MeterConfig


def _dec(x) -> Column:
    from meterwise.functions.literals import dec
    return dec(x, "decimal(38,12)")


def status(cost: Column, cfg: MeterConfig) -> Column:
    """Breach when cost >= budget, Warning when >= budget * warn ratio."""
    return (F.when(cost >= _dec(cfg.budget_usd), F.lit(STATUS_BREACH))
             .when(cost >= _dec(cfg.warn_usd), F.lit(STATUS_WARNING))
             .otherwise(F.lit(STATUS_NORMAL)))


def pct_of_budget(cost_double: Column, cfg: MeterConfig) -> Column:
    """Reader / alert percent: cost / budget * 100, 0 when the budget is 0."""
    b = float(cfg.budget_usd)
    if b == 0:
        return F.lit(0.0)
    return cost_double / F.lit(b) * F.lit(100.0)


def budget_fraction(cost_double: Column, cfg: MeterConfig) -> Column:
    """Dashboard fraction: cost / max(budget, 1e-9)."""
    return cost_double / F.lit(max(float(cfg.budget_usd), 1e-9))


def pct_display(fraction: Column) -> Column:
    """Dashboard display percent, one decimal, half-even."""
    return F.bround(fraction * F.lit(100.0), 1)


def fraction_status(fraction: Column, cfg: MeterConfig) -> Column:
    """Dashboard status on the budget fraction (warn ratio from the config)."""
    return (F.when(fraction >= F.lit(1.0), F.lit(STATUS_BREACH))
             .when(fraction >= F.lit(float(cfg.warn_ratio)), F.lit(STATUS_WARNING))
             .otherwise(F.lit(STATUS_NORMAL)))
