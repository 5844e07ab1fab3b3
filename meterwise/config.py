"""Job parameters, kept in one frozen object.

Money is handled as exact decimals end to end; doubles appear only at the
output edge.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from decimal import Decimal

# ---------------------------------------------------------------------------
# Fixed values that must equal the metered system's defaults.
# Default price table, USD per 1,000,000 tokens, [input, output], matched by
# lower-case substring of the model id, first match in this order wins.
#   opus   -> 5, 25
#   sonnet -> 3, 15
#   haiku  -> 1, 5
# Fallback for unmatched models -> 3, 15
# Cache rates derived from the input rate: write x 1.25, read x 0.10
# Accepted schemaType value: ModelInvocationLog
# Model id when absent: unknown-model ; user label when absent: unknown
# Status labels: Normal, Warning, Breach
# Enforcement modes, strongest first: REMOVED, ERROR, DRYRUN, SKIPPED
# Look-back 15 min, max look-back 7 days, object marker TTL 45 days,
# audit TTL 60 days, re-notify window 24 h, legacy token threshold 5,000,000,
# budget 20 USD, warn ratio 0.8, chart top-N 15, leaderboard depth 25,
# per-model depth 10.
# ---------------------------------------------------------------------------
DEFAULT_PRICE_ROWS = (
    ("opus", ("5.0", "25.0")),
    ("sonnet", ("3.0", "15.0")),
    ("haiku", ("1.0", "5.0")),
)
DEFAULT_FALLBACK_RATE = ("3.0", "15.0")
SCHEMA_TYPE = "ModelInvocationLog"
UNKNOWN_MODEL = "unknown-model"
UNKNOWN_USER = "unknown"
STATUS_NORMAL, STATUS_WARNING, STATUS_BREACH = "Normal", "Warning", "Breach"
MODES = ("REMOVED", "ERROR", "DRYRUN", "SKIPPED")


@dataclass(frozen=True)
class PriceEntry:
    """One price-table row: a lower-case substring pattern and 2 or 4 rates."""

    pattern: str
    rates: tuple[str, ...]

    def normalized(self, cw_mult: Decimal, cr_mult: Decimal) -> tuple[Decimal, ...]:
        return normalize_rates(self.rates, cw_mult, cr_mult)


@dataclass(frozen=True)
class Rates:
    """USD per million tokens; a cache rate left open follows from the input rate."""

    input: Decimal
    output: Decimal
    cache_write: Decimal | None = None
    cache_read: Decimal | None = None

    def filled(self, write_mult: Decimal, read_mult: Decimal) -> tuple[Decimal, Decimal, Decimal, Decimal]:
        write = self.input * write_mult if self.cache_write is None else self.cache_write
        read = self.input * read_mult if self.cache_read is None else self.cache_read
        return self.input, self.output, write, read


def normalize_rates(rates, cw_mult: Decimal, cr_mult: Decimal) -> tuple[Decimal, ...]:
    """Two or four listed rates -> four; a single cache rate (three values) is not used."""
    given = [Decimal(str(r)) for r in rates][:4]
    if len(given) < 2:
        raise ValueError(f"an input and an output rate are needed, got {rates!r}")
    return Rates(*(given if len(given) == 4 else given[:2])).filled(cw_mult, cr_mult)


def _json_object(value) -> dict:
    """A mapping, or the text of one; anything else is an empty mapping."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return {}
    return value if isinstance(value, dict) else {}


def price_entries_from_json(value) -> tuple[PriceEntry, ...]:
    """Price table from ``{pattern: [rates]}`` in the given order; the default
    table if there is none. An empty pattern would match every model: an error."""
    table = {str(k).lower(): rates for k, rates in _json_object(value).items()}
    if "" in table:
        raise ValueError("empty price pattern matches every model")
    return tuple(PriceEntry(k, tuple(map(str, rates))) for k, rates in table.items()) or DEFAULT_PRICES


DEFAULT_PRICES = tuple(PriceEntry(p, r) for p, r in DEFAULT_PRICE_ROWS)


@dataclass(frozen=True)
class MeterConfig:
    budget_usd: Decimal = Decimal("20")
    warn_ratio: Decimal = Decimal("0.8")
    prices: tuple[PriceEntry, ...] = DEFAULT_PRICES
    fallback_rate: tuple[str, ...] = DEFAULT_FALLBACK_RATE
    cache_write_multiplier: Decimal = Decimal("1.25")
    cache_read_multiplier: Decimal = Decimal("0.10")
    # scheduling / scan window
    schedule: str = "5 minutes"
    lookback_minutes: int = 15
    max_lookback_minutes: int = 7 * 24 * 60
    marker_ttl_days: int = 45
    # legacy per-(user, model, month) token alerts
    token_threshold: int = 5_000_000
    token_alerts: bool = False  # the rollup batches also write token alerts
    # dashboard / reader
    top_n: int = 15
    leaderboard_depth: int = 25
    per_model_depth: int = 10
    # enforcement
    enforce_enabled: bool = False
    enforce_dry_run: bool = True
    identity_store_id: str = ""
    group_ids: tuple[str, ...] = ()
    group_names: tuple[str, ...] = ()
    allow_list: tuple[str, ...] = ()
    audit_ttl_days: int = 60
    renotify_hours: int = 24
    # 'gap': silent while the audit before is of the same mode and younger than the window (every run renews it);
    # 'per_window': silent until the window after the last notice that was sent
    throttle: str = "gap"
    # month rule: 'offset' = month of the timestamp as written (default);
    # 'utc' = month after converting to UTC
    month_zone: str = "offset"
    alert_label: str = "Spend"

    @property
    def warn_usd(self) -> Decimal:
        return self.budget_usd * self.warn_ratio

    @property
    def warn_tokens(self) -> int:
        return int(self.token_threshold * float(self.warn_ratio))

    def with_(self, **kw) -> "MeterConfig":
        return replace(self, **kw)

    def normalized_prices(self) -> list[tuple[int, str, tuple[Decimal, ...]]]:
        cw, cr = self.cache_write_multiplier, self.cache_read_multiplier
        rows = [(i, p.pattern, p.normalized(cw, cr)) for i, p in enumerate(self.prices)]
        return rows

    def fallback_rates(self) -> tuple[Decimal, ...]:
        return normalize_rates(self.fallback_rate, self.cache_write_multiplier,
                               self.cache_read_multiplier)

    def enforcement_configured(self) -> bool:
        """Feature gate: enabled, a store id and at least one group."""
        return bool(self.enforce_enabled and self.identity_store_id
                    and (self.group_ids or self.group_names))


DEFAULT_CONFIG = MeterConfig()
