"""Price-table loading and rate normalisation."""

from decimal import Decimal

import pytest

from meterwise.config import DEFAULT_PRICES, MeterConfig, normalize_rates, price_entries_from_json


def test_price_json_rules():
    assert price_entries_from_json("not json") == DEFAULT_PRICES
    assert price_entries_from_json("{}") == DEFAULT_PRICES
    assert price_entries_from_json("[1, 2]") == DEFAULT_PRICES
    e = price_entries_from_json('{"Opus-X": [5, 25], "sonnet": [3, 15, 99], "haiku": [1, 5, 1.5, 0.2]}')
    assert [x.pattern for x in e] == ["opus-x", "sonnet", "haiku"]            # lower-cased, order kept
    with pytest.raises(ValueError):
        price_entries_from_json('{"": [1, 2]}')                               # would match every model


def test_rate_normalisation():
    cw, cr = Decimal("1.25"), Decimal("0.10")
    assert normalize_rates(["3", "15"], cw, cr) == (Decimal("3"), Decimal("15"), Decimal("3.75"), Decimal("0.300"))
    assert normalize_rates(["3", "15", "99"], cw, cr) == normalize_rates(["3", "15"], cw, cr)   # 3 behave as 2
    assert normalize_rates(["5", "25", "6", "0.4"], cw, cr) == (Decimal("5"), Decimal("25"), Decimal("6"), Decimal("0.4"))
    cfg = MeterConfig()
    assert cfg.warn_usd == Decimal("16.0") and cfg.warn_tokens == 4_000_000
    assert not cfg.enforcement_configured()
    assert cfg.with_(enforce_enabled=True, identity_store_id="s", group_names=("g",)).enforcement_configured()
