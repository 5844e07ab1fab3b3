"""Parameters of the registered queries (fixture budgets, filters, month)."""

from __future__ import annotations

from decimal import Decimal

from meterwise.config import STATUS_BREACH, STATUS_WARNING, MeterConfig
from meterwise.operators.dashboard import DashboardFilters

# F1 (events, January 2024): budget 4.00, warn 0.8; the legacy token alert
# threshold is 1,000,000 per (user, model, month) so crossings occur.
F1_CFG = MeterConfig(budget_usd=Decimal("4.00"), warn_ratio=Decimal("0.8"), token_threshold=1_000_000)
# F3 (orders, 80 months): budget 2.00, warn 0.8.
F3_CFG = MeterConfig(budget_usd=Decimal("2.00"), warn_ratio=Decimal("0.8"))

F1_MONTH = "2024-01"
F3_MONTH = "2000-06"
TOP_MODEL_MONTH_N = 10
SEARCH = DashboardFilters(user_query="USER1[0-4]")
FILTERS = DashboardFilters(models=("x.claude-opus-4", "x.claude-sonnet-4"),
                           statuses=(STATUS_WARNING, STATUS_BREACH), min_spend=3.0)
# The dashboard's default: every model, status and user.
TABLE_FILTERS = DashboardFilters()
WHAT_IF_BUDGETS = (3.0, 4.0, 5.0, 6.0)
ACTOR = "dashboard-user"
HIST_BINS = 40

# Enforcement fixture: directory from customer/nation; group ids and names
# mixed, one duplicate (NATION_3 is g-3) and one unknown name.
ENFORCE_CFG = F1_CFG.with_(enforce_enabled=True, identity_store_id="store-1",
                           group_ids=("g-3",), group_names=("NATION_5", "NATION_3", "NO_SUCH_GROUP"),
                           allow_list=("user7", "user42"))
# The same with dry-run off: memberships count as removed.
REMOVE_CFG = ENFORCE_CFG.with_(enforce_dry_run=False)

PRICE_TEXTS = (("override", '{"Sonnet": [2, 10, 3], "OPUS": [4, 20], "haiku": [1, 5, 2, 0.5]}'), ("default", "no JSON"))
