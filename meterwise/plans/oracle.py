"""Independent DuckDB SQL for the registered queries.

Written from the operator semantics, not from the Spark plans: costs are
exact decimals cast to DOUBLE last, counters are cast to BIGINT, ties are
broken explicitly, no clock functions are used.
"""

from __future__ import annotations

from meterwise.plans import fixtures as fx
from meterwise.sources.raw_records import CHUNK_EVENTS
from meterwise.sources.tables import EVENT_MODEL, ORDER_MODEL, OTHER_MODEL

TOK = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")
U = '"user"'

ORACLE: dict[str, str] = {}

# USD per token of the default price table: first match, then the fallback (fixed values).
RATES = (("opus", ("0.000005", "0.000025", "0.00000625", "0.0000005")),
         ("sonnet", ("0.000003", "0.000015", "0.00000375", "0.0000003")),
         ("haiku", ("0.000001", "0.000005", "0.00000125", "0.0000001")))
FALLBACK = ("0.000003", "0.000015", "0.00000375", "0.0000003")


def sql_cost(model: str, tokens: list[str]) -> str:
    terms = []
    for k, t in enumerate(tokens):
        whens = " ".join(f"WHEN lower(coalesce({model}, '')) LIKE '%{p}%' THEN CAST({r[k]} AS DECIMAL(16,12))" for p, r in RATES)
        terms.append(f"CAST(coalesce({t}, 0) AS DECIMAL(18,0)) * (CASE {whens} ELSE CAST({FALLBACK[k]} AS DECIMAL(16,12)) END)")
    return "(" + " + ".join(terms) + ")"


def sql_status(cost: str, cfg) -> str:
    b = f"CAST({cfg.budget_usd} AS DECIMAL(38,12))"
    return (f"(CASE WHEN {cost} < {b} * CAST({cfg.warn_ratio} AS DECIMAL(4,2)) THEN 'Normal' "
            f"WHEN {cost} < {b} THEN 'Warning' ELSE 'Breach' END)")


def sql_fraction_status(fraction: str, cfg) -> str:
    return f"(CASE WHEN {fraction} < {float(cfg.warn_ratio)!r} THEN 'Normal' WHEN {fraction} < 1.0 THEN 'Warning' ELSE 'Breach' END)"


def sql_short_model(m: str) -> str:
    tail = f"regexp_replace({m}, '^.*?inference-profile/', '')"
    return f"coalesce(nullif({tail}, ''), CASE WHEN coalesce({m}, '') = '' THEN '?' ELSE '' END)"


def _case(col: str, pairs, default: str | None) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in pairs)
    return f"(CASE {whens} ELSE {'NULL' if default is None else repr(default)} END)"


INV_EVENTS = f"""
SELECT event_id AS record_id, ts, 'user' || CAST(user_id AS VARCHAR) AS {U},
       {_case('event_type', EVENT_MODEL, OTHER_MODEL)} AS model_id,
       substr(CAST(ts AS VARCHAR), 1, 7) AS month,
       CAST(floor(value * 100) AS BIGINT) AS input_tokens,
       CAST(floor(value * 10) AS BIGINT) AS output_tokens,
       CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS cache_write_tokens,
       CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 AS cache_read_tokens
FROM events"""

INV_ORDERS = f"""
SELECT o_orderkey AS record_id, o_orderdate AS ts, 'cust' || CAST(o_custkey AS VARCHAR) AS {U},
       {_case('substr(o_orderpriority, 1, 1)', ORDER_MODEL, None)} AS model_id,
       substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS month,
       CAST(floor(o_totalprice) AS BIGINT) AS input_tokens,
       CAST(floor(o_totalprice / 10) AS BIGINT) AS output_tokens,
       CAST(0 AS BIGINT) AS cache_write_tokens, CAST(0 AS BIGINT) AS cache_read_tokens
FROM orders"""


def usage_sql(inv: str) -> str:
    sums = ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in TOK)
    return (f"SELECT {U}, model_id, month, {sums}, CAST(count(*) AS BIGINT) AS invocations, "
            f"max(ts) AS last_ts FROM {inv} GROUP BY {U}, model_id, month")


def with_total(rel: str) -> str:
    return f"SELECT *, {' + '.join(TOK)} AS total_tokens FROM {rel}"


def priced_sql(rel: str, cfg) -> str:
    return f"SELECT *, {sql_cost('model_id', list(TOK))} AS cost FROM {rel}"


def f1_base(cfg=fx.F1_CFG) -> str:
    return (f"WITH inv AS ({INV_EVENTS}),\n usage0 AS ({usage_sql('inv')}),\n"
            f" usage AS ({with_total('usage0')}),\n priced AS ({priced_sql('usage', cfg)})\n")


def f3_base(cfg=fx.F3_CFG) -> str:
    return (f"WITH inv AS ({INV_ORDERS}),\n usage0 AS ({usage_sql('inv')}),\n"
            f" usage AS ({with_total('usage0')}),\n priced AS ({priced_sql('usage', cfg)})\n")


def usd(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def pct_sql(cost_double: str, cfg) -> str:
    b = float(cfg.budget_usd)
    return f"({cost_double} / {b!r} * 100.0)" if b else "0.0"


def frac_sql(cost_double: str, cfg) -> str:
    return f"({cost_double} / {max(float(cfg.budget_usd), 1e-9)!r})"


def ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


COUNTERS = ", ".join((*TOK, "total_tokens", "invocations"))

# ---------------------------------------------------------------- step 1
ORACLE["user_month_spend"] = f1_base() + f"""
SELECT {U}, month, {usd('c')} AS cost_usd, {pct_sql(usd('c'), fx.F1_CFG)} AS pct_of_budget,
       {sql_status('c', fx.F1_CFG)} AS status
FROM (SELECT {U}, month, sum(cost) AS c FROM priced GROUP BY {U}, month)"""

ORACLE["usage_rollup"] = f1_base() + f"SELECT {U}, model_id, month, {COUNTERS} FROM usage"

ORACLE["row_cost"] = f1_base() + f"SELECT {U}, model_id, month, {', '.join(TOK)}, {usd('cost')} AS cost_usd FROM priced"


def _first_match(values, otherwise: str) -> str:
    whens = " ".join(f"WHEN lower(coalesce(model_id, '')) LIKE '%{p}%' THEN {v}" for (p, _), v in zip(RATES, values))
    return f"(CASE {whens} ELSE {otherwise} END)"


def _per_million(rate: str) -> str:
    return f"CAST(CAST({rate} AS DECIMAL(16,12)) * 1000000 AS DOUBLE)"


_NAMES_R = ("rate_in", "rate_out", "rate_cw", "rate_cr")


ORACLE["model_rates"] = f1_base() + f"""
SELECT model_id, {_first_match([f"'{p}'" for p, _ in RATES], 'NULL')} AS matched_pattern, CAST(sum(invocations) AS BIGINT) AS invocations,
       {', '.join(_first_match([_per_million(r[k]) for _, r in RATES], _per_million(FALLBACK[k])) + f' AS {n}' for k, n in enumerate(_NAMES_R))}
FROM usage GROUP BY model_id"""


# What fixtures.PRICE_TEXTS must give: USD per million tokens; a single cache rate is not used.
_OVERRIDE = (("opus", (4, 20, 5, "0.4")), ("sonnet", (2, 10, "2.5", "0.2")), ("haiku", (1, 5, 2, "0.5")))
_OTHERS = (3, 15, "3.75", "0.3")


def _override_cost() -> str:
    terms = []
    for k, t in enumerate(TOK):
        whens = " ".join(f"WHEN lower(model_id) LIKE '%{p}%' THEN CAST({r[k]} AS DECIMAL(10,6))" for p, r in _OVERRIDE)
        terms.append(f"sum(CAST({t} AS DECIMAL(18,0)) * CASE {whens} ELSE CAST({_OTHERS[k]} AS DECIMAL(10,6)) END)")
    return f"CAST(({' + '.join(terms)}) / 1000000 AS DOUBLE)"


ORACLE["price_override"] = f1_base() + f"""
SELECT 'override' AS prices, model_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {_override_cost()} AS cost_usd
FROM usage GROUP BY model_id
UNION ALL SELECT 'default', model_id, CAST(sum(total_tokens) AS BIGINT), {usd('sum(cost)')} FROM priced GROUP BY model_id"""


def _price_rows_sql() -> str:
    rows = [*((f"'{p}'", r) for p, r in RATES), ("NULL", FALLBACK)]
    return " UNION ALL ".join(f"SELECT {i} AS priority, {p} AS pattern, "
                              + ", ".join(f"{_per_million(x)} AS {n}" for x, n in zip(r, _NAMES_R))
                              for i, (p, r) in enumerate(rows))


ORACLE["price_table"] = f1_base() + f""",
 counts AS (SELECT {_first_match([f"'{p}'" for p, _ in RATES], 'NULL')} AS pattern, sum(invocations) AS n FROM usage GROUP BY 1),
 prices AS ({_price_rows_sql()})
SELECT CAST(p.priority AS INTEGER) AS priority, p.pattern, CAST(p.rate_in AS DOUBLE) AS rate_in,
       CAST(p.rate_out AS DOUBLE) AS rate_out, CAST(p.rate_cw AS DOUBLE) AS rate_cw,
       CAST(p.rate_cr AS DOUBLE) AS rate_cr, CAST(coalesce(c.n, 0) AS BIGINT) AS invocations
FROM prices p LEFT JOIN counts c ON p.pattern IS NOT DISTINCT FROM c.pattern"""

ORACLE["budget_status"] = f3_base() + f"""
SELECT {U}, month, {usd('c')} AS cost_usd, {sql_status('c', fx.F3_CFG)} AS status
FROM (SELECT {U}, month, sum(cost) AS c FROM priced GROUP BY {U}, month)"""

ORACLE["budget_pct"] = f3_base() + f"""
SELECT {U}, month, {usd('c')} AS cost_usd, {pct_sql(usd('c'), fx.F3_CFG)} AS pct_of_budget,
       round_even({frac_sql(usd('c'), fx.F3_CFG)} * 100.0, 1) AS pct_display
FROM (SELECT {U}, month, sum(cost) AS c FROM priced GROUP BY {U}, month)"""

ORACLE["over_budget_users"] = f1_base() + f"""
SELECT {U}, month, {usd('c')} AS cost_usd
FROM (SELECT {U}, month, sum(cost) AS c FROM priced GROUP BY {U}, month)
WHERE c >= CAST({fx.F1_CFG.budget_usd} AS DECIMAL(38,12))"""

# ---------------------------------------------------------------- step 2
ORACLE["model_totals"] = f1_base() + f"""
SELECT model_id, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in TOK)},
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(invocations) AS BIGINT) AS invocations,
       {usd(sql_cost('model_id', [f'sum({t})' for t in TOK]))} AS cost_usd
FROM usage GROUP BY model_id"""

ORACLE["leaderboard"] = f1_base() + f"""
SELECT {U}, {usd('c')} AS cost_usd, {pct_sql(usd('c'), fx.F1_CFG)} AS pct_of_budget,
       {sql_status('c', fx.F1_CFG)} AS status, total_tokens, invocations
FROM (SELECT {U}, sum(cost) AS c, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
             CAST(sum(invocations) AS BIGINT) AS invocations
      FROM priced WHERE month = '{fx.F1_MONTH}' GROUP BY {U})
ORDER BY c DESC, {U} ASC LIMIT {fx.F1_CFG.leaderboard_depth}"""

ORACLE["model_leaderboard"] = f1_base() + f"""
SELECT model_id, CAST(rank AS INTEGER) AS rank, {U}, input_tokens, output_tokens, {usd('cost')} AS cost_usd, invocations
FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY cost DESC, {U} ASC) AS rank
      FROM priced WHERE month = '{fx.F1_MONTH}')
WHERE rank <= {fx.F1_CFG.per_model_depth}"""

ORACLE["top_users_model_month"] = f3_base() + f"""
SELECT model_id, month, CAST(rank AS INTEGER) AS rank, {U}, total_tokens, invocations
FROM (SELECT *, row_number() OVER (PARTITION BY model_id, month ORDER BY total_tokens DESC, {U} ASC) AS rank
      FROM usage)
WHERE rank <= {fx.TOP_MODEL_MONTH_N}"""

DETAIL_SELECT = (f"{U}, {sql_short_model('model_id')} AS model, month, {', '.join(TOK)}, total_tokens, "
                 f"{usd('cost')} AS cost_usd, invocations, "
                 f"coalesce({ts_text('last_ts')} || ' UTC', '—') AS last_updated_utc")
DETAIL_COLS = f"{U}, model, month, {', '.join(TOK)}, total_tokens, cost_usd, invocations, last_updated_utc"

ORACLE["detail_rows"] = f1_base() + f"SELECT {DETAIL_SELECT} FROM priced"


def detail_cte(cfg=fx.F1_CFG) -> str:
    return f""",
 detail0 AS (SELECT {DETAIL_SELECT}, model_id, cost,
                    sum(cost) OVER (PARTITION BY {U}, month) AS um FROM priced),
 detail AS (SELECT *, {usd('um')} AS user_month_spend, {frac_sql(usd('um'), cfg)} AS pct,
                   round_even({frac_sql(usd('um'), cfg)} * 100.0, 1) AS pct_display,
                   {sql_fraction_status(frac_sql(usd('um'), cfg), cfg)} AS status FROM detail0)
"""


ROW_STATUS_COLS = f"{DETAIL_COLS}, user_month_spend, pct, pct_display, status"

ORACLE["detail_with_user_spend"] = f1_base() + detail_cte() + f"SELECT {ROW_STATUS_COLS} FROM detail"


def _in_list(vals) -> str:
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


def filter_where(flt) -> str:
    conds = ["TRUE"]
    if flt.user_query:
        conds.append(f"coalesce(regexp_matches({U}, '(?i){flt.user_query}'), FALSE)")
    if flt.models:
        conds.append(f"model IN {_in_list(flt.models)}")
    if flt.statuses:
        conds.append(f"status IN {_in_list(flt.statuses)}")
    if flt.min_spend > 0:
        conds.append(f"user_month_spend >= {float(flt.min_spend)!r}")
    return " AND ".join(conds)


ORACLE["user_spend_table"] = f1_base() + detail_cte() + f""",
 fdf AS (SELECT * FROM detail WHERE {filter_where(fx.TABLE_FILTERS)}),
 ut AS (SELECT {U}, month, sum(cost) AS c, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in TOK)},
               CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(invocations) AS BIGINT) AS invocations
        FROM fdf GROUP BY {U}, month)
SELECT {U}, month, {usd('c')} AS cost_usd, {', '.join(TOK)}, total_tokens, invocations,
       {frac_sql(usd('c'), fx.F1_CFG)} AS pct, round_even({frac_sql(usd('c'), fx.F1_CFG)} * 100.0, 1) AS pct_display,
       {sql_fraction_status(frac_sql(usd('c'), fx.F1_CFG), fx.F1_CFG)} AS status
FROM ut"""

ORACLE["short_model"] = f3_base() + f"""
SELECT model_id, {sql_short_model('model_id')} AS model, CAST(sum(invocations) AS BIGINT) AS invocations
FROM usage GROUP BY model_id"""

ORACLE["usage_normalise"] = f3_base() + f"SELECT {U}, model_id, month, {COUNTERS} FROM usage"

# ---------------------------------------------------------------- step 3
ORACLE["user_search"] = f1_base() + detail_cte() + f"SELECT {ROW_STATUS_COLS} FROM detail WHERE {filter_where(fx.SEARCH)}"
ORACLE["dashboard_filters"] = f1_base() + detail_cte() + f"SELECT {ROW_STATUS_COLS} FROM detail WHERE {filter_where(fx.FILTERS)}"

_FDF = f""",
 fdf AS (SELECT * FROM detail WHERE {filter_where(fx.TABLE_FILTERS)})
"""
_W = float(fx.F1_CFG.warn_ratio)
ORACLE["kpi_tiles"] = f1_base() + detail_cte() + _FDF + f""",
 ut AS (SELECT {U}, month, {frac_sql(usd('sum(cost)'), fx.F1_CFG)} AS frac FROM fdf GROUP BY {U}, month)
SELECT (SELECT CAST(count(DISTINCT {U}) AS BIGINT) FROM fdf) AS users,
       (SELECT CAST(count(DISTINCT model) AS BIGINT) FROM fdf) AS models,
       (SELECT {usd('sum(cost)')} FROM fdf) AS total_spend_usd,
       (SELECT CAST(sum(total_tokens) AS BIGINT) FROM fdf) AS total_tokens,
       (SELECT CAST(count(*) AS BIGINT) FROM ut WHERE frac >= {_W!r} AND frac < 1.0) AS warnings,
       (SELECT CAST(count(*) AS BIGINT) FROM ut WHERE frac >= 1.0) AS breaches"""


def _top_n_sql(group: str, n: int, values: list[tuple[str, bool]]) -> str:
    v0 = values[0][0]
    sums = ", ".join(f"sum({v}) AS {v}" for v, _ in values)
    outs = ", ".join((f"{usd(v)} AS {v}_usd" if money else f"CAST({v} AS BIGINT) AS {v}") for v, money in values)
    return f""",
 g AS (SELECT {group} AS grp, {sums} FROM fdf GROUP BY {group}),
 r AS (SELECT *, row_number() OVER (ORDER BY {v0} DESC, grp ASC) AS rn FROM g),
 f AS (SELECT CASE WHEN rn <= {n} THEN grp END AS grp, CASE WHEN rn <= {n} THEN rn ELSE {n + 1} END AS rank,
              {', '.join(f'{v}' for v, _ in values)} FROM r),
 o AS (SELECT grp, rank, {sums}, count(*) AS k FROM f GROUP BY grp, rank)
SELECT coalesce(grp, 'Others (' || CAST(k AS VARCHAR) || ')') AS {group}, CAST(rank AS INTEGER) AS rank, {outs} FROM o"""


ORACLE["top_users_others"] = f1_base() + detail_cte() + _FDF + _top_n_sql(U, fx.F1_CFG.top_n, [("cost", True), ("total_tokens", False)])
ORACLE["top_models_others"] = f1_base() + detail_cte() + _FDF + _top_n_sql(
    "model", fx.F1_CFG.top_n, [("cost", True), ("input_tokens", False), ("output_tokens", False)])

ORACLE["user_model_heatmap"] = f1_base() + detail_cte() + f""",
 tu AS (SELECT {U}, CAST(row_number() OVER (ORDER BY c DESC, {U} ASC) AS INTEGER) AS user_rank
        FROM (SELECT {U}, sum(cost) AS c FROM detail GROUP BY {U}) ORDER BY c DESC, {U} ASC LIMIT {fx.F1_CFG.top_n}),
 models AS (SELECT DISTINCT model FROM detail WHERE {U} IN (SELECT {U} FROM tu)),
 cells AS (SELECT {U}, model, sum(cost) AS c FROM detail WHERE {U} IN (SELECT {U} FROM tu) GROUP BY {U}, model)
SELECT tu.{U}, m.model, {usd('coalesce(cells.c, 0)')} AS cost_usd, tu.user_rank,
       round_even(ln(1 + {usd('coalesce(cells.c, 0)')}), 12) AS log_cost
FROM tu CROSS JOIN models m LEFT JOIN cells ON cells.{U} = tu.{U} AND cells.model = m.model"""

ORACLE["spend_histogram"] = f1_base() + detail_cte() + _FDF + f""",
 ut AS (SELECT {U}, month, {usd('sum(cost)')} AS cost_usd FROM fdf GROUP BY {U}, month),
 mm AS (SELECT min(cost_usd) AS lo, max(cost_usd) - min(cost_usd) AS span FROM ut),
 b AS (SELECT CAST(CASE WHEN span = 0 THEN 0 ELSE least(floor((cost_usd - lo) / span * {fx.HIST_BINS}), {fx.HIST_BINS - 1}) END AS BIGINT) AS bin,
              lo, span FROM ut, mm)
SELECT bin, lo + span * bin / {float(fx.HIST_BINS)} AS bin_lo, lo + span * (bin + 1) / {float(fx.HIST_BINS)} AS bin_hi,
       CAST(count(*) AS BIGINT) AS users
FROM b GROUP BY bin, lo, span"""

ORACLE["what_if_budget"] = f1_base() + f""",
 s AS (SELECT {U}, month, {usd('sum(cost)')} AS cost_usd FROM priced GROUP BY {U}, month),
 x AS (SELECT cost_usd, unnest([{', '.join(repr(float(b)) for b in fx.WHAT_IF_BUDGETS)}]) AS budget_usd FROM s)
SELECT budget_usd,
       CASE WHEN cost_usd / greatest(budget_usd, 1e-9) >= 1.0 THEN 'Breach'
            WHEN cost_usd / greatest(budget_usd, 1e-9) >= {_W!r} THEN 'Warning' ELSE 'Normal' END AS status,
       CAST(count(*) AS BIGINT) AS users
FROM x GROUP BY ALL"""

# ---------------------------------------------------------------- step 4
_MT = f"""
 mt AS (SELECT model_id, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in TOK)},
               CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(invocations) AS BIGINT) AS invocations,
               round_even({sql_cost('model_id', [f'sum({t})' for t in TOK])}, 4) AS cost4
        FROM usage GROUP BY model_id)"""
_MBM = f""",{_MT},
 mbm AS (SELECT model_id, CAST(0 AS BIGINT) AS grouping_id, {COUNTERS}, {usd('cost4')} AS cost_usd FROM mt
         UNION ALL
         SELECT NULL, 1, {', '.join(f'CAST(sum({c}) AS BIGINT)' for c in (*TOK, 'total_tokens', 'invocations'))},
                {usd('sum(cost4)')} FROM mt)
"""
ORACLE["metrics_by_model"] = f1_base() + _MBM + "SELECT * FROM mbm"

ORACLE["metrics_cube"] = f"""
WITH inv AS ({INV_EVENTS}), t AS (SELECT *, greatest({' + '.join(TOK)}, 0) AS total_tokens FROM inv)
SELECT {U}, model_id, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in (*TOK, 'total_tokens'))},
       CAST(count(*) AS BIGINT) AS invocations, CAST(grouping({U}, model_id) AS BIGINT) AS grouping_id
FROM t GROUP BY CUBE ({U}, model_id)"""


def _priced_inv(cfg=fx.F1_CFG) -> str:
    return (f"WITH inv AS ({INV_EVENTS}),\n pinv AS (SELECT *, {' + '.join(TOK)} AS total_tokens, "
            f"{sql_cost('model_id', list(TOK))} AS cost, "
            f"time_bucket(INTERVAL '5 minutes', ts) AS run FROM inv)\n")


ORACLE["series_5m_total"] = _priced_inv() + f"""
SELECT {ts_text('run')} AS window_start, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in (*TOK, 'total_tokens'))},
       CAST(count(*) AS BIGINT) AS invocations, {usd('sum(cost)')} AS cost_usd
FROM pinv GROUP BY run"""

ORACLE["series_5m_by_model"] = _priced_inv() + f"""
SELECT {ts_text('run')} AS window_start, model_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
       CAST(count(*) AS BIGINT) AS invocations, {usd('sum(cost)')} AS cost_usd
FROM pinv GROUP BY run, model_id"""

ORACLE["late_data_policy"] = _priced_inv() + f"""
SELECT {ts_text('run')} AS window_start, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in (*TOK, 'total_tokens'))},
       CAST(count(*) AS BIGINT) AS invocations, {usd('sum(cost)')} AS cost_usd,
       run + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM pinv) - INTERVAL 10 MINUTE AS closed
FROM pinv GROUP BY run"""

_NAMES = ("InputTokens", "OutputTokens", "CacheWriteTokens", "CacheReadTokens", "TotalTokens", "Invocations", "CostUSD")
ORACLE["metric_rows"] = f1_base() + _MBM + " UNION ALL ".join(
    f"SELECT CASE WHEN grouping_id = 1 THEN '' ELSE 'ModelId=' || model_id END AS dims, '{n}' AS name, "
    f"CAST({c} AS DOUBLE) AS value FROM mbm"
    for c, n in zip((*TOK, "total_tokens", "invocations", "cost_usd"), _NAMES))

# ---------------------------------------------------------------- step 6
_BA = _priced_inv() + f""",
 d AS (SELECT {U}, month, run, sum(cost) AS delta FROM pinv GROUP BY {U}, month, run),
 ba AS (SELECT *, sum(delta) OVER (PARTITION BY {U}, month ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS new_cost
        FROM d),
 ba2 AS (SELECT *, greatest(new_cost - delta, 0) AS prev_cost FROM ba)
"""
ORACLE["spend_delta"] = _BA + f"SELECT {U}, month, {ts_text('run')} AS run, {usd('delta')} AS delta_usd FROM d"
ORACLE["spend_before_after"] = _BA + (f"SELECT {U}, month, {ts_text('run')} AS run, {usd('delta')} AS delta_usd, "
                                      f"{usd('prev_cost')} AS prev_usd, {usd('new_cost')} AS new_usd FROM ba2")
ORACLE["spend_alerts"] = _BA + f""",
 lv AS (SELECT 'WARN' AS level, CAST({fx.F1_CFG.warn_usd} AS DECIMAL(38,12)) AS boundary
        UNION ALL SELECT 'BREACH', CAST({fx.F1_CFG.budget_usd} AS DECIMAL(38,12)))
SELECT {U}, month, {ts_text('run')} AS run, level, {usd('boundary')} AS boundary_usd,
       {usd('prev_cost')} AS prev_usd, {usd('new_cost')} AS new_usd
FROM ba2, lv WHERE delta > 0 AND prev_cost < boundary AND boundary <= new_cost"""

ORACLE["token_crossings"] = f"""
WITH inv AS ({INV_EVENTS}),
 t AS (SELECT {U}, model_id, month, record_id, ts, {' + '.join(TOK)} AS tokens FROM inv),
 r AS (SELECT *, sum(tokens) OVER (PARTITION BY {U}, model_id, month ORDER BY ts, record_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS new_total FROM t),
 lv AS (SELECT 'WARN' AS level, CAST({fx.F1_CFG.warn_tokens} AS BIGINT) AS boundary
        UNION ALL SELECT 'BREACH', CAST({fx.F1_CFG.token_threshold} AS BIGINT))
SELECT {U}, model_id, month, level, boundary, record_id, CAST(new_total - tokens AS BIGINT) AS prev_total,
       CAST(new_total AS BIGINT) AS new_total
FROM r, lv WHERE new_total - tokens < boundary AND boundary <= new_total"""

_TT = fx.F1_CFG.token_threshold
_TOKEN_SUBJECT = (f"substr('[{fx.F1_CFG.alert_label} ' || level || '] ' || {U} || ' crossed ' || format('{{:,}}', boundary) || "
                  "' tokens on ' || model_id || ' (' || month || ')', 1, 100) AS subject")
ORACLE["token_alert_text"] = f"""
SELECT level, {U}, model_id, month, CAST(record_id AS VARCHAR) AS record_id, {_TOKEN_SUBJECT},
       'Token usage of this month has passed an alert level.' || chr(10) || chr(10) ||
       '  Level         : ' || level || chr(10) || '  User          : ' || {U} || chr(10) ||
       '  Model         : ' || model_id || chr(10) || '  Month         : ' || month || chr(10) ||
       '  Previous total: ' || format('{{:,}}', prev_total) || ' tokens' || chr(10) ||
       '  New total     : ' || format('{{:,}}', new_total) || ' tokens' || chr(10) ||
       '  Boundary      : ' || format('{{:,}}', boundary) || ' tokens' || chr(10) ||
       '  Threshold     : {_TT:,} tokens (warn at {int(fx.F1_CFG.warn_ratio * 100)}%)' || chr(10) AS body
FROM ({ORACLE["token_crossings"]})"""
ORACLE["stream_token_alerts"] = f"""
SELECT level, {U}, model_id, month, boundary, {_TOKEN_SUBJECT} FROM ({ORACLE["token_crossings"]})"""

ORACLE["usage_notice"] = f1_base() + detail_cte() + _FDF + f""",
 sel AS (SELECT DISTINCT {U}, month FROM detail WHERE status = 'Breach'),
 ut AS (SELECT {U}, month, {usd('sum(cost)')} AS cost_usd,
               {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in TOK)},
               CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(invocations) AS BIGINT) AS invocations
        FROM fdf WHERE ({U}, month) IN (SELECT {U}, month FROM sel) GROUP BY {U}, month),
 pm AS (SELECT {U}, month, CAST(count(*) AS INTEGER) AS n_models,
               string_agg('    - ' || model || ': $' || format('{{:,.2f}}', cost_usd) || ' (' ||
                          format('{{:,}}', total_tokens) || ' tok, ' || format('{{:,}}', invocations) || ' inv)',
                          chr(10) ORDER BY model, cost_usd, total_tokens, invocations) AS per_model_text
        FROM fdf WHERE ({U}, month) IN (SELECT {U}, month FROM sel) GROUP BY {U}, month)
SELECT ut.{U}, ut.month, cost_usd, {pct_sql('cost_usd', fx.F1_CFG)} AS pct_of_budget, total_tokens, {', '.join(TOK)},
       invocations, n_models,
       substr('[{fx.F1_CFG.alert_label} USAGE] ' || ut.{U} || ' • $' || format('{{:,.2f}}', cost_usd) || ' spend (' || ut.month || ')', 1, 100) AS subject,
       per_model_text,
       'This usage notice was sent by hand.' || chr(10) || chr(10) ||
       '  User           : ' || ut.{U} || chr(10) ||
       '  Month          : ' || ut.month || chr(10) ||
       '  Total spend    : $' || format('{{:,.2f}}', cost_usd) || chr(10) ||
       '  Budget         : ${float(fx.F1_CFG.budget_usd):,.2f} per user / month (all models)' || chr(10) ||
       '  Consumption    : ' || format('{{:.1f}}', {pct_sql('cost_usd', fx.F1_CFG)}) || '% of budget' || chr(10) ||
       '  Total tokens   : ' || format('{{:,}}', total_tokens) || ' (in ' || format('{{:,}}', input_tokens) || ' / out ' ||
       format('{{:,}}', output_tokens) || ' / cache-write ' || format('{{:,}}', cache_write_tokens) || ' / cache-read ' ||
       format('{{:,}}', cache_read_tokens) || ')' || chr(10) ||
       '  Invocations    : ' || format('{{:,}}', invocations) || chr(10) ||
       '  Per-model spend: ' || chr(10) || per_model_text || chr(10) ||
       '  Triggered by   : {fx.ACTOR}' || chr(10) AS body,
       '{fx.ACTOR}' AS actor
FROM ut JOIN pm ON ut.{U} = pm.{U} AND ut.month = pm.month"""

# ---------------------------------------------------------------- step 5 (raw logs)
_REG = "(CASE event_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-west-2' ELSE 'eu-west-1' END)"
_RAW = f"WITH inv AS ({INV_EVENTS}),\n raw AS (SELECT inv.*, e.event_id, e.user_id, {_REG} AS region, e.event_id % 5 AS slice FROM inv JOIN events e ON e.event_id = inv.record_id)\n"
_INV_OUT = f"'req-' || CAST(event_id AS VARCHAR) AS request_id, {ts_text('ts')} AS ts, {U}, model_id, month, {', '.join(TOK)}"
_OBJ = (f"{_REG} || '/' || strftime(ts, '%Y/%m/%d') || '/00/' || CAST(event_id % 5 AS VARCHAR) || '-' || "
        f"CAST(event_id // {CHUNK_EVENTS} AS VARCHAR)")

ORACLE["decode_records"] = _RAW + f"SELECT {_INV_OUT} FROM raw"
ORACLE["region_pruned_scan"] = _RAW + f"SELECT {_INV_OUT} FROM raw WHERE region IN ('us-east-1', 'eu-west-1')"
# What the odd records must become, by event id: the values in the order of raw_records.ODD_*.
_WELL, _ODD = "'req-' || CAST(event_id AS VARCHAR) AS request_id", "'odd-' || CAST(event_id AS VARCHAR) AS request_id"


def _nth(values: tuple, kind: str = "VARCHAR") -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" if kind == "VARCHAR" else str(v) for v in values)
    return f"CAST([{listed}][event_id % {len(values)} + 1] AS {kind})"


_ODD_USER = _nth(("arn:aws:iam::1:root", "unknown", "arn:aws:sts::1:assumed-role/R/", "b c"))
_ODD_TYPE = ("ModelInvocationLog", None, None, "")
_ODD_IN = (12, 12, 10, 0, 1, 0, 0, -3, 100, 0)
_ODD_FAILS = (3, 5, 9)  # counts that int() rejects zero all four
_ODD_KIND = ("BIGINT", "DECIMAL(3,1)", "STRING", "STRING", "BOOLEAN", "STRING", "MISSING", "BIGINT", "DOUBLE", "ARRAY<BIGINT>")
_ODD_MONTH = ("2024-01", "2024-02", "2024-03", "1970-01", "1970-01", "2024-03", "1970-01")
_ODD_TOKENS = ", ".join([f"{_nth(_ODD_IN, 'BIGINT')} AS input_tokens"] + [
    f"CAST(CASE WHEN event_id % 10 IN {_ODD_FAILS} THEN 0 ELSE {n} END AS BIGINT) AS {t}" for t, n in zip(TOK[1:], (2, 1, 0))])

ORACLE["identity_label"] = _RAW + f"SELECT {_WELL}, {U} FROM raw UNION ALL SELECT {_ODD}, {_ODD_USER} FROM events"
ORACLE["token_extract"] = _RAW + f"SELECT {_WELL}, {', '.join(TOK)} FROM raw UNION ALL SELECT {_ODD}, {_ODD_TOKENS} FROM events"
ORACLE["token_coerce"] = _RAW + (f"SELECT {_WELL}, "
                                 f"CASE WHEN slice = 1 THEN 'STRING' WHEN slice IN (2, 3) THEN 'MISSING' ELSE 'BIGINT' END AS input_kind, "
                                 f"{', '.join(TOK)} FROM raw UNION ALL SELECT {_ODD}, {_nth(_ODD_KIND)}, {_ODD_TOKENS} FROM events")
ORACLE["month_bucket"] = _RAW + f"SELECT {_WELL}, month FROM raw UNION ALL SELECT {_ODD}, {_nth(_ODD_MONTH)} FROM events"
ORACLE["stream_usage_last_wins"] = _RAW + (
    f"SELECT {_WELL}, "
    "CASE WHEN slice IN (2, 3, 4) THEN input_tokens ELSE 0 END AS usage_input_tokens, "
    "CASE WHEN slice IN (2, 3, 4) THEN output_tokens ELSE 0 END AS usage_output_tokens, "
    "CASE WHEN slice IN (2, 3, 4) THEN cache_write_tokens ELSE 0 END AS usage_cache_creation_input_tokens, "
    "CASE WHEN slice IN (2, 3, 4) THEN cache_read_tokens ELSE 0 END AS usage_cache_read_input_tokens FROM raw "
    f"UNION ALL SELECT {_ODD}, 0, 0, 0, 0 FROM events")
ORACLE["schema_type_filter"] = _RAW + (
    f"SELECT {_WELL}, "
    "CASE WHEN slice IN (0, 2, 4) THEN 'ModelInvocationLog' WHEN slice = 3 THEN '' END AS schema_type FROM raw "
    f"UNION ALL SELECT {_ODD}, {_nth(_ODD_TYPE)} FROM events WHERE {_nth(_ODD_TYPE)} IS NOT NULL")
ORACLE["log_scan"] = _RAW + f"SELECT DISTINCT {_OBJ} AS object_key, region, strftime(ts, '%Y/%m/%d') || '/00' AS hour, true AS has_content FROM raw"
ORACLE["modified_since"] = _RAW + f"SELECT DISTINCT {_OBJ} AS object_key FROM raw WHERE CAST(strftime(ts, '%d') AS INTEGER) >= 15"
ORACLE["object_rollup"] = _RAW + f"""
SELECT {_OBJ} AS object_key, {U}, model_id, month, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in TOK)},
       CAST(count(*) AS BIGINT) AS invocations, CAST(sum({' + '.join(TOK)}) AS BIGINT) AS total_tokens
FROM raw GROUP BY ALL"""
ORACLE["malformed_count"] = _RAW + f"""
SELECT {_OBJ} AS object_key, CAST(count(*) AS BIGINT) AS records,
       CAST(CASE WHEN any_value(slice) = 4 THEN 1 ELSE 0 END AS BIGINT) AS malformed
FROM raw GROUP BY 1"""
ORACLE["hour_prefixes"] = """
SELECT strftime(h, '%Y/%m/%d/%H') AS prefix
FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS h FROM events)"""
ORACLE["scan_window"] = f"""
WITH runs AS (SELECT DISTINCT time_bucket(INTERVAL '5 minutes', ts) AS now FROM events),
 c AS (SELECT now, lag(now) OVER (ORDER BY now) AS checkpoint FROM runs)
SELECT {ts_text('now')} AS now, {ts_text('checkpoint')} AS checkpoint,
       {ts_text(f"CASE WHEN checkpoint IS NULL THEN now - INTERVAL {fx.F1_CFG.lookback_minutes} MINUTE ELSE greatest(least(checkpoint, now - INTERVAL {fx.F1_CFG.lookback_minutes} MINUTE), now - INTERVAL {fx.F1_CFG.max_lookback_minutes} MINUTE) END")} AS cutoff
FROM c"""
ORACLE["run_summary"] = _RAW + f"""
SELECT (SELECT CAST(count(DISTINCT {_OBJ}) AS BIGINT) FROM raw) AS objects_seen,
       (SELECT string_agg(DISTINCT region, ',' ORDER BY region) FROM raw) AS regions,
       (SELECT CAST(count(DISTINCT {_OBJ}) AS BIGINT) FROM raw) AS objects_processed,
       CAST(0 AS BIGINT) AS objects_unreadable, CAST(0 AS BIGINT) AS records_skipped,
       (SELECT CAST(count(DISTINCT {_OBJ}) AS BIGINT) FROM raw WHERE slice = 4) AS malformed,
       (SELECT CAST(count(*) AS BIGINT) FROM raw) AS records_processed,
       (SELECT CAST(count(DISTINCT {U}) AS BIGINT) FROM raw) AS users_touched"""

# ---------------------------------------------------------------- subscription, ledger, stream, sinks
ORACLE["decode_subscription"] = ORACLE["decode_records"]
ORACLE["decode_streamed"] = ORACLE["decode_records"]
ORACLE["malformed_streamed"] = ORACLE["malformed_count"]
ORACLE["usage_counters"] = ORACLE["usage_rollup"]
ORACLE["stream_rollup"] = ORACLE["usage_rollup"]
ORACLE["scheduled_rollup"] = ORACLE["usage_rollup"]
ORACLE["event_rollup"] = ORACLE["usage_rollup"]
ORACLE["event_token_alerts"] = ORACLE["stream_token_alerts"]
ORACLE["usage_month_scan"] = f3_base() + f"SELECT {U}, model_id, month, {COUNTERS} FROM usage WHERE month = '{fx.F3_MONTH}'"
ORACLE["unprocessed_objects"] = _RAW + f"SELECT DISTINCT {_OBJ} AS object_key FROM raw WHERE CAST(strftime(ts, '%d') AS INTEGER) >= 15"
ORACLE["marker_expiry"] = f"""
SELECT 'obj-' || CAST(o_orderkey AS VARCHAR) AS object, {ts_text('o_orderdate')} AS processed_at
FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL {fx.F1_CFG.marker_ttl_days} DAY"""
_WP = int(fx.F1_CFG.warn_ratio * 100)
ORACLE["alert_text"] = _BA + f""",
 lv AS (SELECT 'WARN' AS level, CAST({fx.F1_CFG.warn_usd} AS DECIMAL(38,12)) AS boundary
        UNION ALL SELECT 'BREACH', CAST({fx.F1_CFG.budget_usd} AS DECIMAL(38,12))),
 a AS (SELECT *, {usd('prev_cost')} AS p, {usd('new_cost')} AS n, {usd('boundary')} AS b FROM ba2, lv
       WHERE delta > 0 AND prev_cost < boundary AND boundary <= new_cost)
SELECT level, {U}, month, {ts_text('run')} AS run,
       substr('[{fx.F1_CFG.alert_label} ' || level || '] ' || {U} || ' crossed $' || format('{{:.2f}}', b) || ' spend (' || month || ')', 1, 100) AS subject,
       'Spend of this month has passed an alert level.' || chr(10) || chr(10) ||
       '  Level         : ' || level || chr(10) ||
       '  User          : ' || {U} || chr(10) ||
       '  Month         : ' || month || chr(10) ||
       '  Previous spend: $' || format('{{:.2f}}', p) || chr(10) ||
       '  New spend     : $' || format('{{:.2f}}', n) || ' (' || format('{{:.1f}}', {pct_sql('n', fx.F1_CFG)}) || '% of budget)' || chr(10) ||
       '  Boundary      : $' || format('{{:.2f}}', b) || chr(10) ||
       '  Budget        : ${float(fx.F1_CFG.budget_usd):.2f} per user / month (warn at {_WP}%), summed across all models' || chr(10) AS body
FROM a"""

# ---------------------------------------------------------------- step 7 (enforcement)
_EC = fx.ENFORCE_CFG


def _enforce_ctes(ec=_EC) -> str:
    allow = ", ".join(f"'{u}'" for u in ec.allow_list) or "NULL"
    ids = " UNION ALL ".join(f"SELECT {i} AS ord, '{g}' AS label, '{g}' AS group_id" for i, g in enumerate(ec.group_ids))
    names = ", ".join(f"({len(ec.group_ids) + i}, '{n}')" for i, n in enumerate(ec.group_names))
    return f""",
 spend AS (SELECT {U}, month, sum(cost) AS c FROM priced GROUP BY {U}, month),
 cand AS (SELECT * FROM spend WHERE c >= CAST({ec.budget_usd} AS DECIMAL(38,12))
          AND {U} IS NOT NULL AND {U} NOT IN ('unknown', '') AND {U} NOT IN ({allow})),
 grp AS (SELECT n_name AS display_name, 'g-' || CAST(n_nationkey AS VARCHAR) AS group_id FROM nation),
 tall AS ({ids} UNION ALL
          SELECT n.ord, n.label, grp.group_id FROM (VALUES {names}) n(ord, label) JOIN grp ON grp.display_name = n.label),
 targets AS (SELECT CAST(ord AS INTEGER) AS ord, label, group_id
             FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ord) AS rn FROM tall) WHERE rn = 1),
 udir AS (SELECT 'user' || CAST(c_custkey AS VARCHAR) AS user_name, 'u-' || CAST(c_custkey AS VARCHAR) AS user_id
          FROM customer WHERE c_mktsegment <> 'BUILDING'),
 mem AS (SELECT 'g-' || CAST(c_nationkey AS VARCHAR) AS group_id, 'u-' || CAST(c_custkey AS VARCHAR) AS user_id,
                'm-' || CAST(c_custkey AS VARCHAR) || '-' || CAST(c_nationkey AS VARCHAR) AS membership_id FROM customer
         UNION ALL
         SELECT 'g-' || CAST((c_nationkey + 1) % 25 AS VARCHAR), 'u-' || CAST(c_custkey AS VARCHAR),
                'm-' || CAST(c_custkey AS VARCHAR) || '-' || CAST((c_nationkey + 1) % 25 AS VARCHAR)
         FROM customer WHERE c_acctbal > 5000),
 res AS (SELECT cand.{U}, cand.month, cand.c, udir.user_id FROM cand LEFT JOIN udir ON cand.{U} = udir.user_name),
 pairs AS (SELECT res.{U}, res.month, t.ord, t.label, t.group_id, m.membership_id
           FROM res CROSS JOIN targets t LEFT JOIN mem m ON m.user_id = res.user_id AND m.group_id = t.group_id
           WHERE res.user_id IS NOT NULL),
 pagg AS (SELECT {U}, month,
                 string_agg(label || ' (' || group_id || ', membership=' || membership_id || ')', '; ' ORDER BY ord)
                   FILTER (WHERE membership_id IS NOT NULL) AS members_txt,
                 string_agg(label || ' (' || group_id || ', reason=not_a_member)', '; ' ORDER BY ord)
                   FILTER (WHERE membership_id IS NULL) AS skipped_txt,
                 count(membership_id) AS n_mem
          FROM pairs GROUP BY {U}, month),
 decs AS (SELECT res.{U}, res.month,
                 CASE WHEN res.user_id IS NULL THEN 'ERROR' WHEN coalesce(n_mem, 0) > 0 THEN
                      {"'DRYRUN'" if ec.enforce_dry_run else "'REMOVED'"} ELSE 'SKIPPED' END AS mode,
                 res.user_id, CASE WHEN res.user_id IS NULL THEN 'user_unresolved' END AS reason,
                 {"'none'" if ec.enforce_dry_run else "coalesce(members_txt, 'none')"} AS removed_groups,
                 {"coalesce(members_txt, 'none')" if ec.enforce_dry_run else "'none'"} AS dryrun_groups,
                 coalesce(skipped_txt, 'none') AS skipped_groups, 'none' AS errored_groups
          FROM res LEFT JOIN pagg ON pagg.{U} = res.{U} AND pagg.month = res.month)
"""


ORACLE["enforcement_candidates"] = f1_base(_EC) + _enforce_ctes() + f"SELECT {U}, month, {usd('c')} AS cost_usd FROM cand"
ORACLE["group_targets"] = f1_base(_EC) + _enforce_ctes() + "SELECT ord, label, group_id FROM targets"
ORACLE["enforcement_decisions"] = f1_base(_EC) + _enforce_ctes() + "SELECT * FROM decs"

_HIST = f""",
 pinv AS (SELECT *, {sql_cost('model_id', list(TOK))} AS cost, time_bucket(INTERVAL '5 minutes', ts) AS run FROM inv),
 rd AS (SELECT {U}, month, run, sum(cost) AS delta FROM pinv GROUP BY {U}, month, run),
 rba AS (SELECT *, sum(delta) OVER (PARTITION BY {U}, month ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS new_cost
         FROM rd),
 hist AS (SELECT rba.{U}, rba.month, rba.run AS at_ts, decs.mode, decs.user_id,
                 decs.reason IS NULL AND decs.mode <> 'SKIPPED' AS notifiable
          FROM rba JOIN decs ON rba.{U} = decs.{U} AND rba.month = decs.month
          WHERE rba.delta > 0 AND rba.new_cost >= CAST({_EC.budget_usd} AS DECIMAL(38,12)))
"""
ORACLE["enforcement_throttle"] = f1_base(_EC) + _enforce_ctes() + _HIST + f""",
 l AS (SELECT *, lag(mode) OVER w AS prev_mode, lag(at_ts) OVER w AS prev_at FROM hist
       WINDOW w AS (PARTITION BY {U}, month ORDER BY at_ts))
SELECT {U}, month, {ts_text('at_ts')} AS "at", mode,
       CASE WHEN mode = 'REMOVED' THEN notifiable
            WHEN mode IN ('DRYRUN', 'ERROR') THEN notifiable AND NOT coalesce(prev_mode = mode AND
                 epoch(at_ts) - epoch(prev_at) < {int(_EC.renotify_hours) * 3600}, FALSE)
            ELSE FALSE END AS notify
FROM l"""
ORACLE["enforcement_audit"] = f1_base(_EC) + _enforce_ctes() + _HIST + f"""
SELECT {U}, month, any_value(mode) AS mode, {ts_text('max(at_ts)')} AS "at",
       {ts_text(f'max(at_ts) + INTERVAL {int(_EC.audit_ttl_days)} DAY')} AS expire_at, any_value(user_id) AS user_id
FROM hist GROUP BY {U}, month"""

ORACLE["enforcement_notices"] = f1_base(_EC) + _enforce_ctes() + _HIST + f""",
 l AS (SELECT *, lag(mode) OVER w AS prev_mode, lag(at_ts) OVER w AS prev_at FROM hist
       WINDOW w AS (PARTITION BY {U}, month ORDER BY at_ts)),
 n AS (SELECT l.*, d.dryrun_groups, d.removed_groups, d.errored_groups FROM l
       JOIN decs d ON d.{U} = l.{U} AND d.month = l.month
       WHERE CASE WHEN l.mode = 'REMOVED' THEN l.notifiable
                  WHEN l.mode IN ('DRYRUN', 'ERROR') THEN l.notifiable AND NOT coalesce(l.prev_mode = l.mode AND
                       epoch(l.at_ts) - epoch(l.prev_at) < {int(_EC.renotify_hours) * 3600}, FALSE)
                  ELSE FALSE END)
SELECT {U}, month, {ts_text('at_ts')} AS "at", mode AS level,
       substr(CASE mode WHEN 'REMOVED' THEN '[{_EC.alert_label} ENFORCE] Removed ' || {U} || ' from group(s) ('
                        WHEN 'DRYRUN' THEN '[{_EC.alert_label} ENFORCE dry-run] WOULD remove ' || {U} || ' ('
                        ELSE '[{_EC.alert_label} ENFORCE error] Failed enforcing ' || {U} || ' (' END || month || ')', 1, 100) AS subject,
       'This user has spent the month''s budget and was checked.' || chr(10) || chr(10) ||
       '  User          : ' || {U} || chr(10) ||
       '  User ID       : ' || coalesce(user_id, '') || chr(10) ||
       '  Month         : ' || month || chr(10) ||
       CASE mode WHEN 'REMOVED' THEN '  Action        : REMOVED from group membership(s)' || chr(10) || '  Groups        : ' || removed_groups || chr(10) ||
                      chr(10) || 'To undo it, put the user back into these groups.' || chr(10)
                 WHEN 'DRYRUN' THEN '  Action        : DRY-RUN (no change made)' || chr(10) || '  Would remove  : ' || dryrun_groups || chr(10) ||
                      chr(10) || 'Memberships stay as they are in dry-run mode.' || chr(10)
                 ELSE '  Action        : ERROR (enforcement failed)' || chr(10) || '  Failed groups : ' || errored_groups || chr(10) ||
                      chr(10) || 'The next run tries again.' || chr(10) END AS body
FROM n"""
ORACLE["enforcement_per_window"] = "WITH RECURSIVE" + f1_base(_EC).lstrip().removeprefix("WITH") + _enforce_ctes() + _HIST + f""",
 o AS (SELECT *, row_number() OVER (PARTITION BY {U}, month ORDER BY at_ts, mode) AS i FROM hist),
 walk AS (
  SELECT {U}, month, at_ts, mode, i, notifiable AND mode IN ('REMOVED', 'DRYRUN', 'ERROR') AS notify,
         CASE WHEN notifiable AND mode IN ('REMOVED', 'DRYRUN', 'ERROR') THEN at_ts END AS last_at,
         CASE WHEN notifiable AND mode IN ('REMOVED', 'DRYRUN', 'ERROR') THEN mode END AS last_mode FROM o WHERE i = 1
  UNION ALL
  SELECT {U}, month, at_ts, mode, i, send, CASE WHEN send THEN at_ts ELSE last_at END, CASE WHEN send THEN mode ELSE last_mode END
  FROM (SELECT o.*, w.last_at, w.last_mode, o.notifiable AND (o.mode = 'REMOVED' OR (o.mode IN ('DRYRUN', 'ERROR') AND NOT coalesce(
               w.last_mode = o.mode AND epoch(o.at_ts) - epoch(w.last_at) < {int(_EC.renotify_hours) * 3600}, FALSE))) AS send
        FROM walk w JOIN o ON o.{U} = w.{U} AND o.month = w.month AND o.i = w.i + 1))
SELECT {U}, month, {ts_text('at_ts')} AS "at", mode, notify FROM walk"""
ORACLE["enforcement_run"] = f1_base(_EC) + _enforce_ctes(fx.REMOVE_CFG) + (
    f"SELECT {U}, month, mode, user_id, reason, removed_groups, skipped_groups FROM decs")

# ---------------------------------------------------------------- sinks: rows that no batch boundary changes
_CSV = "month, cost_usd, pct_display, status, total_tokens, input_tokens, output_tokens, invocations"
ORACLE["csv_export"] = f"SELECT {U}, {_CSV} FROM ({ORACLE['user_spend_table']})"
ORACLE["alerts_sink"] = f"""
SELECT level, {U}, month, CAST(boundary AS DOUBLE) AS boundary_usd,
       substr('[Spend ' || level || '] ' || {U} || ' crossed $' || format('{{:.2f}}', CAST(boundary AS DOUBLE)) ||
              ' spend (' || month || ')', 1, 100) AS subject
FROM ({f1_base()} SELECT {U}, month, sum(cost) AS c FROM priced GROUP BY {U}, month)
JOIN (VALUES ('WARN', {fx.F1_CFG.budget_usd} * {fx.F1_CFG.warn_ratio}), ('BREACH', {fx.F1_CFG.budget_usd})) v(level, boundary)
  ON c >= boundary"""
ORACLE["stream_spend_alerts"] = ORACLE["alerts_sink"]
ORACLE["notice_outbox"] = f"""
SELECT 'spend' AS kind, level, {U}, month, subject FROM ({ORACLE["alerts_sink"]})
UNION ALL SELECT 'token', level, {U}, month, subject FROM ({ORACLE["stream_token_alerts"]})
UNION ALL SELECT 'usage', 'USAGE', {U}, month, subject FROM ({ORACLE["usage_notice"]})"""
