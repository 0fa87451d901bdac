"""SQL twins of the registered queries, for DuckDB.

``CTES`` holds the shared building blocks; ``ORACLES`` maps a query key to the
final SELECT.  :func:`oracle_sql` prepends the blocks a query needs.
"""

from __future__ import annotations

import re

from tidepanel.functions import probability as pr
from tidepanel.functions import text as tx
from tidepanel.operators.universe import FALLBACK_DATE, FALLBACK_SYMBOLS
from tidepanel.sources.dimensions import TAX_REGIMES

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}

BY = "PARTITION BY ticker ORDER BY d"
BYS = "PARTITION BY ticker, strategy ORDER BY d"
SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def pick(source: str, *columns: str) -> str:
    """SELECT list; ``~name`` rounds to six digits, ``~2:name`` to two, and
    ``name=expr`` (also after ``~``) computes."""
    out = []
    for c in columns:
        digits = None
        if c.startswith("~"):
            m = re.match(r"~(?:(\d+):)?", c)
            digits, c = int(m.group(1) or 6), c[m.end():]
        name, _, expr = c.partition("=")
        expr = expr or name
        out.append(f"round({expr}, {digits}) + 0.0 AS {name}" if digits is not None else f"{expr} AS {name}")
    return f"SELECT {', '.join(out)} FROM {source}"


# --- panels -------------------------------------------------------------------------

MICRO = "CAST(round(ln(l_extendedprice) * 1000000) AS BIGINT)"
CTES["trade"] = """SELECT o_orderpriority AS ticker, CAST(l_shipdate AS DATE) AS d, l_extendedprice, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice > 0"""


def _bars(source: str, keys: str) -> tuple[str, str, str]:
    days = (f"SELECT {keys}, d, CAST(round(s / n) AS BIGINT) AS cx, hx, lx, volume FROM (SELECT {keys}, d, "
            f"sum({MICRO}) AS s, count(*) AS n, max({MICRO}) AS hx, min({MICRO}) AS lx, sum(l_quantity) AS volume "
            f"FROM {source} GROUP BY {keys}, d)")
    damp = lambda c: f"round(exp(sum({c}) OVER f / count({c}) OVER f / 1000000), 4)"
    damped = (f"SELECT {keys}, d, {damp('cx')} AS close, {damp('hx')} AS high, {damp('lx')} AS low, volume FROM @days "
              f"WINDOW f AS (PARTITION BY {keys} ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
    final = (f"SELECT {keys}, d, coalesce(lag(close) OVER (PARTITION BY {keys} ORDER BY d), close) AS open, high, low, "
             f"close, volume FROM @damped")
    return days, damped, final


d1, d2, d3 = _bars("trade", "ticker")
CTES["bar_days"], CTES["bar_damped"], CTES["bar"] = d1, d2.replace("@days", "bar_days"), d3.replace("@damped", "bar_damped")
CTES["supplier_trade"] = """SELECT l_returnflag AS regime, l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d, l_extendedprice, l_quantity
  FROM lineitem WHERE l_extendedprice > 0"""
d1, d2, d3 = _bars("supplier_trade", "regime, ticker")
CTES["many_days"], CTES["many_damped"], CTES["many"] = d1, d2.replace("@days", "many_days"), d3.replace("@damped", "many_damped")
CTES["ret_all"] = f"SELECT *, close / lag(close) OVER ({BY}) - 1 AS r, ln(close / lag(close) OVER ({BY})) AS log_r FROM bar"
CTES["ret"] = "SELECT * FROM ret_all WHERE r IS NOT NULL"
CTES["mkt"] = "SELECT d, avg(r) AS market_r FROM ret GROUP BY d"
CTES["div"] = f"""SELECT ticker, d, round(close * 0.005, 4) AS per_share FROM (SELECT *, date_trunc('quarter', d) AS q,
  lag(date_trunc('quarter', d)) OVER ({BY}) AS p FROM bar) WHERE p IS NULL OR p <> q"""
CTES["second"] = """SELECT ticker, d, CASE WHEN date_diff('day', DATE '1995-01-01', d) % 50 = 0 THEN close * 1.03e0 ELSE close END AS close FROM bar"""
CTES["cpi"] = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 100, 4) AS level FROM orders GROUP BY 1"""
CTES["occurrence"] = """SELECT o_orderkey AS event_id, o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS event_date,
  o_orderstatus AS category FROM orders"""
CTES["ratios"] = """SELECT DISTINCT ticker, v.valid_from, v.ratio FROM bar, (VALUES (DATE '1990-01-01', 1e0), (DATE '1998-01-01', 10e0)) v(valid_from, ratio)"""
CTES["pair"] = """SELECT ticker, d, close AS adr, 1450e0 + dayofyear(d) AS true_rate,
  close * (1450e0 + dayofyear(d)) / CASE WHEN d < DATE '1998-01-01' THEN 1e0 ELSE 10e0 END AS local_raw,
  close * (1450e0 + dayofyear(d)) / 10e0 AS local_adj, 1000e0 + dayofyear(d) AS official_rate FROM bar"""
CTES["rate"] = "SELECT ticker, d, local_adj * 10e0 / adr AS rate FROM pair"

# --- sources -----------------------------------------------------------------------

ORACLES["load_bars"] = pick("bar", "ticker", "d", "~open", "~high", "~low", "~close", "~volume")
ORACLES["load_prices_dividends"] = (pick("bar", "ticker", "d", "kind='PRICE'", "~value=close") + " UNION ALL "
                                    + pick("div", "ticker", "d", "kind='DIVIDEND'", "~value=per_share"))
ORACLES["load_secondary_close"] = pick("second", "ticker", "d", "~close")
_symbols = [*tx.SECONDARY_SYMBOLS, "YPFD.BA", "UNKNOWN"]
_list = "[" + ", ".join(f"'{s}'" for s in _symbols) + "]"
_map = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.SECONDARY_SYMBOLS.items())
ORACLES["map_symbols"] = (f"SELECT c_custkey, ticker, CASE ticker {_map} END AS secondary FROM (SELECT c_custkey, "
                          f"({_list})[CAST(c_custkey % {len(_symbols)} + 1 AS INTEGER)] AS ticker FROM customer)")
ORACLES["load_monthly_index"] = pick("cpi", "month", "~level")
ORACLES["load_filings"] = """SELECT CAST(o_orderdate AS DATE) AS event_date, o_orderpriority AS ticker,
  CASE WHEN f.form = '8-K' AND o_orderstatus = 'F' THEN 'resultados_trimestrales' WHEN f.form = '8-K' AND o_orderstatus = 'O' THEN 'financiamiento'
       ELSE 'hecho_relevante' END AS category,
  trim(f.form || ' ' || CASE WHEN f.form = '6-K' THEN '' WHEN o_orderstatus = 'F' THEN 'Earnings results' WHEN o_orderstatus = 'O' THEN 'tender offer update' ELSE '' END) AS label,
  'SEC EDGAR' AS source,
  'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/000' || f.i || o_orderkey || '/' || f.doc AS url, f.form AS raw_form
  FROM orders, (VALUES ('8-K', 0, 'a.htm'), ('6-K', 2, 'c.htm')) f(form, i, doc) WHERE o_orderdate >= TIMESTAMP '1996-01-01'"""
ORACLES["resolve_issuer_ids"] = """SELECT 'S' || c_custkey || '.ba' AS ticker, 'S' || c_custkey AS symbol,
  CASE WHEN s_suppkey IS NOT NULL THEN s_suppkey + 1000 END AS cik FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"""
ORACLES["load_manual_events"] = """SELECT CAST(o_orderdate AS DATE) AS event_date, o_orderpriority AS ticker, o_orderstatus AS category,
  'order ' || o_orderkey AS label, CASE WHEN o_orderstatus = 'F' THEN 'register' ELSE 'curated' END AS source,
  'https://example.org/' || o_orderkey AS url FROM orders WHERE o_orderstatus <> 'P'"""
ORACLES["manual_event_rejects"] = "SELECT o_orderpriority AS ticker, 'order ' || o_orderkey AS label, 'url' AS missing FROM orders WHERE o_orderstatus = 'P'"
CTES["caps"] = "SELECT translate(substr(s_name, 10, 9), '0123456789', 'ABCDEFGHIJ') AS symbol, s_suppkey AS position, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS cap FROM supplier"
ORACLES["load_holdings"] = "SELECT symbol, position FROM caps"
ORACLES["cost_model_dim"] = """SELECT market, ticker, round(commission, 6) + 0.0 AS commission, round(fees, 6) + 0.0 AS market_fees, round(slip, 6) + 0.0 AS slippage,
  round(commission + fees + slip, 6) + 0.0 AS one_way FROM (SELECT s_name || CASE WHEN s_nationkey < 5 THEN '.BA' ELSE '' END AS ticker,
  CASE WHEN s_nationkey < 5 THEN 'BYMA' ELSE 'US' END AS market FROM supplier) JOIN (VALUES ('US', 0e0, 0e0, 0.0005e0), ('BYMA', 0.005e0, 0.0008e0, 0.002e0))
  m(market, commission, fees, slip) USING (market)"""

# --- projections and gates ---------------------------------------------------------

ORACLES["log_returns"] = pick("ret", "ticker", "d", "~log_r")
ORACLES["simple_returns"] = pick("ret_all", "ticker", "d", "~r=coalesce(r, 0)")
ORACLES["drop_null_prices"] = pick(f"(SELECT *, coalesce(close / lag(close) OVER ({BY}) - 1, 0) AS r FROM bar WHERE volume >= 100)", "ticker", "d", "~close", "~r")
ORACLES["min_history_gate"] = "SELECT regime, ticker, count(*) AS n_rows, count(*) >= 260 AS accepted FROM many GROUP BY regime, ticker"
ORACLES["warmup_window"] = """SELECT l_suppkey AS ticker, CAST(min(l_shipdate) AS DATE) AS first_d, CAST(max(l_shipdate) AS DATE) AS last_d, count(*) AS n_rows,
  round(sum(l_quantity), 6) + 0.0 AS volume FROM lineitem WHERE l_shipdate >= DATE '2000-06-30' - 1278 AND l_shipdate < DATE '2000-06-30' GROUP BY 1"""
CTES["vol"] = """SELECT *, CASE WHEN count(r) OVER f >= 31 THEN stddev_samp(r) OVER f * sqrt(252) END AS vol FROM ret_all
  WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"""
ORACLES["clip_weight"] = pick("vol", "ticker", "d", "~clipped=CASE WHEN vol > 0 THEN greatest(least(least(0.5e0 / vol, 1e0), 0.9e0), 0.3e0) END")
ORACLES["to_usd"] = pick("pair JOIN rate USING (ticker, d)", "ticker", "d", "~close=local_adj / rate")
ORACLES["ohlcv_to_usd"] = pick("bar JOIN rate USING (ticker, d)", "ticker", "d", *[f"~10:{c}={c} / rate" for c in ("open", "high", "low", "close")], "~volume")

# --- joins ------------------------------------------------------------------------------

CTES["other"] = "SELECT ticker, d, close AS other FROM bar WHERE volume >= 120"
ORACLES["align_inner"] = pick("bar JOIN other USING (ticker, d) WHERE ticker IN (SELECT ticker FROM other GROUP BY ticker HAVING count(*) >= 20)", "ticker", "d", "~close", "~other")
CTES["thin_ret"] = f"SELECT ticker, d, close / lag(close) OVER ({BY}) - 1 AS r FROM bar WHERE volume >= 120"
CTES["thin_mkt"] = "SELECT d, avg(r) AS market_r FROM thin_ret GROUP BY d HAVING avg(r) IS NOT NULL"
ORACLES["align_left"] = pick("ret LEFT JOIN thin_mkt USING (d)", "ticker", "d", "~r", "~market_r")
ORACLES["ratio_asof"] = pick("bar ASOF LEFT JOIN ratios ON bar.ticker = ratios.ticker AND bar.d >= ratios.valid_from", "ticker=bar.ticker", "d", "~ratio")
ORACLES["ratio_latest"] = pick("pair", "ticker", "d", "~rate=local_adj * (SELECT arg_max(ratio, valid_from) FROM ratios) / adr")
CTES["anchor"] = """SELECT e.ticker, e.event_date, b.d AS anchor_d FROM (SELECT DISTINCT ticker, event_date FROM occurrence) e
  ASOF LEFT JOIN bar b ON e.ticker = b.ticker AND e.event_date <= b.d"""
ORACLES["event_anchor"] = "SELECT ticker, event_date, anchor_d FROM anchor"
CTES["ret_mkt"] = f"SELECT ticker, d, r, market_r, row_number() OVER ({BY}) - 1 AS pos FROM ret LEFT JOIN mkt USING (d)"
CTES["anchor_ret"] = """SELECT e.ticker, e.event_date, b.d AS anchor_d, b.pos FROM (SELECT DISTINCT ticker, event_date FROM occurrence) e
  ASOF LEFT JOIN ret_mkt b ON e.ticker = b.ticker AND e.event_date <= b.d"""
CTES["model"] = """SELECT ticker, d, pos, r, market_r, CAST(n AS BIGINT) AS estimation_obs, CASE WHEN ok THEN a END AS alpha, CASE WHEN ok THEN b END AS beta,
  CASE WHEN ok THEN r2 END AS r_squared, CASE WHEN ok THEN sqrt(greatest(syy * (1 - r2), 0) / (n - 2)) END AS residual_sd FROM (SELECT *, n >= 100 AND pos >= 130 AS ok FROM (
  SELECT *, regr_count(r, market_r) OVER f AS n, regr_intercept(r, market_r) OVER f AS a, regr_slope(r, market_r) OVER f AS b, regr_r2(r, market_r) OVER f AS r2,
  regr_syy(r, market_r) OVER f AS syy FROM ret_mkt WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 280 PRECEDING AND 30 PRECEDING)))"""
ORACLES["event_windows"] = pick("""(SELECT DISTINCT ticker, anchor_d, pos AS p FROM anchor_ret WHERE anchor_d IS NOT NULL) x JOIN (SELECT ticker, pos AS p, alpha, beta FROM model WHERE alpha IS NOT NULL) m USING (ticker, p)
  JOIN ret_mkt w ON w.ticker = x.ticker AND w.pos BETWEEN x.p - 1 AND x.p + 3 AND w.market_r IS NOT NULL""",
                                "ticker=x.ticker", "anchor_d", "d=w.d", '"offset"=w.pos - x.p', "~abnormal_r=w.r - alpha - beta * w.market_r")
ORACLES["deflate"] = pick("bar JOIN cpi ON cpi.month = date_trunc('month', d)", "ticker", "d", "~real=close * ((SELECT arg_max(level, month) FROM cpi) / level)")
ORACLES["rebalance_snap"] = "SELECT ticker, max(d) AS d FROM (SELECT ticker, d, date_trunc('week', d + 2) AS w FROM bar) GROUP BY ticker, w"
CTES["held_shares"] = f"""SELECT ticker, d, last_value(s IGNORE NULLS) OVER ({BY} {SO_FAR}) AS shares FROM (SELECT ticker, d, CASE WHEN y <> prev AND y = 1996 THEN 100e0
  WHEN y <> prev AND y = 1998 THEN 150e0 END AS s FROM (SELECT ticker, d, year(d) AS y, lag(year(d)) OVER ({BY}) AS prev FROM bar))"""
ORACLES["dividend_cashflows"] = pick("held_shares JOIN div USING (ticker, d) WHERE shares > 0", "ticker", "d", "~shares", "~per_share", "~gross=shares * per_share")

LEDGER_ORDER = "d, order_id, line_no, part_id, amount, qty, kind"
CTES["account_trade"] = """SELECT l_suppkey AS account, CAST(l_shipdate AS DATE) AS d, l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS kind, l_quantity AS qty, l_extendedprice AS amount, round(l_extendedprice / l_quantity, 8) AS price FROM lineitem"""
CTES["account_sums"] = f"""SELECT *, row_number() OVER w AS seq, sum(CASE WHEN kind = 'BUY' THEN qty ELSE 0 END) OVER w AS bought,
  sum(CASE WHEN kind = 'SELL' THEN qty ELSE 0 END) OVER w AS sold FROM account_trade WINDOW w AS (PARTITION BY account ORDER BY {LEDGER_ORDER} {SO_FAR})"""
CTES["cover"] = f"""SELECT *, CASE WHEN kind = 'BUY' THEN bought - qty ELSE sold - qty - short0 END AS lo, CASE WHEN kind = 'BUY' THEN bought ELSE sold - short1 END AS hi,
  CASE WHEN kind = 'BUY' THEN 0 ELSE short1 - short0 END AS uncovered FROM (SELECT *, greatest(short0, sold - bought) AS short1 FROM (SELECT *,
  greatest(0, coalesce(max(sold - bought) OVER (PARTITION BY account ORDER BY seq {BEFORE}), 0)) AS short0 FROM account_sums))"""
# The walk along the quantity line: at every place where a lot or a sale begins, both that are open then.
CTES["fifo_walk"] = f"""SELECT account, lo AS place, lead(lo) OVER o AS next_place,
  last_value(CASE WHEN kind = 'BUY' THEN {{'seq': seq, 'price': price, 'd': d, 'hi': hi}} END IGNORE NULLS) OVER (o {SO_FAR}) AS lot,
  last_value(CASE WHEN kind = 'SELL' THEN {{'seq': seq, 'hi': hi}} END IGNORE NULLS) OVER (o {SO_FAR}) AS sale
  FROM cover WHERE hi > lo WINDOW o AS (PARTITION BY account ORDER BY lo)"""
CTES["fifo"] = """SELECT account, sale.seq AS sale_seq, lot.seq AS lot_seq, sum(least(coalesce(next_place, lot.hi), lot.hi, sale.hi) - place) AS matched_qty, first(lot.price) AS lot_price, first(lot.d) AS lot_d
  FROM fifo_walk WHERE lot IS NOT NULL AND sale IS NOT NULL AND least(coalesce(next_place, lot.hi), lot.hi, sale.hi) - place > 1e-9 GROUP BY ALL"""
ORACLES["fifo_match"] = pick("fifo", "account", "sale_seq", "lot_seq", "~matched_qty", "~8:lot_price", "lot_d")

# --- signals and backtest ------------------------------------------------------------


def signal_cte(source: str, keys: str) -> str:
    w = f"PARTITION BY {keys} ORDER BY d"
    return f"""SELECT *, CASE WHEN momentum IS NULL OR trend IS NULL OR near_high IS NULL THEN NULL ELSE (CAST(momentum > 0 AS INTEGER) + trend + CAST(near_high >= 0.75e0 AS INTEGER)) / 3e0 END AS score,
  CASE WHEN momentum IS NULL OR trend IS NULL OR near_high IS NULL THEN NULL ELSE CAST(CAST(momentum > 0 AS INTEGER) + trend + CAST(near_high >= 0.75e0 AS INTEGER) >= 2 AS DOUBLE) END AS flag FROM (
  SELECT *, lag(close, 21) OVER ({w}) / lag(close, 273) OVER ({w}) - 1 AS momentum,
  CASE WHEN count(*) OVER sma >= 200 THEN CAST(close > avg(close) OVER sma AS DOUBLE) END AS trend,
  CASE WHEN count(*) OVER hi >= 126 THEN close / max(close) OVER hi END AS near_high FROM {source}
  WINDOW sma AS ({w} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), hi AS ({w} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))"""


def reversion_cte(source: str, keys: str, frame: str = SO_FAR) -> str:
    """The latch as counting: the state is the last forced value plus later flips."""
    w = f"PARTITION BY {keys} ORDER BY d"
    return f"""SELECT *, CASE WHEN low_so_far IS NOT NULL THEN CAST((coalesce(last_value(forced IGNORE NULLS) OVER ({w} {SO_FAR}), 0)
  + flips - coalesce(last_value(CASE WHEN forced IS NOT NULL THEN flips END IGNORE NULLS) OVER ({w} {SO_FAR}), 0)) % 2 AS DOUBLE) END AS position FROM (
  SELECT *, CASE WHEN buy AND NOT sell THEN 1 WHEN sell AND NOT buy THEN 0 END AS forced, sum(CASE WHEN buy AND sell THEN 1 ELSE 0 END) OVER ({w} {SO_FAR}) AS flips FROM (
  SELECT *, close / low_so_far - 1 <= 0.1e0 AS buy, close / high_so_far >= 0.95e0 AS sell FROM (
  SELECT *, CASE WHEN count(*) OVER e >= 252 THEN min(close) OVER e END AS low_so_far, CASE WHEN count(*) OVER e >= 252 THEN max(close) OVER e END AS high_so_far
  FROM {source} WINDOW e AS ({w} {frame}))))"""


def backtest_ctes(prefix: str, grid: str, keys: str, weight: str = "", cost: str = "0.0005e0") -> None:
    """Adds ``<prefix>`` (daily panel), ``<prefix>_dd`` and ``<prefix>_sum``."""
    w = f"PARTITION BY {keys} ORDER BY d"
    target = f"greatest(least(flag * {weight}, 1e0), 0e0) + 0 * {weight} + 0 * flag" if weight else "flag"
    CTES[prefix] = f"""SELECT *, executed * asset_r AS gross, abs(executed - coalesce(lag(executed) OVER ({w}), 0)) AS turnover,
  abs(executed - coalesce(lag(executed) OVER ({w}), 0)) * {cost} AS cost,
  executed * asset_r - abs(executed - coalesce(lag(executed) OVER ({w}), 0)) * {cost} AS net FROM (
  SELECT *, coalesce(lag(held) OVER ({w}), 0) AS executed FROM (
  SELECT *, last_value(CASE WHEN is_rebalance THEN {target} END IGNORE NULLS) OVER ({w} {SO_FAR}) AS held FROM (
  SELECT *, coalesce(close / lag(close) OVER ({w}) - 1, 0) AS asset_r, coalesce(lead(date_trunc('week', d + 2)) OVER ({w}) <> date_trunc('week', d + 2), true) AS is_rebalance FROM {grid})))"""
    CTES[f"{prefix}_eq"] = f"""SELECT *, exp(sum(ln(1 + net)) OVER ({w} {SO_FAR})) AS equity, exp(sum(ln(1 + asset_r)) OVER ({w} {SO_FAR})) AS bench_equity FROM {prefix}"""
    CTES[f"{prefix}_dd"] = f"""SELECT *, round(equity / max(equity) OVER ({w} {SO_FAR}) - 1, 10) AS drawdown, bench_equity / max(bench_equity) OVER ({w} {SO_FAR}) - 1 AS bench_drawdown,
  last_value(top_d IGNORE NULLS) OVER ({w} {SO_FAR}) AS peak_d FROM (SELECT *, CASE WHEN equity > coalesce(max(equity) OVER ({w} {BEFORE}) * (1 + 1e-11), 0) THEN d END AS top_d FROM {prefix}_eq)"""
    CTES[f"{prefix}_sum"] = f"""SELECT *, final - 1 AS net_return, power(final, 1 / years) - 1 AS cagr, bench_final - 1 AS benchmark_return, power(bench_final, 1 / years) - 1 AS benchmark_cagr FROM (
  SELECT {keys}, count(*) AS n_rows, min(d) AS first_d, max(d) AS last_d, date_diff('day', min(d), max(d)) / 365.25e0 AS years, count(*) FILTER (turnover > 1e-9) AS trades, sum(cost) AS total_costs,
  exp(sum(ln(1 + gross))) - 1 AS gross_return, arg_max(equity, d) AS final, arg_max(bench_equity, d) AS bench_final, stddev_samp(net) * sqrt(252) AS volatility,
  CASE WHEN max(net) > min(net) THEN avg(net) / stddev_samp(net) * sqrt(252) END AS sharpe, min(drawdown) AS max_drawdown,
  first(peak_d ORDER BY drawdown, d) AS drawdown_peak, first(d ORDER BY drawdown, d) AS drawdown_trough, avg(CAST(executed > 0 AS DOUBLE)) AS time_in_market, min(bench_drawdown) AS benchmark_max_drawdown
  FROM {prefix}_dd GROUP BY {keys})"""


CTES["sig"] = signal_cte("bar", "ticker")
CTES["mr"] = reversion_cte("bar", "ticker")
CTES["grid"] = """SELECT ticker, d, close, 'momentum_trend' AS strategy, flag FROM sig UNION ALL SELECT ticker, d, close, 'mean_reversion', position FROM mr
  UNION ALL SELECT ticker, d, close, 'buy_and_hold', 1e0 FROM bar"""
backtest_ctes("bt", "grid", "ticker, strategy")
CTES["many_sig"] = signal_cte("many", "regime, ticker")
CTES["many_mr"] = reversion_cte("many", "regime, ticker")
CTES["many_grid"] = """SELECT regime, ticker, d, close, 'momentum_trend' AS strategy, flag FROM many_sig UNION ALL SELECT regime, ticker, d, close, 'mean_reversion', position FROM many_mr
  UNION ALL SELECT regime, ticker, d, close, 'buy_and_hold', 1e0 FROM many"""
backtest_ctes("many_bt", "many_grid", "regime, ticker, strategy")

ORACLES["strategy_grid"] = pick("grid", "ticker", "d", "strategy", "~flag")
ORACLES["vs_buy_and_hold"] = pick("bt_sum a JOIN bt_sum p ON a.ticker = p.ticker AND p.strategy = 'buy_and_hold' WHERE a.strategy <> 'buy_and_hold'",
                                  "ticker=a.ticker", "strategy=a.strategy", *[f"~{c}_diff=a.{c} - p.{c}" for c in ("net_return", "cagr", "sharpe", "max_drawdown")],
                                  "beats_passive=a.net_return > p.net_return")
SUMMARY = ("ticker", "strategy", "n_rows", "first_d", "last_d", "trades", "~total_costs", "~gross_return", "~volatility", "~sharpe", "~max_drawdown", "drawdown_peak",
           "drawdown_trough", "~time_in_market", "~benchmark_max_drawdown", "~net_return", "~cagr", "~benchmark_return", "~benchmark_cagr")
ORACLES["strategy_summary"] = pick("bt_sum", *SUMMARY)
ORACLES["momentum_trend"] = pick("bt_sum WHERE strategy = 'momentum_trend'", "ticker", "trades", "~total_costs", "~net_return", "~sharpe", "~max_drawdown")
ORACLES["buy_and_hold"] = pick("bt_sum WHERE strategy = 'buy_and_hold'", "ticker", "trades", "~net_return", "~benchmark_return", "~sharpe", "~max_drawdown")
ORACLES["write_results"] = pick("bt_sum", "ticker", "strategy", "trades", "~net_return", "~sharpe")
ORACLES["hold_between_rebalances"] = pick("bt", "ticker", "strategy", "d", "~held")
ORACLES["delayed_execution"] = pick("bt", "ticker", "strategy", "d", "~executed")
ORACLES["turnover_costs"] = pick("bt", "ticker", "strategy", "d", "~turnover", "~cost")
ORACLES["equity_curve"] = pick("bt_eq", "ticker", "strategy", "d", "~net", "~equity")
ORACLES["union_oos"] = pick(f"(SELECT *, row_number() OVER ({BYS}) AS pos FROM bt) WHERE pos > 252", "ticker", "strategy", "d", "~net")
ORACLES["strategy_catalog"] = "SELECT strategy, count(flag) AS defined_rows, CAST(sum(flag) AS BIGINT) AS invested_rows, 3 AS n_trials FROM grid GROUP BY strategy"
CTES["plug_grid"] = f"""SELECT ticker, d, close, 'above_50' AS strategy, CASE WHEN count(*) OVER f >= 50 THEN CAST(close > avg(close) OVER f AS DOUBLE) END AS flag FROM bar
  WINDOW f AS ({BY} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"""
backtest_ctes("plug", "plug_grid", "ticker, strategy")
ORACLES["strategy_plugin"] = pick("plug_sum", "ticker", "strategy", "trades", "~net_return", "~time_in_market")
ORACLES["regime_win_rates"] = """SELECT regime, strategy_a, strategy_b, round(avg(win), 6) + 0.0 AS win_rate FROM (SELECT a.regime, a.strategy AS strategy_a, b.strategy AS strategy_b,
  CAST(a.net_return > b.net_return AS DOUBLE) AS win FROM many_bt_sum a JOIN many_bt_sum b USING (regime, ticker) WHERE (a.strategy, b.strategy) IN
  (('momentum_trend', 'mean_reversion'), ('momentum_trend', 'buy_and_hold'), ('mean_reversion', 'buy_and_hold'))) GROUP BY ALL"""
ORACLES["regime_medians"] = pick("many_bt_sum GROUP BY regime, strategy", "regime", "strategy", "n_series=count(*)", "~never_traded=avg(CAST(time_in_market = 0 AS DOUBLE))",
                                 *[f"~median_{c}=quantile_cont(CAST({c} AS DOUBLE), 0.5)" for c in ("net_return", "sharpe", "max_drawdown", "trades")])
ORACLES["best_strategy"] = """SELECT ticker, s.strategy AS best_strategy, round(s.sharpe, 6) + 0.0 AS best_sharpe, n.strategy AS best_by_return, round(n.net_return, 6) + 0.0 AS best_net_return
  FROM (SELECT * FROM bt_sum WHERE sharpe IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY sharpe DESC, strategy) = 1) s
  JOIN (SELECT * FROM bt_sum QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY net_return DESC, strategy) = 1) n USING (ticker)"""

# Market costs, volatility weights and the stop together.
ALPHA = "1e0 / 14"
CTES["tr"] = f"SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM (SELECT *, lag(close) OVER ({BY}) AS prev FROM bar)"
CTES["atr"] = f"""SELECT *, CASE WHEN count(*) OVER ({BY} {SO_FAR}) >= 14 THEN list_reduce(list(tr) OVER ({BY} ROWS BETWEEN 600 PRECEDING AND CURRENT ROW), lambda y, x: y * 13e0 / 14 + x / 14) END AS atr FROM tr"""


def stop_cte(source: str) -> str:
    return f"""SELECT *, CASE WHEN flag IS NULL THEN NULL WHEN flag > 0 AND stopped = 0 THEN 1e0 ELSE 0e0 END AS position FROM (
  SELECT *, max(CASE WHEN flag > 0 AND close < peak - 3 * atr THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, episode ORDER BY d {SO_FAR}) AS stopped FROM (
  SELECT *, max(CASE WHEN flag > 0 THEN close END) OVER (PARTITION BY ticker, episode ORDER BY d {SO_FAR}) AS peak FROM (
  SELECT *, sum(CASE WHEN flag <= 0 THEN 1 ELSE 0 END) OVER ({BY} {SO_FAR}) AS episode FROM {source})))"""


CTES["stop_in"] = "SELECT ticker, d, close, atr, flag FROM atr JOIN (SELECT ticker, d, flag FROM sig) USING (ticker, d)"
CTES["stop"] = stop_cte("stop_in")
CTES["always_in"] = "SELECT ticker, d, close, atr, 1e0 AS flag FROM atr"
CTES["always"] = stop_cte("always_in")
ORACLES["atr"] = pick("atr", "ticker", "d", "~4:atr")
ORACLES["atr_stop"] = pick("always", "ticker", "d", "~position")
ORACLES["stop_loss"] = pick("stop", "ticker", "d", "~flag", "~position")
CTES["weighted"] = "SELECT ticker, d, CASE WHEN vol > 0 THEN least(0.15e0 / vol, 1e0) END AS weight FROM vol"
CTES["sized_grid"] = "SELECT s.ticker, s.d, s.close, s.position AS flag, weight FROM stop s JOIN weighted USING (ticker, d)"
backtest_ctes("sized", "sized_grid", "ticker", weight="weight")
ORACLES["backtest"] = pick("sized_eq", "ticker", "d", "~executed", "~turnover", "~cost", "~gross", "~net", "~equity")

# --- Sharpe family -------------------------------------------------------------------------

CTES["mom"] = """SELECT *, sr * sqrt(252) AS sharpe_annual FROM (SELECT ticker, strategy, count(net) AS observations, CASE WHEN max(net) > min(net) THEN avg(net) / stddev_samp(net) END AS sr,
  CASE WHEN max(net) > min(net) THEN skewness(net) END AS skew, CASE WHEN max(net) > min(net) THEN kurtosis(net) + 3 END AS kurt FROM bt GROUP BY ticker, strategy)"""
G = 0.5772156649015329


def expected_max(n: str, var: str) -> str:
    p1, p2 = f"(1e0 - 1e0 / {n})", f"(1e0 - 1e0 / ({n} * exp(1e0)))"
    return (f"CASE WHEN {n} = 1 THEN 0e0 ELSE sqrt(greatest({var}, 1e-12)) * ((1e0 - {G}e0) * {pr.norm_ppf_sql(p1)} + {G}e0 * {pr.norm_ppf_sql(p2)}) END")


CTES["sharpe_max"] = f"SELECT *, {expected_max('3', '(1e0 / (observations - 1))')} AS expected_max_sharpe, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS spread FROM mom"
CTES["sharpe_z"] = """SELECT *, sr * sqrt(observations - 1) / sqrt(greatest(spread, 1e-12)) AS z0, (sr - expected_max_sharpe) * sqrt(observations - 1) / sqrt(greatest(spread, 1e-12)) AS z1,
  CASE WHEN sr IS NULL OR sr <= 0 THEN CAST('inf' AS DOUBLE) ELSE 1 + spread * power(1.6448536269514722e0 / sr, 2) END AS min_track_record FROM sharpe_max"""
CTES["assessed"] = f"""SELECT *, CASE WHEN observations < 252 THEN 'INSUFFICIENT_SAMPLE' WHEN deflated_sharpe >= 0.95 THEN 'SURVIVES_95' WHEN deflated_sharpe >= 0.9 THEN 'MODERATE_90' ELSE 'NO_EVIDENCE' END AS verdict
  FROM (SELECT *, {pr.norm_cdf_sql('z0')} AS psr, {pr.norm_cdf_sql('z1')} AS deflated_sharpe FROM sharpe_z)"""
ORACLES["sharpe"] = """SELECT ticker, strategy, round(sr * sqrt(252), 6) + 0.0 AS sharpe, round(CASE WHEN sr IS NOT NULL THEN (m - 0.03e0 / 252) / s * sqrt(252) END, 6) + 0.0 AS sharpe_over_3pct
  FROM mom JOIN (SELECT ticker, strategy, avg(net) AS m, stddev_samp(net) AS s FROM bt GROUP BY ALL) USING (ticker, strategy)"""
ORACLES["moments"] = pick("mom", "ticker", "strategy", "observations", "~skew", "~kurt")
ORACLES["psr"] = pick("assessed", "ticker", "strategy", "~psr")
ORACLES["expected_max_sharpe"] = pick("mom, (VALUES (1), (3), (10), (200)) t(trials)", "ticker", "strategy", "trials", f"~expected_max_sharpe={expected_max('trials', '(1e0 / (observations - 1))')}")
CTES["dsr_z"] = f"""SELECT ticker, strategy, (sr - {expected_max('3', 'coalesce(tv, 1e0 / (observations - 1))')}) * sqrt(observations - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS z
  FROM mom JOIN (SELECT ticker, var_samp(sr) AS tv FROM mom GROUP BY ticker) USING (ticker)"""
ORACLES["dsr"] = pick("dsr_z", "ticker", "strategy", f"~deflated_sharpe={pr.norm_cdf_sql('z')}")
ORACLES["min_trl"] = pick("assessed", "ticker", "strategy", "~0:min_track_record")
ORACLES["sharpe_assessment"] = pick("assessed", "ticker", "strategy", "observations", "~sharpe_annual", "~sharpe_row=sr", "~skew", "~kurt", "~psr", "~deflated_sharpe",
                                    "~expected_max_sharpe", "trials=3", "verdict")

# --- bootstrap ---------------------------------------------------------------------------------
# Draws: the Park-Miller sequence of each replicate, two terms per block.

_M, _A = 2 ** 31 - 1, 48271


def bootstrap_ctes(prefix: str, source: str, keys: str, r: str, name: str = "") -> None:
    label = "concat_ws('|', '42', " + keys + name + ", CAST(b AS VARCHAR))"
    powers = lambda step: "[" + ", ".join(str(pow(_A, step * i, _M)) for i in range(256)) + "]::BIGINT[]"
    u = lambda i: f"((seed * {prefix}_pow.fine[({i}) % 256 + 1] % {_M}) * {prefix}_pow.coarse[({i}) // 256 + 1] % {_M}) / {_M}e0"
    CTES[f"{prefix}_pow"] = f"SELECT {powers(1)} AS fine, {powers(256)} AS coarse"
    CTES[f"{prefix}_rows"] = (f"SELECT {keys}, row_number() OVER w AS pos, sum({r}) OVER w AS s1, sum({r} * {r}) OVER w AS s2, count(*) OVER (PARTITION BY {keys}) AS n "
                              f"FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY d {SO_FAR})")
    CTES[f"{prefix}_tot"] = f"SELECT {keys}, n, s1 AS t1, s2 AS t2 FROM {prefix}_rows WHERE pos = n"
    CTES[f"{prefix}_seed"] = (f"SELECT {keys}, n, t1, t2, b, CAST(least(n, ceil(n / 21e0 + 6 * sqrt(n / 21e0 * (1 - 1 / 21e0)) + 10)) AS BIGINT) AS most, "
                              f"CAST(('0x' || substr(md5({label}), 1, 12))::UBIGINT % {_M - 1} + 1 AS BIGINT) AS seed FROM {prefix}_tot, generate_series(1, 2000) g(b)")
    CTES[f"{prefix}_draw"] = (f"SELECT *, CAST(floor({u('2 * k')} * n) AS BIGINT) AS start, CASE WHEN k = most - 1 THEN n ELSE CAST(least(1 + floor(ln({u('2 * k + 1')}) / ln(1 - 1 / 21e0)), n) AS BIGINT) END AS len "
                              f"FROM (SELECT *, unnest(range(0, most)) AS k FROM {prefix}_seed), {prefix}_pow")
    CTES[f"{prefix}_block"] = (f"SELECT *, least(len, n - used) AS take FROM (SELECT {keys}, n, t1, t2, b, k, start, len, coalesce(sum(len) OVER (PARTITION BY {keys}, b ORDER BY k {BEFORE}), 0) AS used FROM {prefix}_draw) WHERE used < n")
    key_list = [k.strip() for k in keys.split(",")]
    on = lambda a: " AND ".join(f"{a}.{k} = x.{k}" for k in key_list)
    CTES[f"{prefix}_rep"] = f"""SELECT {', '.join('x.' + k for k in key_list)}, x.b, x.n, x.t1, count(*) AS blocks, CAST(sum(x.take) AS BIGINT) AS rows_drawn,
  sum(coalesce(e.s1, 0) + CASE WHEN start + take > x.n THEN x.t1 ELSE 0 END - coalesce(f.s1, 0)) AS sum_r, sum(coalesce(e.s2, 0) + CASE WHEN start + take > x.n THEN x.t2 ELSE 0 END - coalesce(f.s2, 0)) AS sum_r2
  FROM {prefix}_block x LEFT JOIN {prefix}_rows e ON {on('e')} AND e.pos = CASE WHEN start + take > x.n THEN start + take - x.n ELSE start + take END
  LEFT JOIN {prefix}_rows f ON {on('f')} AND f.pos = x.start GROUP BY ALL"""
    CTES[f"{prefix}_ci"] = f"""SELECT {keys}, quantile_cont(sr, 0.025) AS ci_low, quantile_cont(sr, 0.975) AS ci_high, (count(*) FILTER (m - obs >= abs(obs)) + 1) / 2001e0 AS p_value FROM (
  SELECT *, CASE WHEN v > 1e-20 THEN m / sqrt(v) * sqrt(252) END AS sr FROM (SELECT {keys}, sum_r / n AS m, (sum_r2 - sum_r * sum_r / n) / (n - 1) AS v, t1 / n AS obs FROM {prefix}_rep)) GROUP BY {keys}"""


bootstrap_ctes("boot", "bt", "ticker, strategy", "net")
bootstrap_ctes("boot_r", "ret", "ticker", "r")
bootstrap_ctes("boot_sized", "sized", "ticker", "net", ", 'main'")
ORACLES["bootstrap_gather"] = pick("boot_rep", "ticker", "strategy", "b", "~sum_r", "~sum_r2")
ORACLES["stationary_bootstrap"] = pick("boot_r_rep", "ticker", "b", "blocks", "rows_drawn", "~sum_r")
CTES["interval"] = """SELECT ticker, strategy, sharpe_annual, CASE WHEN sr IS NOT NULL THEN ci_low END AS ci_low, CASE WHEN sr IS NOT NULL THEN ci_high END AS ci_high,
  CASE WHEN sr IS NOT NULL THEN p_value END AS p_value FROM mom JOIN boot_ci USING (ticker, strategy)"""
ORACLES["bootstrap_sharpe_ci"] = pick("interval", "ticker", "strategy", "~ci_low", "~sharpe=sharpe_annual", "~ci_high")
ORACLES["bootstrap_pvalue"] = pick("interval", "ticker", "strategy", "~p_value")

# --- cross-validation ------------------------------------------------------------------------------


def cscv_ctes(prefix: str, source: str, group: str, trial: str, r: str, splits: int) -> None:
    half = splits // 2
    CTES[f"{prefix}_dates"] = f"""SELECT {group} AS g, d, t, least((row_number() OVER (PARTITION BY {group} ORDER BY d) - 1) // (count(*) OVER (PARTITION BY {group}) // {splits}), {splits - 1}) AS block FROM (
  SELECT {group}, d, count({r}) AS have, any_value(t) AS t FROM {source} JOIN (SELECT {group}, count(DISTINCT {trial}) AS t FROM {source} GROUP BY {group}) USING ({group}) GROUP BY {group}, d) WHERE have = t"""
    CTES[f"{prefix}_rows"] = f"SELECT g, t, {trial} AS trial, block, {r} AS r FROM {source} s JOIN {prefix}_dates x ON s.{group} = x.g AND s.d = x.d"
    CTES[f"{prefix}_block"] = f"SELECT g, t, trial, block, count(*) AS n, sum(r) AS s1, sum(r * r) AS s2, min(r) AS lo, max(r) AS hi FROM {prefix}_rows GROUP BY ALL"
    CTES[f"{prefix}_mask"] = f"SELECT mask, block, (mask >> block) & 1 = 1 AS inside FROM range(0, {2 ** splits}) m(mask), range(0, {splits}) b(block) WHERE bit_count(mask) = {half}"
    side = lambda v: (f"round(CASE WHEN max(hi) FILTER (inside = {v}) > min(lo) FILTER (inside = {v}) THEN sum(s1) FILTER (inside = {v}) / sum(n) FILTER (inside = {v}) / "
                      f"sqrt((sum(s2) FILTER (inside = {v}) - power(sum(s1) FILTER (inside = {v}), 2) / sum(n) FILTER (inside = {v})) / (sum(n) FILTER (inside = {v}) - 1)) END, 12)")
    CTES[f"{prefix}_each"] = f"SELECT g, t, mask, trial, {side('true')} AS is_sr, {side('false')} AS oos_sr FROM {prefix}_block JOIN {prefix}_mask USING (block) GROUP BY g, t, mask, trial"
    CTES[f"{prefix}_best"] = f"SELECT g, t, mask, trial AS winner, oos_sr AS w FROM {prefix}_each WHERE is_sr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g, mask ORDER BY is_sr DESC, trial) = 1"
    CTES[f"{prefix}_rank"] = (f"SELECT b.g, b.t, b.mask, winner, CASE WHEN max(w) IS NOT NULL THEN count(*) FILTER (oos_sr < w) + (count(*) FILTER (oos_sr = w) + 1) / 2e0 END AS rank "
                              f"FROM {prefix}_best b JOIN {prefix}_each e ON b.g = e.g AND b.mask = e.mask GROUP BY ALL")
    CTES[f"{prefix}_logit"] = f"SELECT *, ln(omega / (1 - omega)) AS logit FROM (SELECT *, least(greatest(rank / (t + 1e0), 1e-6), 1 - 1e-6) AS omega FROM {prefix}_rank)"
    CTES[f"{prefix}_pbo"] = (f"SELECT *, CASE WHEN pbo < 0.1 THEN 'ROBUST' WHEN pbo < 0.5 THEN 'MODERATE_OVERFITTING' ELSE 'OVERFITTED' END AS pbo_verdict FROM (SELECT g, "
                             f"avg(CAST(logit < 0 AS DOUBLE)) AS pbo, count(*) AS n_combinations, quantile_cont(logit, 0.5) AS median_logit FROM {prefix}_logit GROUP BY g)")


cscv_ctes("cv", "bt", "ticker", "strategy", "net", 10)
cscv_ctes("cv8", "bt", "ticker", "strategy", "net", 8)
cscv_ctes("cv6", "bt", "ticker", "strategy", "net", 6)
CTES["all_ret"] = "SELECT 'all' AS all_assets, ticker, d, r FROM ret"
cscv_ctes("cva", "all_ret", "all_assets", "ticker", "r", 8)
ORACLES["cscv_split"] = pick("cv_block", "ticker=g", "strategy=trial", "block", "n", "~s1", "~s2")
ORACLES["cscv"] = pick("cv_logit", "ticker=g", "winner", "~rank", "~omega", "~logit")
ORACLES["pbo"] = pick("cva_pbo", "all_assets=g", "~pbo", "n_combinations", "~median_logit", "pbo_verdict")
CTES["cv6_combo"] = """SELECT mask, row_number() OVER (ORDER BY list_sort(list(block))) - 1 AS combo FROM (SELECT mask, block FROM cv6_mask WHERE inside) GROUP BY mask"""
ORACLES["complement_blocks"] = pick("cv6_block JOIN cv6_mask USING (block) JOIN cv6_combo USING (mask) WHERE NOT inside GROUP BY g, trial, combo",
                                    "ticker=g", "strategy=trial", "combo", "n=CAST(sum(n) AS BIGINT)", "~sum_r=sum(s1)")

# --- walk-forward ------------------------------------------------------------------------------------------


def fold_ctes(prefix: str, source: str, keys: str) -> None:
    w = f"PARTITION BY {keys} ORDER BY d"
    CTES[f"{prefix}_num"] = f"SELECT {keys}, d, net, row_number() OVER ({w}) - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}"
    s = lambda c: f"CASE WHEN max(net) FILTER ({c}) > min(net) FILTER ({c}) THEN avg(net) FILTER ({c}) / stddev_samp(net) FILTER ({c}) * sqrt(252) END"
    train, test = "pos < a", "pos >= a AND pos < z"
    CTES[f"{prefix}_fold"] = f"""SELECT {keys}, fold, min(d) FILTER ({train}) AS train_from, max(d) FILTER ({train}) AS train_to, min(d) FILTER ({test}) AS test_from, max(d) FILTER ({test}) AS test_to,
  {s(train)} AS sharpe_is, CASE WHEN count(*) FILTER ({test}) > 30 THEN {s(test)} END AS sharpe_oos, exp(sum(ln(1 + net)) FILTER ({test})) - 1 AS return_oos FROM (
  SELECT *, 252 + (fold - 1) * ((n - 252) // 4) AS a, CASE WHEN fold = 4 THEN n ELSE 252 + fold * ((n - 252) // 4) END AS z FROM {prefix}_num, range(1, 5) f(fold) WHERE n >= 336) GROUP BY {keys}, fold"""
    CTES[f"{prefix}_walk"] = f"""SELECT *, CASE WHEN degradation < -0.5 THEN 'COLLAPSES_OUT_OF_SAMPLE' WHEN oos_sharpe <= 0 THEN 'NO_RETURN_OUT_OF_SAMPLE' ELSE 'HOLDS_OUT_OF_SAMPLE' END AS reading FROM (
  SELECT *, CASE WHEN is_sharpe_mean <> 0 THEN (oos_sharpe - is_sharpe_mean) / abs(is_sharpe_mean) END AS degradation FROM (SELECT {keys}, {s('pos >= 252')} AS oos_sharpe FROM {prefix}_num WHERE n >= 336 GROUP BY {keys})
  JOIN (SELECT {keys}, avg(sharpe_is) AS is_sharpe_mean FROM {prefix}_fold GROUP BY {keys}) USING ({keys}))"""


fold_ctes("wf", "bt", "ticker, strategy")
ORACLES["walk_forward"] = pick("wf_fold", "ticker", "strategy", "fold", "train_from", "train_to", "test_from", "test_to", "~sharpe_is", "~sharpe_oos", "~return_oos")
ORACLES["walk_forward_summary"] = pick("wf_walk", "ticker", "strategy", "folds=4", "~oos_sharpe", "~is_sharpe_mean", "~degradation", "reading")
ORACLES["verdicts"] = """SELECT ticker, strategy, verdict, CASE WHEN min_track_record > observations THEN 'TOO_SHORT' ELSE 'LONG_ENOUGH' END AS track_record, reading, pbo_verdict
  FROM assessed JOIN wf_walk USING (ticker, strategy) JOIN cv_pbo ON cv_pbo.g = ticker"""

# --- events ----------------------------------------------------------------------------------------------------


def t_tail(t: str, df: str) -> str:
    """Two-sided Student-t p: gamma-function series for few degrees of freedom,
    Hill's expansion beyond."""
    c2 = f"({df} / ({df} + {t} * {t}))"
    sin = f"(abs({t}) / sqrt({df} + {t} * {t}))"
    even = f"1 - {sin} * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5e0) - lgamma(k + 1e0)) / sqrt(pi()) * power({c2}, k)))"
    odd = (f"1 - 2 / pi() * (atan(abs({t}) / sqrt({df})) + {sin} * sqrt({c2}) * coalesce(list_sum(list_transform(range(0, CAST(({df} - 1) // 2 AS BIGINT)), "
           f"lambda k: exp(lgamma(k + 1e0) - lgamma(k + 1.5e0)) * sqrt(pi()) / 2 * power({c2}, k))), 0))")
    z = f"(-({pr.hill_t_sql(f'CAST({t} AS DOUBLE)', f'CAST({df} AS DOUBLE)')}))"
    return (f"CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL WHEN {df} > {pr.T_SERIES_MAX_DF} THEN 2 * {pr.norm_cdf_sql(z)} "
            f"WHEN {df} = 1 THEN 1 - 2 / pi() * atan(abs({t})) WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END")


ORACLES["market_model"] = pick("model", "ticker", "d", "estimation_obs", "~alpha", "~beta", "~r_squared", "~residual_sd")
CTES["effect"] = f"""SELECT *, CASE WHEN se > 0 THEN car / se END AS car_t FROM (SELECT *, residual_sd * sqrt(k) AS se, CASE WHEN alpha IS NOT NULL THEN coalesce(total, 0) END AS car FROM (
  SELECT m.ticker, m.d AS anchor_d, m.alpha, m.beta, m.residual_sd, m.estimation_obs, count(w.market_r) AS k, sum(w.r - m.alpha - m.beta * w.market_r) AS total
  FROM model m LEFT JOIN ret_mkt w ON w.ticker = m.ticker AND w.pos BETWEEN m.pos - 1 AND m.pos + 3
  GROUP BY m.ticker, m.d, m.alpha, m.beta, m.residual_sd, m.estimation_obs))"""
CTES["effect_p"] = f"SELECT *, {t_tail('car_t', 'greatest(estimation_obs - 2, 1)')} AS car_p FROM effect"
CTES["result"] = """SELECT event_id, ticker, event_date, category, anchor_d, estimation_obs, alpha, beta, car, car_t, car_p, CASE WHEN anchor_d IS NULL THEN 'NO_LATER_ROW' WHEN alpha IS NULL THEN 'INSUFFICIENT_HISTORY' END AS skipped
  FROM occurrence JOIN anchor_ret USING (ticker, event_date) LEFT JOIN effect_p USING (ticker, anchor_d)"""
ORACLES["event_study"] = pick("result", "event_id", "ticker", "event_date", "category", "anchor_d", "estimation_obs", "~beta", "~car", "~car_t", "~car_p", "skipped")
CTES["caar"] = """SELECT category, count(*) AS n_events, avg(car) AS mean_car, quantile_cont(car, 0.5) AS median_car, avg(CAST(car > 0 AS DOUBLE)) AS hit_rate,
  avg(car) / (stddev_samp(car) / sqrt(count(*))) AS t_stat, count(*) - 1 AS df FROM result WHERE car IS NOT NULL GROUP BY category"""
CTES["caar_p"] = f"SELECT *, {t_tail('t_stat', 'df')} AS p_value FROM caar"
ORACLES["caar_by_category"] = pick("caar_p", "category", "n_events", "~mean_car", "~median_car", "~hit_rate", "~t_stat", "~p_value",
                                   "verdict=CASE WHEN n_events < 5 THEN 'TOO_FEW_EVENTS' WHEN p_value < 0.05 THEN 'SYSTEMATIC_EFFECT' ELSE 'NO_SYSTEMATIC_EFFECT' END")
ORACLES["events_recent_30"] = """SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_date DESC, event_id DESC) AS rank FROM occurrence QUALIFY rank <= 30"""
ORACLES["sort_by_date"] = "SELECT * FROM occurrence ORDER BY event_date, event_id"

# --- quality and exchange rate ------------------------------------------------------------------------------

CTES["vendor_diff"] = """SELECT ticker, d, abs((b.close - s.close) / s.close * 100) AS diff FROM bar b JOIN (SELECT * FROM second WHERE ticker <> '5-LOW') s USING (ticker, d)"""
ORACLES["reconcile_sources"] = """SELECT ticker, count(diff) AS compared_days, round(max(diff), 6) + 0.0 AS max_abs_pct_diff, round(quantile_cont(diff, 0.5), 6) + 0.0 AS median_abs_pct_diff,
  count(*) FILTER (diff > 1) AS days_over_tolerance, CASE WHEN count(diff) > 0 THEN coalesce(string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) FILTER (diff > 1), '') END AS days,
  count(diff) > 0 AS secondary_available, count(diff) > 0 AND count(*) FILTER (diff > 1) = 0 AS clean FROM (SELECT DISTINCT ticker FROM bar) LEFT JOIN vendor_diff USING (ticker) GROUP BY ticker"""
CTES["coarse"] = "SELECT ticker, d, round(close / 3000) * 3000 AS close FROM bar"


def frozen_cte(source: str) -> str:
    return f"""SELECT ticker, count(*) AS run_days, min(d) AS run_start, max(d) AS run_end, arg_max(nxt, d) FILTER (nxt IS NOT NULL) AS nxt_any, max(nxt) AS reported_d, max(nxt) IS NULL AS open_run FROM (
  SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER ({BY} {SO_FAR}) AS run FROM (SELECT ticker, d, coalesce(close = lag(close) OVER ({BY}), false) AS flat, lead(d) OVER ({BY}) AS nxt FROM {source}))
  WHERE flat GROUP BY ticker, run HAVING count(*) >= 5"""


CTES["frozen"] = frozen_cte("coarse")
ORACLES["frozen_price_runs"] = "SELECT ticker, run_days, run_start, run_end, CASE WHEN open_run THEN NULL ELSE reported_d END AS reported_d, open_run FROM frozen"
ORACLES["duplicate_dates"] = "SELECT ticker, d, count(*) - 1 AS extra_rows FROM trade GROUP BY ticker, d HAVING count(*) > 1"
CTES["dirty_one"] = f"""SELECT ticker, d, firstq, CASE WHEN firstq AND month(d) = 1 THEN -1 ELSE 1 END * CASE WHEN d >= DATE '1998-01-01' THEN 10 ELSE 1 END * close AS close FROM (
  SELECT *, coalesce(lag(date_trunc('quarter', d)) OVER ({BY}) <> date_trunc('quarter', d), true) AS firstq FROM coarse)"""
CTES["dirty"] = "SELECT ticker, d, close FROM dirty_one UNION ALL SELECT ticker, d, close FROM dirty_one WHERE firstq AND month(d) = 7"


def anomaly_ctes(name: str, source: str) -> None:
    CTES[f"{name}_ret"] = f"SELECT * FROM (SELECT ticker, d, CASE WHEN q > 0 THEN ln(q) END AS log_r FROM (SELECT ticker, d, close / lag(close) OVER ({BY}) AS q FROM {source})) WHERE log_r IS NOT NULL"
    CTES[f"{name}_frozen"] = frozen_cte(source)
    CTES[name] = f"""SELECT ticker, 'NON_POSITIVE_PRICE' AS kind, d, close AS detail FROM {source} WHERE close <= 0
  UNION ALL SELECT ticker, 'DUPLICATE_DATE', d, count(*) - 1 FROM {source} GROUP BY ticker, d HAVING count(*) > 1
  UNION ALL SELECT ticker, 'EXTREME_JUMP', d, log_r FROM {name}_ret JOIN (SELECT ticker, stddev_samp(log_r) AS sd FROM {name}_ret GROUP BY ticker HAVING count(*) > 30) USING (ticker) WHERE abs(log_r) > 8 * sd
  UNION ALL SELECT ticker, 'FROZEN_PRICE', CASE WHEN open_run THEN run_end ELSE reported_d END, run_days FROM {name}_frozen"""


anomaly_ctes("anomaly", "dirty")
anomaly_ctes("bar_anomaly", "bar")
ORACLES["data_anomalies"] = pick("anomaly", "ticker", "kind", "d", "~detail=CAST(detail AS DOUBLE)")
ORACLES["anomaly_union"] = "SELECT ticker, kind, count(*) AS n FROM anomaly GROUP BY ticker, kind"
ORACLES["implied_fx"] = pick("pair", "ticker", "d", "~rate=local_raw * CASE WHEN d < DATE '1998-01-01' THEN 1 ELSE 10 END / adr")


def continuity(rate: str, label: str) -> str:
    med = lambda c: f"quantile_cont(rate, 0.5) FILTER ({c})"
    return f"""SELECT ticker, valid_from, before AS median_before, after AS median_after, (after / before - 1) * 100 AS step_pct, abs((after / before - 1) * 100) > 25 AS flagged,
  CASE WHEN abs((after / before - 1) * 100) > 25 THEN CASE WHEN abs(after / before / 0.1 - 1) < 0.2 THEN 0.1e0 WHEN abs(after / before / 10 - 1) < 0.2 THEN 10e0 END END AS split_hint,
  NOT abs((after / before - 1) * 100) > 25 AS usable, '{label}' AS series FROM (SELECT ticker, valid_from, {med('NOT late')} AS before, {med('late')} AS after FROM (
  SELECT p.ticker, valid_from, d >= valid_from AS late, {rate} AS rate, row_number() OVER (PARTITION BY p.ticker, valid_from, d >= valid_from ORDER BY abs(date_diff('day', valid_from, d))) AS k
  FROM pair p JOIN ratios USING (ticker)) WHERE k <= 5 GROUP BY ticker, valid_from HAVING count(*) FILTER (late) >= 2 AND count(*) FILTER (NOT late) >= 2)"""


CTES["steps"] = continuity("local_adj * 10 / adr", "adjusted") + " UNION ALL " + continuity("local_raw * 10 / adr", "raw_as_adjusted")
ORACLES["ccl_continuity"] = pick("steps", "ticker", "valid_from", "~median_before", "~median_after", "~step_pct", "flagged", "~split_hint", "usable", "series")
ORACLES["ccl_level_gap"] = """SELECT ticker, count(gap) AS common_days, round(CASE WHEN count(gap) >= 20 THEN quantile_cont(gap, 0.5) END, 6) + 0.0 AS median_gap_pct,
  CASE WHEN count(gap) < 20 THEN 'NOT_VALIDATED' WHEN quantile_cont(gap, 0.5) > 200 THEN 'GAP_TOO_WIDE' WHEN quantile_cont(gap, 0.5) < -20 THEN 'BELOW_OFFICIAL' ELSE 'PLAUSIBLE' END AS level
  FROM (SELECT ticker, CASE WHEN ticker <> '5-LOW' THEN (local_adj * 10 / adr / official_rate - 1) * 100 END AS gap FROM pair) GROUP BY ticker"""
ORACLES["head_tail_k"] = pick("""(SELECT b.ticker, valid_from, d >= valid_from AS after, d, close, row_number() OVER (PARTITION BY b.ticker, valid_from, d >= valid_from ORDER BY abs(date_diff('day', valid_from, d))) AS k
  FROM bar b JOIN ratios USING (ticker)) WHERE k <= 5""", "ticker", "valid_from", "after", "k", "d", "~close")

# --- indicators ------------------------------------------------------------------------------------------------------

ORACLES["ts_momentum"] = pick("sig", "ticker", "d", "~momentum")
ORACLES["trend_sma"] = pick("sig", "ticker", "d", "~trend")
ORACLES["dist_52w_high"] = pick("sig", "ticker", "d", "~near_high")
ORACLES["signals"] = pick("sig", "ticker", "d", "~momentum", "~trend", "~near_high", "~score", "~flag")
_label = lambda c: f"CASE WHEN {c} IS NULL THEN 'NO_DATA' WHEN {c} THEN 'YES' ELSE 'NO' END"
ORACLES["vote_labels"] = pick("sig", "ticker", "d", f"momentum_vote={_label('momentum > 0')}", f"trend_vote={_label('trend > 0.5')}", f"high_vote={_label('near_high >= 0.75')}")
CTES["last_sig"] = "SELECT * FROM sig WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) = 1"
ORACLES["latest_signal"] = pick("(SELECT DISTINCT ticker FROM bar) LEFT JOIN last_sig USING (ticker)", "ticker", "d", "~momentum", "~near_high", "~score", f"momentum_vote={_label('momentum > 0')}",
                                f"trend_vote={_label('trend > 0.5')}", f"high_vote={_label('near_high >= 0.75')}",
                                "decision=CASE WHEN score IS NULL THEN 'INSUFFICIENT_DATA' WHEN flag > 0 THEN 'BUY_HOLD' ELSE 'CASH' END")
ORACLES["realized_vol"] = pick("vol WHERE r IS NOT NULL", "ticker", "d", "~vol")
ORACLES["vol_target_weight"] = pick("vol", "ticker", "d", "~vol", "~weight=CASE WHEN vol > 0 THEN least(0.15e0 / vol, 1e0) END")
ORACLES["xs_momentum_rank"] = pick("(SELECT *, rank() OVER p AS rk, count(*) OVER (PARTITION BY d, momentum) AS same, count(*) OVER (PARTITION BY d) AS total FROM sig WHERE momentum IS NOT NULL WINDOW p AS (PARTITION BY d ORDER BY momentum))",
                                   "ticker", "d", "~momentum", "~momentum_rank=(rk + (same - 1) / 2e0) / total")
ORACLES["max_drawdown"] = """SELECT ticker, round(min(dd), 6) + 0.0 AS max_drawdown, first(peak ORDER BY dd, d) AS drawdown_peak, first(d ORDER BY dd, d) AS drawdown_trough FROM (
  SELECT *, last_value(top IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM (
  SELECT ticker, d, close / max(close) OVER w - 1 AS dd, CASE WHEN close > coalesce(max(close) OVER p, 0) THEN d END AS top FROM bar
  WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) GROUP BY ticker"""
ORACLES["rolling_beta"] = pick("""(SELECT ticker, d, CASE WHEN count(*) OVER f >= 126 THEN covar_samp(r, market_r) OVER f / var_samp(market_r) OVER f END AS beta FROM ret_mkt WHERE market_r IS NOT NULL
  WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))""", "ticker", "d", "~beta")
YEAR = "ROWS BETWEEN 251 PRECEDING AND CURRENT ROW"
CTES["mr_year"] = reversion_cte("bar", "ticker", YEAR)
ORACLES["expanding_extremes"] = pick("mr JOIN (SELECT ticker, d, low_so_far AS low_year, high_so_far AS high_year FROM mr_year) USING (ticker, d)", "ticker", "d", "~low_so_far", "~high_so_far", "~low_year", "~high_year")
ORACLES["mean_reversion_state"] = pick("mr", "ticker", "d", "~position")
ORACLES["mean_reversion"] = pick("mr_year", "ticker", "d", "~low_so_far", "~high_so_far", "~position")

# --- accounts --------------------------------------------------------------------------------------------------------

ORACLES["first_signal_date"] = "SELECT ticker, min(d) AS first_signal_d FROM mr WHERE low_so_far IS NOT NULL GROUP BY ticker"
ORACLES["next_day_execution_price"] = pick("bar", "ticker", "d", "~close", f"execution_d=lead(d) OVER ({BY})", f"~execution_price=lead(close) OVER ({BY})")
CTES["zone"] = f"""SELECT * FROM (SELECT ticker, d, close / low_so_far - 1 <= 0.1e0 AS near_low, close / high_so_far >= 0.95e0 AS near_high, lead(d) OVER ({BY}) AS execution_d, lead(close) OVER ({BY}) AS execution_price, low_so_far FROM mr)
  WHERE low_so_far IS NOT NULL AND execution_d IS NOT NULL"""
ORACLES["zone_signals"] = pick("zone", "ticker", "d", "execution_d", "~execution_price", "near_low", "near_high")
CTES["kept"] = """SELECT ticker, min(d) AS d FROM zone WHERE near_low OR near_high GROUP BY ticker
  UNION ALL SELECT k.ticker, (SELECT min(z.d) FROM zone z WHERE z.ticker = k.ticker AND (near_low OR near_high) AND z.d >= k.d + 21) FROM kept k
  WHERE EXISTS (SELECT 1 FROM zone z WHERE z.ticker = k.ticker AND (near_low OR near_high) AND z.d >= k.d + 21)"""
ORACLES["cooldown_filter"] = "SELECT ticker, d FROM kept"
ORACLES["best_buy_then_sell"] = """SELECT b.ticker, b.d AS buy_d, round(b.close, 6) + 0.0 AS buy_price, min(s.d) AS sell_d, round(b.best, 6) + 0.0 AS sell_price, round(b.first * 100, 4) + 0.0 AS capital,
  round(b.first * 100 / (b.close * 1.0005e0), 4) + 0.0 AS shares_bought, round(b.first * 100 / (b.close * 1.0005e0) * b.best * 0.9995e0, 4) + 0.0 AS final_value FROM (
  SELECT * FROM (SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best, first_value(close) OVER (PARTITION BY ticker ORDER BY d) AS first FROM bar)
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY best / close DESC, d) = 1) b
  JOIN bar s ON s.ticker = b.ticker AND s.d >= b.d AND s.close = b.best GROUP BY ALL"""
CTES["entry"] = f"""SELECT *, round(CASE WHEN kind = 'BUY' THEN -gross ELSE gross END - costs, 6) AS net, CASE WHEN kind = 'BUY' THEN qty ELSE -qty END AS signed_qty FROM (
  SELECT *, round(gross * 0.0005e0, 6) AS costs FROM (SELECT *, round(qty * price, 2) AS gross FROM account_trade))"""
CTES["balance"] = f"""SELECT *, sum(signed_qty) OVER w AS shares_after, sum(net) OVER w AS cash_after FROM entry WINDOW w AS (PARTITION BY account ORDER BY {LEDGER_ORDER} {SO_FAR})"""
ORACLES["ledger_running_balance"] = pick("balance", "account", "d", "order_id", "line_no", "part_id", "kind", "~net", "~shares_after", "~cash_after")
ORACLES["ledger_totals"] = """SELECT account, count(*) FILTER (kind = 'BUY') AS buys, count(*) FILTER (kind = 'SELL') AS sells, round(coalesce(sum(gross) FILTER (kind = 'BUY'), 0), 6) + 0.0 AS bought,
  round(coalesce(sum(gross) FILTER (kind = 'SELL'), 0), 6) + 0.0 AS sold, 0e0 AS dividends, round(sum(costs), 6) + 0.0 AS total_costs, round(sum(net), 6) + 0.0 AS final_cash,
  bool_or(cash_after < -1e-6) AS needed_outside_money, false AS never_traded FROM balance GROUP BY account"""
CTES["basis"] = "SELECT account, sale_seq AS seq, sum(matched_qty) AS matched_qty, sum(matched_qty * lot_price) AS cost_basis FROM fifo GROUP BY 1, 2"
ORACLES["realized_gains"] = pick("(SELECT * FROM cover WHERE kind = 'SELL') LEFT JOIN basis USING (account, seq)", "account", "seq", "d", "~qty", "~8:price", "~matched_qty=coalesce(matched_qty, 0)",
                                 "~8:cost_basis=coalesce(cost_basis, 0)", "~8:gain=qty * price - coalesce(cost_basis, 0)", "~10:tax=greatest(qty * price - coalesce(cost_basis, 0), 0) * 0.15e0")
ORACLES["oversold_accounts"] = "SELECT account, round(sum(uncovered), 6) + 0.0 AS oversold_qty, count(*) FILTER (uncovered > 1e-9) AS oversold_sales FROM cover GROUP BY account HAVING count(*) FILTER (uncovered > 1e-9) > 0"
CTES["open_lot"] = """SELECT b.account, b.price, b.hi - greatest(b.lo, coalesce(s.sold, 0)) AS left_qty FROM cover b LEFT JOIN (SELECT account, max(hi) AS sold FROM cover WHERE kind = 'SELL' GROUP BY account) s USING (account)
  WHERE b.kind = 'BUY' AND b.hi - greatest(b.lo, coalesce(s.sold, 0)) > 1e-9"""
CTES["latent"] = """SELECT *, open_qty * last_price AS value, open_qty * last_price - open_cost AS gain FROM (SELECT account, arg_max(price, seq) AS last_price FROM cover GROUP BY account)
  JOIN (SELECT account, coalesce(sum(left_qty), 0) AS open_qty, coalesce(sum(left_qty * price), 0) AS open_cost FROM (SELECT DISTINCT account FROM cover) LEFT JOIN open_lot USING (account) GROUP BY account) USING (account)"""
ORACLES["liquidation_value"] = pick("latent", "account", "~open_qty", "~4:open_cost", "~8:last_price", "~4:unrealized_gain=gain", "~4:value", "~4:value_if_sold=value - greatest(gain, 0) * 0.15e0")
CTES["regime_rate"] = ("SELECT * FROM (VALUES " + ", ".join(f"('{r}', {g}e0, {w}e0, {l}e0, {h}e0)" for r, g, w, l, h in TAX_REGIMES)
                       + ") t(regime, gains, withholding, local, wealth)")
ORACLES["tax_rules"] = pick("customer, regime_rate", "c_custkey", "regime", "~sale_tax=greatest(c_acctbal, 0) * gains", "~dividend_net=abs(c_acctbal) * (1 - withholding - local)",
                            "~holding_tax=greatest(c_acctbal, 0) * wealth")
CTES["hold_px"] = "SELECT bar.ticker, d, close, first_d FROM bar JOIN (SELECT ticker, min(d) AS first_d FROM mr WHERE low_so_far IS NOT NULL GROUP BY ticker) USING (ticker) WHERE d >= first_d"
CTES["hold_base"] = """SELECT ticker, first_d AS start_d, arg_min(close, d) AS p0, arg_max(close, d) AS p1, max(d) AS last_d FROM hold_px GROUP BY ticker, first_d"""
CTES["hold_div"] = "SELECT h.ticker, d, per_share FROM div JOIN hold_base h ON div.ticker = h.ticker AND d BETWEEN start_d AND last_d"
CTES["hold_year"] = """SELECT ticker, year(d) AS y, arg_max(close, d) AS p, row_number() OVER (PARTITION BY ticker ORDER BY year(d) DESC) - 1 AS later, count(*) OVER (PARTITION BY ticker) AS years FROM hold_px GROUP BY ticker, year(d)"""
# Closed form of the yearly recurrence cash' = cash - rate * (100 * price + cash).
CTES["hold_all"] = """SELECT b.*, r.*, 100 * p0 AS capital, 100 * p0 * 0.0005e0 AS commission, coalesce(dv.payments, 0) AS payments, 100 * coalesce(dv.total, 0) AS gross_div,
  100 * coalesce(dv.total, 0) * (1 - withholding - local) AS net_div, (SELECT max(years) FROM hold_year y WHERE y.ticker = b.ticker) AS years,
  (SELECT sum(power(1 - wealth, later) * wealth * 100 * p) FROM hold_year y WHERE y.ticker = b.ticker) AS drag,
  (SELECT sum(power(1 - wealth, y.later + 1) * 100 * v.per_share * (1 - withholding - local)) FROM hold_div v JOIN hold_year y ON y.ticker = v.ticker AND y.y = year(v.d) WHERE v.ticker = b.ticker) AS aged_div
  FROM hold_base b LEFT JOIN (SELECT ticker, count(*) AS payments, sum(per_share) AS total FROM hold_div GROUP BY ticker) dv USING (ticker), regime_rate r"""
CTES["hold_end"] = """SELECT *, (net_div - commission) * power(1 - wealth, years) - drag AS cash, coalesce(aged_div, 0) - commission * power(1 - wealth, years) - drag AS cash_by_date FROM hold_all"""
ORACLES["hold_account_statement"] = pick("hold_end", "ticker", "regime", "start_d", "~buy_price=p0", "~final_price=p1", "~capital", "~commission", "payments", "~dividends_net=net_div",
                                         "~taxes_paid=gross_div - net_div + (net_div - commission - cash)", "~final_cash=cash", "~final_value=100 * p1 + cash", "~unrealized_gain=100 * (p1 - p0)",
                                         "~value_if_sold=100 * p1 + cash - greatest(100 * (p1 - p0), 0) * gains")
ORACLES["hold_account_chronological"] = pick("hold_end", "ticker", "regime", "~final_cash=cash_by_date", "~final_value=100 * p1 + cash_by_date")

# --- universe, lineage, fingerprints ------------------------------------------------------------------------------

ORACLES["unranked_symbols"] = "SELECT symbol FROM caps WHERE cap IS NULL"
ORACLES["top_n_by_market_cap"] = pick("(SELECT * FROM caps WHERE cap > 0 ORDER BY cap DESC, position LIMIT 10)", "symbol", "~cap")
_fallback = ", ".join(f"('{s}')" for s in FALLBACK_SYMBOLS)
ORACLES["universe_resolution"] = f"""SELECT symbol, round(cap, 6) + 0.0 AS cap, false AS is_fallback, CAST(NULL AS DATE) AS as_of FROM (SELECT * FROM caps WHERE cap > 0 ORDER BY cap DESC, position LIMIT 10)
  WHERE (SELECT count(*) FROM caps) >= 50 AND (SELECT count(*) FROM caps WHERE cap > 0) >= 10
  UNION ALL SELECT symbol, NULL, true, DATE '{FALLBACK_DATE}' FROM (VALUES {_fallback}) f(symbol) WHERE (SELECT count(*) FROM caps) < 50 OR (SELECT count(*) FROM caps WHERE cap > 0) < 10"""
CTES["edge"] = """SELECT 'order:' || o_orderkey AS child, 'customer:' || o_custkey AS parent FROM orders UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation"""
CTES["closure"] = "SELECT child AS dataset_id, parent AS ancestor, 1 AS depth FROM edge UNION SELECT dataset_id, e.parent, depth + 1 FROM closure JOIN edge e ON e.child = closure.ancestor"
ORACLES["lineage"] = "SELECT dataset_id, ancestor, CAST(depth AS INTEGER) AS depth FROM closure"
ORACLES["write_lineage"] = """SELECT dataset_id, ancestor, CAST(depth AS INTEGER) AS depth, CASE WHEN c_acctbal < 0 THEN 'synthetic' WHEN ancestor LIKE 'region:%' THEN 'observed' ELSE 'derived' END AS kind
  FROM closure LEFT JOIN customer ON ancestor = 'customer:' || c_custkey"""
ORACLES["lineage_union"] = "SELECT DISTINCT 'book' AS dataset_id, ancestor FROM closure WHERE dataset_id LIKE 'customer:%' OR dataset_id LIKE 'supplier:%'"
ORACLES["contamination_gate"] = "SELECT 'order:' || o_orderkey AS dataset_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0"
ORACLES["series_fingerprint"] = """SELECT ticker, count(*) AS rows, min(d) AS first_obs, max(d) AS last_obs, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', CAST(d AS VARCHAR), CAST(CAST(round(open * 10000) AS BIGINT) AS VARCHAR), CAST(CAST(round(high * 10000) AS BIGINT) AS VARCHAR),
  CAST(CAST(round(low * 10000) AS BIGINT) AS VARCHAR), CAST(CAST(round(close * 10000) AS BIGINT) AS VARCHAR), CAST(CAST(volume AS BIGINT) AS VARCHAR))), 1, 15))::UBIGINT AS HUGEINT)) AS VARCHAR) AS content_hash FROM bar GROUP BY ticker"""

# --- scalar functions and sets ----------------------------------------------------------------------------------------

ORACLES["intersect_dates"] = "SELECT ticker, d FROM bar WHERE volume < 150 INTERSECT SELECT ticker, d FROM bar WHERE close > open"
ORACLES["scalar_functions"] = pick("bar", "ticker", "d", "~ln_close=ln(close)", "~exp_r=exp(close / open - 1)", "~root=sqrt(close)", "~move=abs(close - open)", "~top=greatest(open, close)",
                                   "~bottom=least(open, close)", "~clamped=greatest(least(close / open, 1.01e0), 0.99e0)", "undefined=CAST(NULL AS DOUBLE)")
ORACLES["date_functions"] = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(year(o_orderdate) AS INTEGER) AS y,
  month(o_orderdate) = 12 AND day(o_orderdate) >= 28 AS year_end, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
  CAST(date_trunc('week', CAST(o_orderdate AS DATE) + 2) AS DATE) + 4 AS week FROM orders"""
_keys = lambda text: " ".join(f"WHEN regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_])({w})($|[^\\p{{L}}\\p{{N}}_])', 'i') THEN '{c}'" for w, c in tx.KEYWORD_CATEGORIES)
ORACLES["classify_filing"] = f"""SELECT doc_id, form, CASE form WHEN ' 6-k ' THEN CASE {_keys('text')} ELSE 'hecho_relevante' END WHEN '10-Q' THEN 'resultados_trimestrales'
  ELSE CASE {_keys("(form || ' ' || text)")} ELSE 'sin_clasificar' END END AS category FROM documents, (VALUES (' 6-k '), ('10-Q'), ('NT 10-K')) f(form)"""
ORACLES["string_functions"] = """SELECT s_suppkey, upper(s_name) || '.BA' AS upper_name, upper(s_name) AS root, replace(s_name, '#', '') || '.ba' AS joined, true AS is_local, CAST(NULL AS VARCHAR) AS alphabetic FROM supplier"""
ORACLES["json_functions"] = "SELECT event_id, 'k' AS name, CAST(props ->> '$.k' AS BIGINT) AS value FROM events"
ORACLES["array_functions"] = """SELECT ticker, y, k, CAST((last + k) % n AS INTEGER) AS position FROM (SELECT ticker, CAST(year(d) AS INTEGER) AS y, count(*) AS n, max(dayofyear(d)) AS last FROM bar GROUP BY 1, 2), (VALUES (0), (1), (2)) t(k)"""
CTES["scaled"] = "SELECT ticker, d, log_r / stddev_samp(log_r) OVER (PARTITION BY ticker) * 3 AS z FROM ret"
ORACLES["norm_cdf"] = pick("scaled", "ticker", "d", f"~p={pr.norm_cdf_sql('z')}")
CTES["placed"] = f"SELECT ticker, d, row_number() OVER ({BY}) / (count(*) OVER (PARTITION BY ticker) + 1) AS p FROM bar"
ORACLES["norm_ppf"] = pick("placed", "ticker", "d", f"~z={pr.norm_ppf_sql('p')}")
CTES["month_t"] = "SELECT ticker, CAST(date_trunc('month', d) AS DATE) AS month, count(*) - 1 AS df, avg(r) / stddev_samp(r) * sqrt(count(*)) AS t FROM ret GROUP BY 1, 2"
ORACLES["t_pvalue"] = pick("month_t", "ticker", "month", "df", f"~p={t_tail('t', 'df')}")

# --- whole jobs -----------------------------------------------------------------------------------------------------------

CTES["comparison"] = """SELECT s.*, sharpe_annual, deflated_sharpe, ci_low, ci_high, p_value, oos_sharpe, degradation, pbo, time_in_market = 0 AS never_traded, coalesce(ci_low <= 0 AND ci_high >= 0, false) AS ci_includes_zero, verdict
  FROM bt_sum s JOIN (SELECT ticker, strategy, deflated_sharpe, verdict FROM assessed) USING (ticker, strategy) JOIN interval USING (ticker, strategy)
  LEFT JOIN (SELECT * FROM wf_walk WHERE strategy <> 'buy_and_hold') USING (ticker, strategy) LEFT JOIN cv8_pbo ON cv8_pbo.g = ticker"""
ORACLES["compare_strategies"] = pick("comparison", "ticker", "strategy", "n_rows", "trades", "~net_return", "~sharpe_annual", "~max_drawdown", "~deflated_sharpe", "~ci_low", "~ci_high", "~p_value",
                                     "~oos_sharpe", "~degradation", "~pbo", "never_traded", "ci_includes_zero", "verdict")
ORACLES["comparison_verdict"] = """SELECT ticker, survivors, best_active, idle_strategies, intervals_with_zero, observations, round(delta, 6) + 0.0 AS best_active_delta,
  CASE WHEN survivors = 0 THEN 'NO_STRATEGY_SURVIVES' ELSE 'SOME_SURVIVE' END AS evidence, CASE WHEN delta > 0 THEN 'ACTIVE_WINS' ELSE 'PASSIVE_WINS' END AS against_passive,
  CASE WHEN observations < 504 THEN 'SMALL_SAMPLE' ELSE 'ADEQUATE_SAMPLE' END AS sample FROM (SELECT ticker, count(*) FILTER (deflated_sharpe >= 0.95) AS survivors,
  arg_max(strategy, {'r': net_return, 'p': -list_position(['momentum_trend', 'mean_reversion'], strategy)}) FILTER (strategy <> 'buy_and_hold' AND net_return IS NOT NULL) AS best_active, count(*) FILTER (never_traded) AS idle_strategies, count(*) FILTER (ci_includes_zero) AS intervals_with_zero,
  max(n_rows) AS observations, max(net_return) FILTER (strategy <> 'buy_and_hold') - max(net_return) FILTER (strategy = 'buy_and_hold') AS delta FROM comparison GROUP BY ticker)"""
CTES["plain_grid"] = "SELECT s.ticker, s.d, s.close, s.flag, weight FROM sig s JOIN weighted USING (ticker, d)"
backtest_ctes("plain", "plain_grid", "ticker", weight="weight")
fold_ctes("pf", "plain", "ticker")
CTES["sized_mom"] = """SELECT *, sr * sqrt(observations - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS z FROM (SELECT ticker, count(net) AS observations,
  avg(net) / stddev_samp(net) AS sr, skewness(net) AS skew, kurtosis(net) + 3 AS kurt FROM sized GROUP BY ticker)"""
CTES["sized_assessed"] = f"SELECT *, {pr.norm_cdf_sql('z')} AS psr FROM sized_mom"
CTES["event_count"] = "SELECT ticker, count(car) AS events_measured, count(*) FILTER (car_p < 0.05) AS events_significant FROM result GROUP BY ticker"
ORACLES["analyze_panel"] = pick("""(SELECT ticker, count(*) AS n_rows FROM bar GROUP BY ticker) JOIN (SELECT ticker, score, flag FROM last_sig) USING (ticker) JOIN sized_sum USING (ticker, n_rows) JOIN sized_assessed USING (ticker)
  JOIN boot_sized_ci USING (ticker) JOIN pf_walk USING (ticker) JOIN event_count USING (ticker)
  LEFT JOIN (SELECT ticker, count(diff) AS compared, count(*) FILTER (diff > 1) AS off FROM vendor_diff GROUP BY ticker) USING (ticker)
  LEFT JOIN (SELECT ticker, count(*) AS odd FROM bar_anomaly GROUP BY ticker) USING (ticker)""", "ticker", "n_rows", "accepted=n_rows >= 260", "~score",
                                "decision=CASE WHEN flag > 0 THEN 'BUY_HOLD' ELSE 'CASH' END", "trades", "~net_return", "~max_drawdown", "~time_in_market", "~benchmark_return",
                                "~sharpe_annual=sr * sqrt(252)", "~psr", "~deflated_sharpe=psr",
                                "verdict=CASE WHEN observations < 252 THEN 'INSUFFICIENT_SAMPLE' WHEN psr >= 0.95 THEN 'SURVIVES_95' WHEN psr >= 0.9 THEN 'MODERATE_90' ELSE 'NO_EVIDENCE' END",
                                "~ci_low", "~ci_high", "~p_value", "~oos_sharpe", "~degradation", "reading", "events_measured", "events_significant",
                                "compared_days=coalesce(compared, 0)", "days_over_tolerance=coalesce(off, 0)", "clean=coalesce(compared > 0 AND off = 0, false)", "anomalies=coalesce(odd, 0)")


# --- prefixes, payloads, records, gates -------------------------------------------------------------
CTES["prefix_grid"] = f"""SELECT ticker || '#' || k AS series, ticker, k, pos, size, n, d, close, CAST(close > avg(close) OVER (PARTITION BY ticker, k) AS DOUBLE) AS flag FROM (
  SELECT *, (n - 252) // 4 AS size FROM (SELECT ticker, d, close, row_number() OVER ({BY}) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM bar)), range(0, 5) p(k)
  WHERE n >= 336 AND pos < CASE WHEN k = 4 THEN n ELSE 252 + k * size END"""
backtest_ctes("prefix_bt", "prefix_grid", "series")
_s = lambda c: f"CASE WHEN max(net) FILTER ({c}) > min(net) FILTER ({c}) THEN avg(net) FILTER ({c}) / stddev_samp(net) FILTER ({c}) * sqrt(252) END"
CTES["prefix_part"] = f"""SELECT ticker, k, min(d) AS d0, max(d) AS d1, {_s('true')} AS sharpe_is, min(d) FILTER (judged) AS t0, max(d) FILTER (judged) AS t1, CASE WHEN count(*) FILTER (judged) > 30 THEN {_s('judged')} END AS sharpe_oos,
  exp(sum(ln(1 + net)) FILTER (judged)) - 1 AS return_oos FROM (SELECT *, k > 0 AND pos >= 252 + (k - 1) * size AS judged FROM prefix_bt) GROUP BY ticker, k"""
CTES["prefix_fold"] = """SELECT a.ticker, a.k + 1 AS fold, a.d0 AS train_from, a.d1 AS train_to, b.t0 AS test_from, b.t1 AS test_to, a.sharpe_is, b.sharpe_oos, b.return_oos
  FROM prefix_part a JOIN prefix_part b ON a.ticker = b.ticker AND b.k = a.k + 1"""
ORACLES["walk_forward_plugin"] = pick("prefix_fold", "ticker", "fold", "train_from", "train_to", "test_from", "test_to", "~sharpe_is", "~sharpe_oos", "~return_oos")
CTES["prefix_walk"] = f"""SELECT *, CASE WHEN is_sharpe_mean <> 0 THEN (oos_sharpe - is_sharpe_mean) / abs(is_sharpe_mean) END AS degradation FROM (SELECT ticker, {_s('k > 0 AND pos >= 252 + (k - 1) * size')} AS oos_sharpe FROM prefix_bt GROUP BY ticker)
  JOIN (SELECT ticker, avg(sharpe_is) AS is_sharpe_mean FROM prefix_fold GROUP BY ticker) USING (ticker)"""
ORACLES["walk_forward_plugin_summary"] = pick("prefix_walk", "ticker", "folds=4", "~oos_sharpe", "~is_sharpe_mean", "~degradation",
                                              "reading=CASE WHEN degradation < -0.5 THEN 'COLLAPSES_OUT_OF_SAMPLE' WHEN oos_sharpe <= 0 THEN 'NO_RETURN_OUT_OF_SAMPLE' ELSE 'HOLDS_OUT_OF_SAMPLE' END")
_damage = "CASE {0} % 7 WHEN 0 THEN 'MALFORMED' WHEN 1 THEN 'NO_RECORDS' WHEN 2 THEN 'EMPTY_BODY' WHEN 3 THEN 'EMPTY_BODY' END"
ORACLES["payload_rejects"] = f"""SELECT 'filings' AS stage, o_orderpriority AS series, {_damage.format('o_custkey')} AS reason, count(*) AS rows FROM orders WHERE o_custkey % 7 < 4 GROUP BY ALL
  UNION ALL SELECT 'index', 'index', {_damage.format('y')}, count(*) FROM (SELECT DISTINCT year(month) AS y FROM cpi) WHERE y % 7 < 4 GROUP BY ALL
  UNION ALL SELECT 'issuers', 'issuers', CASE s_suppkey % 7 WHEN 0 THEN 'MALFORMED' WHEN 1 THEN 'MALFORMED' ELSE 'EMPTY_BODY' END, count(*) FROM supplier WHERE s_suppkey % 7 < 4 GROUP BY ALL"""
ORACLES["load_filings_beside_rejects"] = """SELECT o_orderpriority AS ticker, f.form AS raw_form, count(*) AS filings, count(DISTINCT o_orderkey) AS urls
  FROM orders, (VALUES ('8-K'), ('6-K')) f(form) WHERE o_custkey % 7 >= 4 AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY ALL"""
ORACLES["load_bars_bucketed"] = ORACLES["load_bars"]
_sum = lambda *columns: f"CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)})), 1, 15))::UBIGINT AS HUGEINT)) AS VARCHAR)"
_bar_hash = _sum("ticker", "d", *[f"CAST(round({c} * 10000) AS BIGINT)" for c in ("open", "high", "low", "close")], "CAST(volume AS BIGINT)")
_return_hash = _sum("ticker", "d", "CAST(round(r * 1000000) AS BIGINT)")
ORACLES["recorded_sections"] = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset_id, '{kind}' AS kind, count(*) AS rows, min(d) AS first_obs, max(d) AS last_obs, {digest} AS content_hash, '{parents}' AS parents FROM {source}"
    for name, kind, digest, parents, source in (("bars", "observed", _bar_hash, "", "bar"), ("returns", "derived", _return_hash, "bars", "ret"),
                                                ("stress", "synthetic", _bar_hash, "bars", "bar WHERE volume >= 120"), ("stress_returns", "synthetic", _return_hash, "stress,returns", "ret WHERE r < 0")))
CTES["gated"] = "SELECT 'all' AS selection, ticker, d, net FROM sized WHERE ticker NOT IN ('2-HIGH', '5-LOW')"
cscv_ctes("cvg", "gated", "selection", "ticker", "net", 8)
ORACLES["analysis_gates"] = """SELECT 'rate' AS stage, '2-HIGH' AS series, 'JUMP_AT_RATIO_CHANGE' AS reason, 1 AS rows UNION ALL SELECT 'taint', '5-LOW', 'SYNTHETIC_ANCESTOR', count(*) FROM bar WHERE ticker = '5-LOW'
  UNION ALL SELECT 'performance', ticker, 'KEPT', count(*) FROM bar WHERE ticker NOT IN ('2-HIGH', '5-LOW') GROUP BY ticker
  UNION ALL SELECT 'events', ticker, 'MEASURED', count(car) FROM result WHERE ticker NOT IN ('2-HIGH', '5-LOW', '3-MEDIUM') GROUP BY ticker
  UNION ALL SELECT 'events', '3-MEDIUM', 'MEASURED', count(car) FROM (SELECT event_date FROM occurrence WHERE ticker = '1-URGENT') e ASOF JOIN (SELECT * FROM effect WHERE ticker = '3-MEDIUM') m ON e.event_date <= m.anchor_d
  UNION ALL SELECT 'overfit', g, pbo_verdict, n_combinations FROM cvg_pbo"""

# --- what could not be computed ---------------------------------------------------------------
CTES["month_dates"] = """SELECT m, any_value(t) AS t, count(*) FILTER (have = t) AS dates FROM (SELECT m, d, count(r) AS have FROM (SELECT *, CAST(date_trunc('month', d) AS DATE) AS m FROM ret) GROUP BY m, d)
  JOIN (SELECT CAST(date_trunc('month', d) AS DATE) AS m, count(DISTINCT ticker) AS t FROM ret GROUP BY 1) USING (m) GROUP BY m"""
ORACLES["rejects"] = """SELECT 'cross_validation' AS stage, CAST(m AS VARCHAR) AS series, CASE WHEN t < 2 THEN 'FEWER_THAN_TWO_TRIALS' ELSE 'TOO_FEW_DATES' END AS reason, dates AS rows FROM month_dates WHERE t < 2 OR dates < 24
  UNION ALL SELECT 'folds', ticker || '/' || year(d), 'HISTORY_TOO_SHORT', count(*) FROM bar GROUP BY ticker, year(d) HAVING count(*) < 284
  UNION ALL SELECT 'conversion', ticker, 'NO_COMMON_DATES', 0 FROM bar WHERE ticker = '5-LOW' GROUP BY ticker
  UNION ALL SELECT 'alignment', ticker, 'OVERLAP_TOO_SHORT', count(*) FILTER (volume >= 120) FROM bar GROUP BY ticker HAVING count(*) FILTER (volume >= 120) < 20
  UNION ALL SELECT 'deflation', CAST(year(d) AS VARCHAR), 'NO_INDEX_LEVEL', 0 FROM bar WHERE year(d) NOT IN (SELECT year(b.d) FROM bar b JOIN cpi ON cpi.month = date_trunc('month', b.d) WHERE cpi.month < DATE '1997-01-01' AND level IS NOT NULL) GROUP BY year(d)"""
ORACLES["ledger_mismatches"] = pick("balance WHERE order_id % 97 = 0", "account", "order_id", "line_no", "part_id", "kind", "~cash_after", "~cash_noted=cash_after + 1")

def _needed(sql: str) -> list[str]:
    """Building blocks used by a statement, in definition order."""
    todo, found = [sql], set()
    while todo:
        for word in set(re.findall(r"[a-z_0-9]+", todo.pop())):
            if word in CTES and word not in found:
                found.add(word)
                todo.append(CTES[word])
    return [name for name in _order() if name in found]


def _order() -> list[str]:
    """Blocks sorted so that each comes after those it uses."""
    done: list[str] = []
    seen: set[str] = set()

    def visit(name: str) -> None:
        if name in seen:
            return
        seen.add(name)
        for word in re.findall(r"[a-z_0-9]+", CTES[name]):
            if word in CTES and word != name:
                visit(word)
        done.append(name)

    for name in CTES:
        visit(name)
    return done


def oracle_sql() -> dict[str, str]:
    out = {}
    for key, sql in ORACLES.items():
        blocks = _needed(sql)
        head = "WITH RECURSIVE " + ", ".join(f"{b} AS ({CTES[b]})" for b in blocks) + " " if blocks else ""
        out[key] = head + sql
    return out
