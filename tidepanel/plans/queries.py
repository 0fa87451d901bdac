"""Registry of queries over the given tables.

Each entry maps a key to ``(spark, sf_dir) -> DataFrame``.  Doubles are rounded
for output only.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidepanel.functions import dates as dt
from tidepanel.functions import numeric as nm
from tidepanel.functions import probability as pr
from tidepanel.functions import text as tx
from tidepanel.operators import backtest as bt
from tidepanel.operators import event_study as ev
from tidepanel.operators import fx
from tidepanel.operators import indicators as ind
from tidepanel.operators import inference as inf
from tidepanel.operators import ledger as lg
from tidepanel.operators import lineage as ln
from tidepanel.operators import rejects as rj
from tidepanel.operators import quality as ql
from tidepanel.operators import signals as sg
from tidepanel.operators import states as st
from tidepanel.operators import universe as un
from tidepanel.plans import analysis as an
from tidepanel.plans import panel as pn
from tidepanel.runtime import scratch_path, written
from tidepanel.sources import dimensions as dm
from tidepanel.sources import readers as rd
from tidepanel.sources import sinks as sk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def on_bars(name: str):
    """Register a function of the daily bars."""

    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(pn.bars(spark, sf_dir))
        return fn

    return register


def tidy(df: DataFrame, *columns: str, **digits: int) -> DataFrame:
    """Select columns and round the doubles (six digits unless given)."""
    out = df.select(*columns) if columns else df
    return out.select(*[nm.rnd(f"`{c}`", digits.get(c, 6)).alias(c) if t == "double" else F.col(f"`{c}`")
                        for c, t in out.dtypes])


def strategy_panel(bars: DataFrame) -> DataFrame:
    return bt.run_backtest(sg.strategy_grid(bars), dm.US_EQUITY.one_way)


# --- sources -------------------------------------------------------------------

def vendor_bars(bars: DataFrame) -> DataFrame:
    """Bars under the headers and types a vendor file has."""
    return bars.select(F.col("ticker").alias("Ticker"), F.col("d").cast("timestamp").alias("Date"),
                       *[F.col(c).alias(c.capitalize()) for c in rd.OHLCV])


@on_bars("load_bars")
def load_bars(b):
    return tidy(rd.normalise_bars(vendor_bars(b)))


@on_bars("load_prices_dividends")
def load_prices_dividends(b):
    raw = vendor_bars(b).join(pn.dividends(b).select(F.col("ticker").alias("Ticker"), F.col("d").cast("timestamp").alias("Date"),
                                                     F.col("per_share").alias("Dividends")), ["Ticker", "Date"], "left")
    prices, paid = rd.split_dividends(raw.fillna({"Dividends": 0.0}))
    rows = (prices.select("ticker", "d", F.lit("PRICE").alias("kind"), F.col("close").alias("value"))
            .unionByName(paid.select("ticker", "d", F.lit("DIVIDEND").alias("kind"), F.col("per_share").alias("value"))))
    return tidy(rows)


@on_bars("load_secondary_close")
def load_secondary_close(b):
    second = pn.secondary_close(b)
    blank = F.lit("0")
    lines = second.select("ticker", F.concat_ws(",", F.date_format("d", "yyyy-MM-dd"), blank, blank, blank,
                                                F.col("close").cast("string"), blank).alias("line"))
    headers = b.select("ticker").distinct().select(
        "ticker", F.explode(F.array(F.lit("Date,Open,High,Low,Close,Volume"), F.lit("No data"))).alias("line"))
    return tidy(rd.parse_secondary(lines.unionByName(headers)))


@query("map_symbols")
def map_symbols(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in [*tx.SECONDARY_SYMBOLS, "YPFD.BA", "UNKNOWN"]])
    c = pn.table(spark, sf_dir, "customer")
    ticker = F.element_at(names, (F.col("c_custkey") % F.size(names) + 1).cast("int"))
    return c.select("c_custkey", ticker.alias("ticker")).withColumn("secondary", tx.secondary_symbol(F.col("ticker")))


def index_payloads(spark, sf_dir):
    """One JSON body per year, as the statistics service delivers it."""
    m = pn.monthly_index(spark, sf_dir)
    pair = F.concat(F.lit('["'), F.date_format("month", "yyyy-MM-dd"), F.lit('",'), F.col("level").cast("string"), F.lit("]"))
    return (m.groupBy(F.year("month").alias("y"))
            .agg(F.concat(F.lit('{"data":['), F.array_join(F.sort_array(F.collect_list(pair)), ","), F.lit("]}")).alias("body")))


@query("load_monthly_index")
def load_monthly_index(spark, sf_dir):
    return tidy(rd.parse_monthly_index(index_payloads(spark, sf_dir)))


def filing_payloads(spark, sf_dir):
    """One feed per order: three filings as parallel arrays."""
    o = pn.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    title = (F.when(F.col("o_orderstatus") == "F", "Earnings results").when(F.col("o_orderstatus") == "O", "tender offer update")
             .otherwise(""))
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    recent = F.struct(
        F.array(F.lit("8-K"), F.lit("10-Q"), F.lit("6-K")).alias("form"),
        F.array(date, date, date).alias("filingDate"),
        F.array(*[F.concat(F.lit(f"000-{i}-"), key) for i in range(3)]).alias("accessionNumber"),
        F.array(F.lit("a.htm"), F.lit("b.htm"), F.lit("c.htm")).alias("primaryDocument"),
        F.array(title, F.lit("x"), F.lit("")).alias("items"))
    return o.select(F.col("o_orderpriority").alias("ticker"), F.col("o_custkey").alias("cik"),
                    F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("body"))


@query("load_filings")
def load_filings(spark, sf_dir):
    return rd.parse_filings(filing_payloads(spark, sf_dir), "1996-01-01")


def damaged(payloads, id_column):
    """Payloads of which some are cut off, hold no records, are blank or missing."""
    body, turn = F.col("body"), F.col(id_column) % 7
    return payloads.withColumn("body", F.when(turn == 0, F.substring("body", 1, 20)).when(turn == 1, F.lit('{"filings": {}, "other": 1}')).when(turn == 2, F.lit(" "))
                               .when(turn == 3, F.lit(None)).otherwise(body))


@query("payload_rejects")
def payload_rejects(spark, sf_dir):
    """Feeds, index payloads and issuer maps without records, and why."""
    feeds = damaged(filing_payloads(spark, sf_dir), "cik")
    index = damaged(index_payloads(spark, sf_dir), "y").withColumn("series", F.lit("index"))
    issuers = damaged(issuer_payloads(spark, sf_dir), "s_suppkey").withColumn("series", F.lit("issuers"))
    return (rd.payload_rejects(feeds, "filings").unionByName(rd.payload_rejects(index, "index", ("series",)))
            .unionByName(rd.payload_rejects(issuers, "issuers", ("series",))))


@query("load_filings_beside_rejects")
def load_filings_beside_rejects(spark, sf_dir):
    """What is left of damaged feeds: every payload that parses, and no other."""
    found = rd.parse_filings(damaged(filing_payloads(spark, sf_dir), "cik"), "1996-01-01")
    return found.groupBy("ticker", "raw_form").agg(F.count(F.lit(1)).alias("filings"), F.countDistinct("url").alias("urls"))


def issuer_payloads(spark, sf_dir):
    entry = F.to_json(F.create_map(F.lit("0"), F.struct(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ticker"),
        (F.col("s_suppkey") + 1000).cast("string").alias("cik_str"))))
    return pn.table(spark, sf_dir, "supplier").select("s_suppkey", entry.alias("body"))


@query("resolve_issuer_ids")
def resolve_issuer_ids(spark, sf_dir):
    issuers = rd.parse_issuers(issuer_payloads(spark, sf_dir))
    tickers = pn.table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string"), F.lit(".ba")).alias("ticker"))
    return rd.resolve_issuers(tickers, issuers)


def raw_manual_events(spark, sf_dir):
    o = pn.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    return o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("ticker"),
                    F.col("o_orderstatus").alias("category"), F.concat(F.lit("order "), key).alias("label"),
                    F.when(F.col("o_orderstatus") == "F", F.lit("register")).alias("source"),
                    F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("https://example.org/"), key)).otherwise("").alias("url"))


@query("load_manual_events")
def load_manual_events(spark, sf_dir):
    return rd.manual_events(raw_manual_events(spark, sf_dir))


@query("manual_event_rejects")
def manual_event_rejects(spark, sf_dir):
    return rd.manual_event_rejects(raw_manual_events(spark, sf_dir)).select("ticker", "label", "missing")


def _letters(c):
    return F.translate(c, "0123456789", "ABCDEFGHIJ")


def raw_holdings(spark, sf_dir):
    s = pn.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit(" "), F.lower(_letters(F.substring("s_name", 10, 9))), F.lit(" ")).alias("Holding Ticker"),
        F.col("s_suppkey").alias("line"))
    n = pn.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("Holding Ticker"), (-F.col("n_nationkey") - 1).cast("long").alias("line"))
    return s.unionByName(n)


def holdings(spark, sf_dir):
    return rd.normalise_holdings(raw_holdings(spark, sf_dir), order="line")


def market_caps(spark, sf_dir):
    """Capitalisation by symbol; a negative balance stands for "not available"."""
    return pn.table(spark, sf_dir, "supplier").select(
        _letters(F.substring("s_name", 10, 9)).alias("symbol"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("cap"))


@query("load_holdings")
def load_holdings(spark, sf_dir):
    return holdings(spark, sf_dir)


@query("cost_model_dim")
def cost_model_dim(spark, sf_dir):
    t = pn.table(spark, sf_dir, "supplier").select(F.concat(
        F.col("s_name"), F.when(F.col("s_nationkey") < 5, ".BA").otherwise("")).alias("ticker"))
    return tidy(dm.with_costs(t))


# --- projections and gates -------------------------------------------------------

@on_bars("log_returns")
def log_returns(b):
    return tidy(ind.log_returns(b))


@on_bars("simple_returns")
def simple_returns(b):
    return tidy(ind.simple_returns(b, keep_first=True), "ticker", "d", "r")


@on_bars("drop_null_prices")
def drop_null_prices(b):
    holes = b.withColumn("close", F.when(F.col("volume") < 100, F.lit(float("nan"))).otherwise(F.col("close")))
    return tidy(ind.simple_returns(rd.drop_null_prices(holes), keep_first=True), "ticker", "d", "close", "r")


@query("min_history_gate")
def min_history_gate(spark, sf_dir):
    return rd.history_gate(pn.supplier_series(spark, sf_dir), 260, ("regime", "ticker"))


@query("warmup_window")
def warmup_window(spark, sf_dir):
    items = pn.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").alias("d"), "l_quantity")
    return tidy(rd.in_window(items, "2000-06-30").groupBy("ticker").agg(
        F.min(F.to_date("d")).alias("first_d"), F.max(F.to_date("d")).alias("last_d"),
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("volume")))


@on_bars("clip_weight")
def clip_weight(b):
    w = sg.vol_target_weight(b, target=0.5)
    return tidy(w.withColumn("clipped", nm.clip("weight", 0.3, 0.9)), "ticker", "d", "clipped")


def _ratio_history(b: DataFrame) -> DataFrame:
    """The split of every share: 1:1 from 1990, 10:1 from 1998."""
    changes = F.array(F.struct(F.lit("1990-01-01").cast("date").alias("valid_from"), F.lit(1.0).alias("ratio")),
                      F.struct(F.lit("1998-01-01").cast("date").alias("valid_from"), F.lit(10.0).alias("ratio")))
    return b.select("ticker").distinct().select("ticker", F.inline(changes))


def _pair(b: DataFrame, local: str):
    s = pn.share_pairs(b)
    return s.select("ticker", "d", F.col(local).alias("local")), s.select("ticker", "d", "adr")


def _rates(b: DataFrame, local: str = "local_adj", adjusted: bool = True) -> DataFrame:
    left, right = _pair(b, local)
    return fx.implied_rate(left, right, _ratio_history(b), adjusted)


@on_bars("to_usd")
def to_usd(b):
    local = pn.share_pairs(b).select("ticker", "d", F.col("local_adj").alias("close"))
    return tidy(fx.to_foreign(local, _rates(b)), "ticker", "d", "close")


@on_bars("ohlcv_to_usd")
def ohlcv_to_usd(b):
    return tidy(fx.to_foreign(b, _rates(b), ("open", "high", "low", "close")), open=10, high=10, low=10, close=10)


# --- joins --------------------------------------------------------------------------

@on_bars("align_inner")
def align_inner(b):
    other = b.filter("volume >= 120").select("ticker", "d", F.col("close").alias("other"))
    return tidy(ql.align_inner(b.select("ticker", "d", "close"), other, min_overlap=20))


@on_bars("align_left")
def align_left(b):
    return tidy(ev.asset_and_market(b, pn.market_returns(b.filter("volume >= 120"))))


@on_bars("ratio_asof")
def ratio_asof(b):
    return tidy(fx.ratio_asof(b.select("ticker", "d"), _ratio_history(b)))


@on_bars("ratio_latest")
def ratio_latest(b):
    return tidy(_rates(b), "ticker", "d", "rate")


@query("event_anchor")
def event_anchor(spark, sf_dir):
    b = pn.bars(spark, sf_dir)
    return ev.event_anchors(pn.corporate_events(spark, sf_dir), b)


def _returns(spark, sf_dir):
    b = pn.bars(spark, sf_dir)
    return ev.asset_and_market(b, pn.market_returns(b))


@query("event_windows")
def event_windows(spark, sf_dir):
    return tidy(ev.event_abnormal(pn.corporate_events(spark, sf_dir), _returns(spark, sf_dir)))


@query("deflate")
def deflate(spark, sf_dir):
    b = pn.bars(spark, sf_dir).select("ticker", "d", "close")
    return tidy(fx.deflate(b, pn.monthly_index(spark, sf_dir)), "ticker", "d", "real")


@on_bars("rebalance_snap")
def rebalance_snap(b):
    return bt.rebalance_rows(b).filter("is_rebalance").select("ticker", "d")


@on_bars("dividend_cashflows")
def dividend_cashflows(b):
    # A purchase of 100 shares on the first row of 1996, another 50 two years later.
    first = F.lag(F.year("d")).over(nm.by_series())
    jump = (F.year("d") != first)
    shares = (F.when(jump & (F.year("d") == 1996), 100.0).when(jump & (F.year("d") == 1998), 150.0))
    return tidy(lg.dividend_cashflows(b.select("ticker", "d", shares.alias("shares")), pn.dividends(b)))


def _covered(spark, sf_dir):
    return lg.covered_trades(pn.ledger_trades(spark, sf_dir))


@query("fifo_match")
def fifo_match(spark, sf_dir):
    return tidy(lg.fifo_match(_covered(spark, sf_dir)), lot_price=8)


@on_bars("cscv_split")
def cscv_split(b):
    return tidy(inf.cscv_blocks(strategy_panel(b), ["ticker"]), "ticker", "strategy", "block", "n", "s1", "s2")


@on_bars("bootstrap_gather")
def bootstrap_gather(b):
    reps = inf.bootstrap_replicates(strategy_panel(b))
    return tidy(reps, "ticker", "strategy", "b", "sum_r", "sum_r2")


@query("unranked_symbols")
def unranked_symbols(spark, sf_dir):
    return un.unranked_symbols(holdings(spark, sf_dir), market_caps(spark, sf_dir)).select("symbol")


@on_bars("strategy_grid")
def strategy_grid(b):
    return tidy(sg.strategy_grid(b), "ticker", "d", "strategy", "flag")


@on_bars("vs_buy_and_hold")
def vs_buy_and_hold(b):
    return tidy(bt.versus_passive(bt.strategy_summary(strategy_panel(b))))


# --- aggregations -----------------------------------------------------------------------

@on_bars("sharpe")
def sharpe(b):
    return tidy(strategy_panel(b).groupBy("ticker", "strategy").agg(
        inf.sharpe_agg("net").alias("sharpe"), inf.sharpe_agg("net", 0.03).alias("sharpe_over_3pct")))


@on_bars("moments")
def moments(b):
    return tidy(strategy_panel(b).groupBy("ticker", "strategy").agg(*inf.moment_aggs()),
                "ticker", "strategy", "observations", "skew", "kurt")


def _assessed(b, trials=3):
    return inf.sharpe_assessment(strategy_panel(b), trials)


@on_bars("psr")
def psr(b):
    return tidy(_assessed(b), "ticker", "strategy", "psr")


@on_bars("expected_max_sharpe")
def expected_max_sharpe(b):
    moments = strategy_panel(b).groupBy("ticker", "strategy").agg(*inf.moment_aggs())
    many = moments.withColumn("trials", F.explode(F.array(F.lit(1), F.lit(3), F.lit(10), F.lit(200))))
    return tidy(inf.with_expected_max(many, F.col("trials"), inf.default_variance()),
                "ticker", "strategy", "trials", "expected_max_sharpe")


@on_bars("dsr")
def dsr(b):
    p = strategy_panel(b)
    return tidy(inf.sharpe_assessment(p, 3, ("ticker",)), "ticker", "strategy", "deflated_sharpe")


@on_bars("min_trl")
def min_trl(b):
    return tidy(_assessed(b), "ticker", "strategy", "min_track_record", min_track_record=0)


@on_bars("sharpe_assessment")
def sharpe_assessment(b):
    return tidy(_assessed(b), "ticker", "strategy", "observations", "sharpe_annual", "sharpe_row", "skew", "kurt",
                "psr", "deflated_sharpe", "expected_max_sharpe", "trials", "verdict")


@on_bars("bootstrap_sharpe_ci")
def bootstrap_sharpe_ci(b):
    return tidy(inf.bootstrap_sharpe(strategy_panel(b)), "ticker", "strategy", "ci_low", "sharpe", "ci_high")


@on_bars("bootstrap_pvalue")
def bootstrap_pvalue(b):
    return tidy(inf.bootstrap_sharpe(strategy_panel(b)), "ticker", "strategy", "p_value")


@on_bars("pbo")
def pbo(b):
    """Assets as trials, eight blocks."""
    r = ind.simple_returns(b).withColumn("all_assets", F.lit("all"))
    return tidy(inf.pbo(r, ["all_assets"], "ticker", "r", 8))


@on_bars("reconcile_sources")
def reconcile_sources(b):
    return tidy(ql.reconcile(b, pn.secondary_close(b.filter("ticker <> '5-LOW'"))))


@query("caar_by_category")
def caar_by_category(spark, sf_dir):
    return tidy(ev.caar_by_category(ev.event_results(pn.corporate_events(spark, sf_dir), _returns(spark, sf_dir))))


@query("market_model")
def market_model(spark, sf_dir):
    return tidy(ev.market_model(_returns(spark, sf_dir)),
                "ticker", "d", "estimation_obs", "alpha", "beta", "r_squared", "residual_sd")


@on_bars("strategy_summary")
def strategy_summary(b):
    return tidy(bt.strategy_summary(strategy_panel(b)))


@on_bars("ccl_continuity")
def ccl_continuity(b):
    """Right and wrong treatment of the split side by side."""
    good = fx.rate_continuity(_rates(b), _ratio_history(b)).withColumn("series", F.lit("adjusted"))
    left, right = _pair(b, "local_raw")
    wrong = fx.rate_continuity(fx.implied_rate(left, right, _ratio_history(b)), _ratio_history(b))
    return tidy(good.unionByName(wrong.withColumn("series", F.lit("raw_as_adjusted"))))


@on_bars("ccl_level_gap")
def ccl_level_gap(b):
    official = pn.share_pairs(b.filter("ticker <> '5-LOW'")).select("ticker", "d", "official_rate")
    return tidy(fx.rate_level_gap(_rates(b), official))


def _bar_digest():
    prices = [F.round(F.col(c) * 10000).cast("long") for c in ("open", "high", "low", "close")]
    return [F.col("d"), *prices, F.col("volume").cast("long")]


@on_bars("series_fingerprint")
def series_fingerprint(b):
    return ln.fingerprint(b, _bar_digest())


REGIME_KEYS = ("regime", "ticker", "strategy")


def regime_summary(spark, sf_dir):
    series = pn.supplier_series(spark, sf_dir)
    keys = ("regime", "ticker")
    grid = sg.strategy_grid(series, sg.catalog(keys), keys)
    return bt.strategy_summary(bt.run_backtest(grid, dm.US_EQUITY.one_way, keys=REGIME_KEYS), REGIME_KEYS)


@query("regime_win_rates")
def regime_win_rates(spark, sf_dir):
    return tidy(bt.regime_win_rates(regime_summary(spark, sf_dir), [s.name for s in sg.catalog()]))


@query("regime_medians")
def regime_medians(spark, sf_dir):
    return tidy(bt.regime_medians(regime_summary(spark, sf_dir)))


@on_bars("best_strategy")
def best_strategy(b):
    s = bt.strategy_summary(strategy_panel(b))
    return tidy(bt.best_strategy(s).join(bt.best_strategy(s, "net_return").withColumnRenamed("best_strategy", "best_by_return"), "ticker"))


@query("ledger_totals")
def ledger_totals(spark, sf_dir):
    entries = lg.ledger_entries(pn.ledger_trades(spark, sf_dir))
    return tidy(lg.ledger_totals(lg.running_balance(entries)))


# --- windows -----------------------------------------------------------------------------

@on_bars("ts_momentum")
def ts_momentum(b):
    return tidy(b.select("ticker", "d", ind.momentum_col(nm.by_series()).alias("momentum")))


@on_bars("trend_sma")
def trend_sma(b):
    return tidy(b.select("ticker", "d", ind.trend_col(nm.by_series()).alias("trend")))


@on_bars("dist_52w_high")
def dist_52w_high(b):
    return tidy(b.select("ticker", "d", ind.high_proximity_col(nm.by_series()).alias("near_high")))


@on_bars("realized_vol")
def realized_vol(b):
    r = ind.simple_returns(b)
    return tidy(r.select("ticker", "d", ind.realized_vol_col(nm.by_series()).alias("vol")))


@on_bars("atr")
def atr(b):
    return tidy(ind.average_true_range(b), "ticker", "d", "atr", atr=4)


@on_bars("xs_momentum_rank")
def xs_momentum_rank(b):
    return tidy(ind.momentum_rank(b))


@on_bars("max_drawdown")
def max_drawdown(b):
    return tidy(ind.max_drawdown(b, "close"))


@on_bars("rolling_beta")
def rolling_beta(b):
    return tidy(ind.rolling_beta(ind.simple_returns(b), pn.market_returns(b)))


@on_bars("expanding_extremes")
def expanding_extremes(b):
    low, high = ind.extremes_cols(nm.by_series())
    low_y, high_y = ind.extremes_cols(nm.by_series(), window=252)
    return tidy(b.select("ticker", "d", low.alias("low_so_far"), high.alias("high_so_far"),
                         low_y.alias("low_year"), high_y.alias("high_year")))


@on_bars("hold_between_rebalances")
def hold_between_rebalances(b):
    return tidy(strategy_panel(b), "ticker", "strategy", "d", "held")


@on_bars("delayed_execution")
def delayed_execution(b):
    return tidy(strategy_panel(b), "ticker", "strategy", "d", "executed")


@on_bars("turnover_costs")
def turnover_costs(b):
    return tidy(strategy_panel(b), "ticker", "strategy", "d", "turnover", "cost")


@on_bars("equity_curve")
def equity_curve(b):
    return tidy(strategy_panel(b), "ticker", "strategy", "d", "net", "equity")


@on_bars("mean_reversion_state")
def mean_reversion_state(b):
    return tidy(st.mean_reversion(b), "ticker", "d", "position")


@on_bars("atr_stop")
def atr_stop(b):
    """The stop under an always-on flag."""
    return tidy(st.atr_stop(b.withColumn("flag", F.lit(1.0))), "ticker", "d", "position")


def coarse(b: DataFrame) -> DataFrame:
    """Closes on a coarse tick, so that unchanged runs occur."""
    return b.withColumn("close", F.round(F.col("close") / 3000) * 3000)


@on_bars("frozen_price_runs")
def frozen_price_runs(b):
    return tidy(st.frozen_runs(coarse(b)))


@query("duplicate_dates")
def duplicate_dates(spark, sf_dir):
    return ql.duplicate_dates(pn.trades(spark, sf_dir))


@on_bars("latest_signal")
def latest_signal(b):
    return tidy(sg.latest_signal(sg.build_signals(b)))


@on_bars("first_signal_date")
def first_signal_date(b):
    return lg.first_signal_date(b)


@on_bars("best_buy_then_sell")
def best_buy_then_sell(b):
    return tidy(lg.best_buy_then_sell(b), final_value=4, shares_bought=4, capital=4)


@on_bars("next_day_execution_price")
def next_day_execution_price(b):
    return tidy(lg.next_day_execution(b))


@query("ledger_running_balance")
def ledger_running_balance(spark, sf_dir):
    out = lg.running_balance(lg.ledger_entries(pn.ledger_trades(spark, sf_dir)))
    return tidy(out, "account", "d", "order_id", "line_no", "part_id", "kind", "net", "shares_after", "cash_after")


# --- top-k and sorting -----------------------------------------------------------------

@query("top_n_by_market_cap")
def top_n_by_market_cap(spark, sf_dir):
    return tidy(un.top_by_cap(holdings(spark, sf_dir), market_caps(spark, sf_dir), 10), "symbol", "cap")


@query("universe_resolution")
def universe_resolution(spark, sf_dir):
    return tidy(un.resolve_universe(holdings(spark, sf_dir), market_caps(spark, sf_dir), 10))


@query("events_recent_30")
def events_recent_30(spark, sf_dir):
    return ev.recent_events(pn.corporate_events(spark, sf_dir), 30)


@on_bars("head_tail_k")
def head_tail_k(b):
    """Five rows on each side of every ratio change."""
    near = fx.rows_around(b.select("ticker", "d", "close"), _ratio_history(b))
    return tidy(near, "ticker", "valid_from", "after", "k", "d", "close")


@query("sort_by_date")
def sort_by_date(spark, sf_dir):
    return pn.corporate_events(spark, sf_dir).orderBy("event_date", "event_id")


# --- set operations -----------------------------------------------------------------------

@on_bars("union_oos")
def union_oos(b):
    return tidy(bt.out_of_sample(strategy_panel(b)), "ticker", "strategy", "d", "net")


@on_bars("intersect_dates")
def intersect_dates(b):
    return ql.common_dates(b.filter("volume < 150"), b.filter("close > open"))


@on_bars("complement_blocks")
def complement_blocks(b):
    """Out-of-sample sums of every split: blocks that are not in-sample."""
    blocks = inf.cscv_blocks(strategy_panel(b), ["ticker"], n_splits=6)
    outside = F.broadcast(inf.split_table(b.sparkSession, 6).filter("NOT in_sample").drop("in_sample"))  # 60 rows
    return tidy(blocks.join(outside, "block").groupBy("ticker", "strategy", "combo").agg(
        F.sum("n").alias("n"), F.sum("s1").alias("sum_r")))


def lineage_nodes(spark, sf_dir):
    """Datasets of the tables: an order derives from its customer, a customer
    and a supplier from their nation, a nation from its region."""

    def node(table, prefix, key, parent_prefix=None, parent=None, kind=F.lit(ln.DERIVED)):
        t = pn.table(spark, sf_dir, table)
        up = F.array(F.concat(F.lit(f"{parent_prefix}:"), F.col(parent).cast("string"))) if parent else F.array().cast("array<string>")
        return t.select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("dataset_id"), kind.alias("kind"), up.alias("parents"))

    synthetic = F.when(F.col("c_acctbal") < 0, ln.SYNTHETIC).otherwise(ln.DERIVED)
    return (node("orders", "order", "o_orderkey", "customer", "o_custkey")
            .unionByName(node("customer", "customer", "c_custkey", "nation", "c_nationkey", synthetic))
            .unionByName(node("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"))
            .unionByName(node("nation", "nation", "n_nationkey", "region", "n_regionkey"))
            .unionByName(node("region", "region", "r_regionkey", kind=F.lit(ln.OBSERVED))))


@query("lineage_union")
def lineage_union(spark, sf_dir):
    """Ancestors of every nation, through its customers and through its suppliers."""
    closure = ln.ancestors(ln.edges_of(lineage_nodes(spark, sf_dir)))
    via = lambda kind: closure.filter(F.col("dataset_id").startswith(kind)).select(
        F.lit("book").alias("dataset_id"), "ancestor")
    return ln.merge_lineages(via("customer:"), via("supplier:"))


def dirty(b: DataFrame) -> DataFrame:
    """Bars with an unadjusted split, sign errors and repeated dates."""
    quarter = F.trunc("d", "quarter")
    first = F.coalesce(F.lag(quarter).over(nm.by_series()) != quarter, F.lit(True))
    base = (coarse(b).withColumn("_first", first)
            .withColumn("close", F.when(F.col("d") >= F.lit("1998-01-01").cast("date"), F.col("close") * 10).otherwise(F.col("close")))
            .withColumn("close", F.when(F.col("_first") & (F.month("d") == 1), -F.col("close")).otherwise(F.col("close"))))
    return base.unionByName(base.filter(F.col("_first") & (F.month("d") == 7))).select("ticker", "d", "close")


@on_bars("anomaly_union")
def anomaly_union(b):
    return ql.data_anomalies(dirty(b)).groupBy("ticker", "kind").agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions in use --------------------------------------------------------------

@on_bars("scalar_functions")
def scalar_functions(b):
    c, o = F.col("close"), F.col("open")
    return tidy(b.select("ticker", "d", F.ln(c).alias("ln_close"), F.exp(nm.ratio(c, o) - 1).alias("exp_r"), F.sqrt(c).alias("root"),
                         F.abs(c - o).alias("move"), F.greatest("open", "close").alias("top"), F.least("open", "close").alias("bottom"),
                         nm.clip(nm.ratio(c, o), 0.99, 1.01).alias("clamped"), nm.ratio(c, c - c).alias("undefined")))


@query("date_functions")
def date_functions(spark, sf_dir):
    o = pn.table(spark, sf_dir, "orders")
    d = dt.parse_day(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", d.alias("d"), dt.month_start("o_orderdate").alias("month_start"), F.year(d).alias("y"), dt.is_year_end(d).alias("year_end"),
                    dt.days_since(d, "1995-01-01").alias("days"), bt.rebalance_bucket("W-FRI", d).alias("week"))


@query("classify_filing")
def classify_filing(spark, sf_dir):
    """Whole texts as titles, under three forms."""
    forms = F.explode(F.array(F.lit(" 6-k "), F.lit("10-Q"), F.lit("NT 10-K")))
    d = pn.table(spark, sf_dir, "documents").select("doc_id", "text", tx.keyword_category(F.col("text")).alias("by_title"))
    d = d.select("*", forms.alias("form"))
    return d.select("doc_id", "form", tx.classify_filing(F.col("form"), F.col("text"), by_title=F.col("by_title")).alias("category"))


@query("string_functions")
def string_functions(spark, sf_dir):
    s = pn.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit(" "), F.col("s_name"), F.lit(".ba ")).alias("raw"))
    name = F.trim("raw")
    return s.select("s_suppkey", F.upper(name).alias("upper_name"), tx.root_symbol(name).alias("root"),
                    F.replace(name, F.lit("#"), F.lit("")).alias("joined"), F.upper(name).endswith(".BA").alias("is_local"),
                    tx.clean_symbol(F.col("raw")).alias("alphabetic"))


@query("json_functions")
def json_functions(spark, sf_dir):
    e = pn.table(spark, sf_dir, "events").withColumn("p", rd.once(F.from_json("props", "map<string, string>")))
    return e.select("event_id", F.explode("p").alias("name", "value")).withColumn("value", F.col("value").try_cast("bigint"))


@on_bars("array_functions")
def array_functions(b):
    """Positions of a three-row window that wraps around its year."""
    y = b.groupBy("ticker", F.year("d").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.max(F.dayofyear("d")).alias("last"))
    return y.select("ticker", "y", F.posexplode(inf.wrapped_positions(F.col("last"), 3, F.col("n"))).alias("k", "position"))


@on_bars("verdicts")
def verdicts(b):
    p = written(strategy_panel(b), "panel")  # three results read it
    a = inf.sharpe_assessment(p, 3).withColumn("track_record", inf.track_record_verdict())
    _, walk = bt.walk_forward(p)
    over = inf.pbo(p, ["ticker"]).select("ticker", "pbo_verdict")
    return (a.select("ticker", "strategy", "verdict", "track_record")
            .join(walk.select("ticker", "strategy", "reading"), ["ticker", "strategy"], "left").join(over, "ticker", "left"))


@on_bars("norm_cdf")
def norm_cdf(b):
    z = Window.partitionBy("ticker")
    r = ind.log_returns(b).withColumn("z", F.col("log_r") / F.stddev_samp("log_r").over(z) * 3)
    return tidy(r.select("ticker", "d", pr.norm_cdf("z").alias("p")))


@on_bars("norm_ppf")
def norm_ppf(b):
    w = Window.partitionBy("ticker")
    r = b.withColumn("p", F.row_number().over(nm.by_series()) / (F.count(F.lit(1)).over(w) + 1))
    return tidy(r.select("ticker", "d", pr.norm_ppf("p").alias("z")))


@on_bars("t_pvalue")
def t_pvalue(b):
    """Mean return of every series and month against zero."""
    r = ind.simple_returns(b)
    m = r.groupBy("ticker", F.to_date(F.trunc("d", "MM")).alias("month")).agg(
        F.count("r").alias("n"), (F.avg("r") / F.stddev_samp("r") * F.sqrt(F.count("r"))).alias("t"))
    m = m.withColumn("df", F.col("n") - 1)
    return tidy(m.select("ticker", "month", "df", pr.t_two_sided("t", "df").alias("p")))


@query("tax_rules")
def tax_rules(spark, sf_dir):
    c = pn.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("amount"))
    t = c.crossJoin(F.broadcast(dm.tax_models(spark)))  # four regimes
    a = F.col("amount")
    return tidy(t.select("c_custkey", "regime", lg.sale_tax(a, F.col("capital_gains_rate")).alias("sale_tax"),
                         lg.dividend_net(F.abs(a), F.col("dividend_withholding_rate"), F.col("dividend_local_rate")).alias("dividend_net"),
                         lg.holding_tax(a, F.col("wealth_tax_rate")).alias("holding_tax")))


@query("liquidation_value")
def liquidation_value(spark, sf_dir):
    u = lg.unrealized_gains(_covered(spark, sf_dir))
    value = F.col("open_qty") * F.col("last_price")
    return tidy(u.withColumn("value", value).withColumn("value_if_sold", lg.liquidation_value(value, F.col("unrealized_gain"), F.lit(0.15))),
                "account", "open_qty", "open_cost", "last_price", "unrealized_gain", "value", "value_if_sold",
                last_price=8, open_cost=4, unrealized_gain=4, value=4, value_if_sold=4)


# --- plug-ins ---------------------------------------------------------------------------------

@on_bars("strategy_plugin")
def strategy_plugin(b):
    """A user strategy: invested while the close is above its 50-row mean."""
    mine = sg.Strategy("above_50", lambda df: df.withColumn("flag", ind.trend_col(nm.by_series(), window=50)))
    p = bt.run_backtest(sg.strategy_grid(b, [mine]), dm.US_EQUITY.one_way)
    return tidy(bt.strategy_summary(p), "ticker", "strategy", "trades", "net_return", "time_in_market")


@on_bars("vote_labels")
def vote_labels(b):
    s = sg.build_signals(b)
    return s.select("ticker", "d", sg.vote_label("vote_momentum").alias("momentum_vote"),
                    sg.vote_label("vote_trend").alias("trend_vote"), sg.vote_label("vote_high").alias("high_vote"))


@on_bars("strategy_catalog")
def strategy_catalog(b):
    n = len(sg.catalog())
    return (sg.strategy_grid(b).groupBy("strategy").agg(F.count("flag").alias("defined_rows"), F.sum("flag").cast("bigint").alias("invested_rows"))
            .withColumn("n_trials", F.lit(n)))


# --- composite operators -------------------------------------------------------------------------

@on_bars("signals")
def signals(b):
    return tidy(sg.build_signals(b), "ticker", "d", "momentum", "trend", "near_high", "score", "flag")


@on_bars("vol_target_weight")
def vol_target_weight(b):
    return tidy(sg.vol_target_weight(b), "ticker", "d", "vol", "weight")


@on_bars("mean_reversion")
def mean_reversion(b):
    """Rolling one-year extremes instead of all history."""
    return tidy(st.mean_reversion(b, window=252), "ticker", "d", "low_so_far", "high_so_far", "position")


@on_bars("stop_loss")
def stop_loss(b):
    return tidy(st.atr_stop(sg.build_signals(b)), "ticker", "d", "flag", "position")


@on_bars("backtest")
def backtest(b):
    """Stop, volatility sizing, market costs and weekly rebalancing together."""
    s = sg.vol_target_weight(st.atr_stop(sg.build_signals(b)))
    s = dm.with_costs(s.drop("flag").withColumnRenamed("position", "flag"))
    p = bt.run_backtest(s, F.col("one_way"), weight="weight", keys=("ticker",))
    return tidy(p, "ticker", "d", "executed", "turnover", "cost", "gross", "net", "equity")


@on_bars("momentum_trend")
def momentum_trend(b):
    return tidy(bt.strategy_summary(strategy_panel(b)).filter("strategy = 'momentum_trend'"),
                "ticker", "trades", "total_costs", "net_return", "sharpe", "max_drawdown")


@on_bars("buy_and_hold")
def buy_and_hold(b):
    return tidy(bt.strategy_summary(strategy_panel(b)).filter("strategy = 'buy_and_hold'"),
                "ticker", "trades", "net_return", "benchmark_return", "sharpe", "max_drawdown")


@on_bars("walk_forward")
def walk_forward(b):
    folds, _ = bt.walk_forward(strategy_panel(b))
    return tidy(folds)


@on_bars("walk_forward_summary")
def walk_forward_summary(b):
    _, summary = bt.walk_forward(strategy_panel(b))
    return tidy(summary)


@on_bars("walk_forward_plugin")
def walk_forward_plugin(b):
    """A builder that looks ahead: invested above the mean of all the history it is given."""
    mean = F.avg("close").over(Window.partitionBy("ticker"))
    folds, _ = bt.walk_forward_builder(b, lambda df: df.withColumn("flag", (F.col("close") > mean).cast("double")), dm.US_EQUITY.one_way)
    return tidy(folds)


@on_bars("walk_forward_plugin_summary")
def walk_forward_plugin_summary(b):
    mean = F.avg("close").over(Window.partitionBy("ticker"))
    _, summary = bt.walk_forward_builder(b, lambda df: df.withColumn("flag", (F.col("close") > mean).cast("double")), dm.US_EQUITY.one_way)
    return tidy(summary)


@on_bars("stationary_bootstrap")
def stationary_bootstrap(b):
    """Shape and sum of every replicate of the asset returns."""
    reps = inf.bootstrap_replicates(ind.simple_returns(b), ("ticker",), "r")
    return tidy(reps, "ticker", "b", "blocks", "rows_drawn", "sum_r")


@on_bars("cscv")
def cscv(b):
    return tidy(inf.pbo_logits(strategy_panel(b), ["ticker"]), "ticker", "winner", "rank", "omega", "logit")


@query("event_study")
def event_study(spark, sf_dir):
    out = ev.event_results(pn.corporate_events(spark, sf_dir), _returns(spark, sf_dir))
    return tidy(out, "event_id", "ticker", "event_date", "category", "anchor_d", "estimation_obs", "beta", "car", "car_t", "car_p", "skipped")


@on_bars("data_anomalies")
def data_anomalies(b):
    return tidy(ql.data_anomalies(dirty(b)))


@on_bars("implied_fx")
def implied_fx(b):
    """Raw prices with the ratio in force on each date."""
    return tidy(_rates(b, "local_raw", adjusted=False))


@query("lineage")
def lineage(spark, sf_dir):
    return ln.ancestors(ln.edges_of(lineage_nodes(spark, sf_dir)))


@query("contamination_gate")
def contamination_gate(spark, sf_dir):
    """Orders that must not be reported."""
    nodes = lineage_nodes(spark, sf_dir)
    bad = ln.tainted(nodes, ln.edges_of(nodes))
    return bad.filter(F.col("dataset_id").startswith("order:"))


@on_bars("compare_strategies")
def compare_strategies(b):
    out = an.compare_strategies(b)
    return tidy(out, "ticker", "strategy", "n_rows", "trades", "net_return", "sharpe_annual", "max_drawdown", "deflated_sharpe",
                "ci_low", "ci_high", "p_value", "oos_sharpe", "degradation", "pbo", "never_traded", "ci_includes_zero", "verdict")


@on_bars("comparison_verdict")
def comparison_verdict(b):
    return tidy(an.comparison_verdict(an.compare_strategies(b)))


@query("analyze_panel")
def analyze_panel(spark, sf_dir):
    b = written(pn.bars(spark, sf_dir), "bars")  # every section and the market read them
    sections = an.analyze_panel(b, pn.market_returns(b), pn.corporate_events(spark, sf_dir),
                                secondary=pn.secondary_close(b.filter("ticker <> '5-LOW'")))
    return tidy(an.analysis_overview(sections))


@query("realized_gains")
def realized_gains(spark, sf_dir):
    covered = _covered(spark, sf_dir)
    out = lg.realized_gains(covered, lg.fifo_match(covered), 0.15)
    return tidy(out, "account", "seq", "d", "qty", "price", "matched_qty", "cost_basis", "gain", "tax",
                price=8, cost_basis=8, gain=8, tax=10)


@query("oversold_accounts")
def oversold_accounts(spark, sf_dir):
    return tidy(lg.oversold_accounts(_covered(spark, sf_dir)))


@on_bars("hold_account_statement")
def hold_account_statement(b):
    return tidy(lg.hold_statement(b, pn.dividends(b), dm.tax_models(b.sparkSession), since=lg.first_signal_date(b)))


@on_bars("hold_account_chronological")
def hold_account_chronological(b):
    out = lg.hold_statement(b, pn.dividends(b), dm.tax_models(b.sparkSession), since=lg.first_signal_date(b), chronological=True)
    return tidy(out, "ticker", "regime", "final_cash", "final_value")


@on_bars("cooldown_filter")
def cooldown_filter(b):
    return st.cooldown(lg.zone_signals(b).filter("near_low OR near_high"), 21)


@on_bars("zone_signals")
def zone_signals(b):
    return tidy(lg.zone_signals(b), "ticker", "d", "execution_d", "execution_price", "near_low", "near_high")


# --- sinks ------------------------------------------------------------------------------------------

@query("write_lineage")
def write_lineage(spark, sf_dir):
    """Write the supplier lineage and read it back."""
    nodes = lineage_nodes(spark, sf_dir)
    path = scratch_path(spark, "lineage")
    sk.write_lineage(ln.ancestors(ln.edges_of(nodes)), nodes, path)
    return spark.read.schema("dataset_id string, ancestor string, depth int, kind string").json(path)


@query("write_results")
def write_results(spark, sf_dir):
    """Write two report sections and read the scoreboard back."""
    b = pn.bars(spark, sf_dir)
    path = scratch_path(spark, "results")
    sk.write_results({"signals": sg.latest_signal(sg.build_signals(b)), "performance": bt.strategy_summary(strategy_panel(b))}, path)
    return tidy(spark.read.parquet(f"{path}/performance"), "ticker", "strategy", "trades", "net_return", "sharpe")


@query("load_bars_bucketed")
def load_bars_bucketed(spark, sf_dir):
    """Bars written as a table in buckets of series, and read from it."""
    table = f"bars_{uuid.uuid4().hex}"
    sk.write_bucketed(pn.bars(spark, sf_dir), table)
    return tidy(rd.read_bucketed(spark, table), "ticker", "d", *rd.OHLCV)


@query("recorded_sections")
def recorded_sections(spark, sf_dir):
    """Birth certificates of sections, taken while they are written; what derives from a synthetic one is synthetic."""
    b = written(pn.bars(spark, sf_dir), "bars")
    returns = ind.simple_returns(b)
    micro = F.round(F.col("r") * 1_000_000).cast("long")
    records = sk.write_recorded({
        "bars": sk.Section(b, [F.col("ticker"), *_bar_digest()], kind=ln.OBSERVED),
        "returns": sk.Section(returns, [F.col("ticker"), F.col("d"), micro], ["bars"]),
        "stress": sk.Section(b.filter("volume >= 120"), [F.col("ticker"), *_bar_digest()], ["bars"], ln.SYNTHETIC),
        "stress_returns": sk.Section(returns.filter("r < 0"), [F.col("ticker"), F.col("d"), micro], ["stress", "returns"]),
    }, scratch_path(spark, "sections"))
    kinds = ln.derived_kind(records, ln.edges_of(records))
    return kinds.select("dataset_id", "kind", "rows", "first_obs", "last_obs", "content_hash", F.array_join("parents", ",").alias("parents"))


# --- what could not be computed ---------------------------------------------------------------

@query("analysis_gates")
def analysis_gates(spark, sf_dir):
    """A whole run in which one series has a split on one side only, one is synthetic, and one takes another one's events."""
    b = written(pn.bars(spark, sf_dir), "bars")  # the gates, every section and the market read them
    wrong = fx.implied_rate(*_pair(b.filter("ticker = '2-HIGH'"), "local_raw"), _ratio_history(b))
    rates = _rates(b).filter("ticker <> '2-HIGH'").unionByName(wrong)
    tickers = b.select("ticker").distinct()
    edges = tickers.select(F.col("ticker").alias("child"), F.concat(F.lit("vendor of "), "ticker").alias("parent"))
    nodes = edges.select(F.col("parent").alias("dataset_id"), F.when(F.col("child") == "5-LOW", ln.SYNTHETIC).otherwise(ln.OBSERVED).alias("kind"))
    issuers = tickers.filter("ticker = '3-MEDIUM'").select("ticker", F.lit("1-URGENT").alias("issuer_ticker"))
    sections = an.analyze_panel(b, pn.market_returns(b), pn.corporate_events(spark, sf_dir),
                                gates=an.Gates(rates=rates, ratio_history=_ratio_history(b), nodes=nodes, edges=edges, issuers=issuers))
    line = lambda df, stage, series, reason, rows: df.select(F.lit(stage).alias("stage"), series.alias("series"), reason.alias("reason"), rows.cast("long").alias("rows"))
    measured = sections["events"].groupBy("ticker").agg(F.count("car").alias("n"))
    return (sections["rejects"]
            .unionByName(line(sections["performance"], "performance", F.col("ticker"), F.lit("KEPT"), F.col("n_rows")))
            .unionByName(line(measured.filter("n > 0"), "events", F.col("ticker"), F.lit("MEASURED"), F.col("n")))
            .unionByName(line(sections["overfit"], "overfit", F.col("selection"), F.col("pbo_verdict"), F.col("n_combinations"))))


@query("rejects")
def rejects(spark, sf_dir):
    """Months and years that are too short, series without a rate or a partner."""
    b = pn.bars(spark, sf_dir)
    monthly = ind.simple_returns(b).withColumn("m", F.to_date(F.trunc("d", "MM")))
    yearly = b.withColumn("y", F.year("d"))
    index = pn.monthly_index(spark, sf_dir).filter("month < DATE'1997-01-01'")
    rates = b.filter("ticker <> '5-LOW'").select("ticker", "d", F.col("close").alias("rate"))
    return (rj.cross_validation_rejects(monthly, ["m"], "ticker", "r", 12)
            .unionByName(rj.fold_rejects(yearly, 4, 200, ["ticker", "y"]))
            .unionByName(rj.conversion_rejects(b, rates))
            .unionByName(rj.alignment_rejects(b, b.filter("volume >= 120")))
            .unionByName(rj.deflation_rejects(yearly, index, ["y"])))


@query("ledger_mismatches")
def ledger_mismatches(spark, sf_dir):
    """Recorded balances, of which some are off by one, against the rebuilt ones."""
    out = lg.running_balance(lg.ledger_entries(pn.ledger_trades(spark, sf_dir)))
    noted = out.withColumn("cash_noted", F.col("cash_after") + (F.col("order_id") % 97 == 0).cast("double"))
    return tidy(lg.ledger_mismatches(noted, "cash_noted", "shares_after"),
                "account", "order_id", "line_no", "part_id", "kind", "cash_after", "cash_noted")
