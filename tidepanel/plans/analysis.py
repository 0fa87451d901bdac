"""Whole jobs: the per-series analysis and the strategy comparison.

The daily strategy panel feeds half a dozen results, so it is checkpointed once
and every branch reads that copy.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from tidepanel.operators import backtest as bt
from tidepanel.operators import event_study as ev
from tidepanel.operators import fx
from tidepanel.operators import inference as inf
from tidepanel.operators import lineage as ln
from tidepanel.operators import quality as ql
from tidepanel.operators import rejects as rj
from tidepanel.operators import signals as sg
from tidepanel.operators.states import atr_stop
from tidepanel.runtime import materialise, written
from tidepanel.sources import dimensions as dm
from tidepanel.sources.readers import accepted_only, drop_null_prices, history_gate


@dataclass(frozen=True)
class AnalysisParams:
    trials: int = 1
    target_vol: float = 0.15
    atr_multiple: float = 3.0
    rebalance: str = "W-FRI"
    folds: int = 4
    min_rows: int = 260
    one_way_cost: float | None = None  # None: by market
    replicates: int = 2000
    signals: sg.SignalParams = field(default_factory=sg.SignalParams)
    events: ev.EventParams = field(default_factory=ev.EventParams)


def compare_strategies(panel: DataFrame, strategies: Sequence[sg.Strategy] | None = None,
                       params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """Every strategy on every series under the same costs and the same tests.

    The trial count of the deflated Sharpe is the number of strategies.  Passive
    strategies have no walk-forward result.
    """
    chosen = strategies if strategies is not None else sg.catalog()
    grid = sg.strategy_grid(drop_null_prices(panel), chosen)
    daily = materialise(bt.run_backtest(grid, dm.US_EQUITY.one_way if params.one_way_cost is None else params.one_way_cost, params.rebalance)
                        .select("ticker", "strategy", "passive", "d", "executed", "turnover", "cost",
                                "gross", "net", "equity", "bench_equity", "asset_r"))
    keys = ["ticker", "strategy"]
    summary = bt.strategy_summary(daily).drop("sharpe")
    tests = inf.sharpe_assessment(daily, trials=len(chosen)).drop("trials", "sharpe_row", "skew", "kurt")
    bands = inf.bootstrap_sharpe(daily, replicates=params.replicates).drop("observations", "sharpe")
    _, folds = bt.walk_forward(daily.filter(~F.col("passive")), params.folds)
    overfit = inf.pbo(daily, ["ticker"], n_splits=8)
    out = (summary.join(tests, keys).join(bands, keys)
           .join(folds.select(*keys, "oos_sharpe", "degradation", "reading"), keys, "left")
           .join(overfit, "ticker", "left"))
    return (out.withColumn("never_traded", F.col("time_in_market") == 0)
            .withColumn("ci_includes_zero", inf.interval_includes_zero()))


def comparison_verdict(comparison: DataFrame, passive: str = "buy_and_hold") -> DataFrame:
    """One row per series: who survives, the best active strategy, and warnings.  Of
    strategies with equal returns the first of the catalogue is the best."""
    active = F.col("strategy") != passive
    names = [s.name for s in sg.catalog()]
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in names]), F.col("strategy")), F.lit(0)), F.lit(len(names) + 1))
    rank = F.struct(F.col("net_return").alias("r"), (-place).alias("p"), F.col("strategy").alias("s"))
    agg = comparison.groupBy("ticker").agg(
        F.count_if(F.col("deflated_sharpe") >= 0.95).alias("survivors"),
        F.max_by("strategy", F.when(active & F.col("net_return").isNotNull(), rank)).alias("best_active"),
        F.max(F.when(active, F.col("net_return"))).alias("_best"),
        F.max(F.when(~active, F.col("net_return"))).alias("_passive"),
        F.count_if("never_traded").alias("idle_strategies"),
        F.count_if("ci_includes_zero").alias("intervals_with_zero"),
        F.max("n_rows").alias("observations"))
    delta = F.col("_best") - F.col("_passive")
    return (agg.withColumn("best_active_delta", delta)
            .withColumn("evidence", F.when(F.col("survivors") == 0, "NO_STRATEGY_SURVIVES").otherwise("SOME_SURVIVE"))
            .withColumn("against_passive", F.when(F.col("best_active_delta") > 0, "ACTIVE_WINS").otherwise("PASSIVE_WINS"))
            .withColumn("sample", F.when(F.col("observations") < 504, "SMALL_SAMPLE").otherwise("ADEQUATE_SAMPLE"))
            .drop("_best", "_passive"))


@dataclass(frozen=True)
class Gates:
    """What a series must pass before anything of it is reported, and where its events come from.

    ``rates``: (ticker, d, rate) of series that were converted, with ``ratio_history``
    (ticker, valid_from, ratio).  A rate that jumps at a ratio change is a split on
    one side only; with ``strict`` its series is taken out, else it stays in section
    ``rate``.  ``nodes`` (dataset_id, kind) and ``edges`` (child, parent): a series
    whose dataset is synthetic or derives from one is taken out, or raises with
    ``raise_tainted``.  ``issuers``: (ticker, issuer_ticker), whose events a series takes.
    """

    rates: DataFrame | None = None
    ratio_history: DataFrame | None = None
    strict: bool = True
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    raise_tainted: bool = False
    issuers: DataFrame | None = None


def gate_series(closes: DataFrame, gates: Gates) -> tuple[dict[str, DataFrame], DataFrame]:
    """(sections ``rate`` and ``taint``, rejects) of the gates that are given.  The
    rejects are written: every later section leaves their series out."""
    spark = closes.sparkSession
    sections: dict[str, DataFrame] = {}
    rejects = spark.createDataFrame([], "stage string, series string, reason string, rows long")
    if gates.rates is not None and gates.ratio_history is not None:
        sections["rate"] = written(fx.rate_continuity(gates.rates, gates.ratio_history), "rate")
        if gates.strict:
            bad = sections["rate"].filter(~F.col("usable")).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
            rejects = rejects.unionByName(bad.select(F.lit("rate").alias("stage"), F.col("ticker").alias("series"), F.lit("JUMP_AT_RATIO_CHANGE").alias("reason"), "rows"))
    if gates.nodes is not None and gates.edges is not None:
        series = closes.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("ticker", "dataset_id")
        if gates.raise_tainted:
            ln.assert_report_safe(gates.nodes, gates.edges, series)
        sections["taint"] = series.join(ln.tainted(gates.nodes, gates.edges), "dataset_id", "left_semi").withColumnRenamed("dataset_id", "ticker")
        rejects = rejects.unionByName(sections["taint"].select(F.lit("taint").alias("stage"), F.col("ticker").alias("series"), F.lit("SYNTHETIC_ANCESTOR").alias("reason"), "rows"))
    return sections, written(rejects, "rejects")


def events_of_issuers(events: DataFrame, issuers: DataFrame) -> DataFrame:
    """Events under the ticker of every series that takes them; a series without an entry has its own."""
    given = issuers.select(F.col("ticker").alias("_to"), F.col("issuer_ticker").alias("ticker"))
    own = events.join(issuers.select("ticker"), "ticker", "left_anti")
    taken = events.join(given, "ticker").drop("ticker").withColumnRenamed("_to", "ticker")
    return own.unionByName(taken)


def analyze_panel(panel: DataFrame, market: DataFrame, events: DataFrame,
                  params: AnalysisParams = AnalysisParams(), secondary: DataFrame | None = None,
                  gates: Gates = Gates()) -> dict[str, DataFrame]:
    """Gates, signals, stop, sizing, backtest, tests, folds and events, for all
    series at once.  Returns one table per report section.

    Costs are those of each series' market unless ``params.one_way_cost`` is set.
    Every series is searched for anomalies and, with a ``secondary`` source,
    reconciled; what cannot be computed is in ``rejects``, and a series that a gate
    rejects is in no other section.  ``overfit`` takes the series that are left as
    trials of one selection.
    """
    closes = drop_null_prices(panel)
    extra, rejected = gate_series(closes, gates)
    closes = closes.join(rejected.select(F.col("series").alias("ticker")).distinct(), "ticker", "left_anti")
    gate = history_gate(closes, params.min_rows)
    kept = accepted_only(closes, gate)
    signals = sg.vol_target_weight(sg.build_signals(kept, params.signals), params.target_vol)
    stopped = materialise(atr_stop(signals, "flag", params.atr_multiple))
    # The main run uses the stop; the folds follow the plain signal.
    runs = stopped.select("ticker", "d", "close", "weight", F.inline(F.array(
        F.struct(F.lit("main").alias("strategy"), F.col("position").alias("flag")),
        F.struct(F.lit("folds").alias("strategy"), F.col("flag").alias("flag")))))
    if params.one_way_cost is None:
        runs, cost = dm.with_costs(runs), F.col("one_way")
    else:
        cost = F.lit(params.one_way_cost)
    daily = materialise(bt.run_backtest(runs, cost, params.rebalance, weight="weight"))
    main = daily.filter("strategy = 'main'")
    folds, walk = bt.walk_forward(daily.filter("strategy = 'folds'"), params.folds)
    returns = ev.asset_and_market(kept, market)
    events = events if gates.issuers is None else events_of_issuers(events, gates.issuers)
    effects = written(ev.event_results(events, returns, params.events), "events")  # two sections read them
    return extra | {
        "gate": gate,
        "signals": sg.latest_signal(signals),
        "performance": bt.strategy_summary(main).drop("strategy"),
        "validity": inf.sharpe_assessment(main, params.trials).drop("strategy"),
        "intervals": inf.bootstrap_sharpe(main, replicates=params.replicates).drop("strategy"),
        "folds": folds.drop("strategy"),
        "walk_forward": walk.drop("strategy"),
        "events": effects,
        "event_classes": ev.caar_by_category(effects),
        "anomalies": ql.data_anomalies(closes),
        "reconciliation": ql.reconcile(closes, secondary if secondary is not None else closes.limit(0)),
        "overfit": inf.pbo(main.withColumn("selection", F.lit("all")), ["selection"], "ticker", "net", n_splits=8),
        "rejects": rejected.unionByName(rj.fold_rejects(daily.filter("strategy = 'folds'"), params.folds, keys=("ticker",))),
    }


def analysis_overview(sections: dict[str, DataFrame]) -> DataFrame:
    """One line per series from the sections of :func:`analyze_panel`."""
    counted = sections["events"].groupBy("ticker").agg(
        F.count("car").alias("events_measured"), F.count_if(F.col("car_p") < 0.05).alias("events_significant"))
    return (sections["gate"]
            .join(sections["signals"].select("ticker", "score", "decision"), "ticker", "left")
            .join(sections["performance"].select("ticker", "trades", "net_return", "max_drawdown", "time_in_market",
                                                 "benchmark_return"), "ticker", "left")
            .join(sections["validity"].select("ticker", "sharpe_annual", "psr", "deflated_sharpe", "verdict"), "ticker", "left")
            .join(sections["intervals"].select("ticker", "ci_low", "ci_high", "p_value"), "ticker", "left")
            .join(sections["walk_forward"].select("ticker", "oos_sharpe", "degradation", "reading"), "ticker", "left")
            .join(counted, "ticker", "left")
            .join(sections["reconciliation"].select("ticker", "compared_days", "days_over_tolerance", "clean"), "ticker", "left")
            .join(sections["anomalies"].groupBy("ticker").agg(F.count(F.lit(1)).alias("anomalies")), "ticker", "left")
            .withColumn("anomalies", F.coalesce("anomalies", F.lit(0))))
