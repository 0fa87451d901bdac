"""Next-day execution with costs, summaries and walk-forward folds."""

from __future__ import annotations

import math
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import ROWS_PER_YEAR, as_col, by_series, clip, ratio, so_far
from tidepanel.operators.indicators import KEYS, drawdown_aggs, simple_return_col
from tidepanel.operators.inference import sharpe_agg
from tidepanel.operators.quantiles import exact_quantiles
from tidepanel.operators.running import join_null_safe
from tidepanel.runtime import written

STRATEGY_KEYS = ("ticker", "strategy")
_WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def rebalance_bucket(rule: str, d: Column | str = "d") -> Column:
    """Label of the rebalance period of a date: ``D``, ``W-FRI`` etc. or ``M``."""
    if rule == "D":
        return as_col(d)
    if rule == "M":
        return F.last_day(d)
    kind, _, day = rule.partition("-")
    if kind != "W" or day not in _WEEKDAYS:
        raise ValueError(f"unknown rebalance rule {rule!r}")
    return F.next_day(F.date_sub(d, 1), day)


def rebalance_rows(df: DataFrame, rule: str = "W-FRI", keys: Sequence[str] = KEYS) -> DataFrame:
    """Marks the last row of each period (the period end snapped back to a row)."""
    nxt = F.lead("_bucket").over(by_series(keys))
    return (df.withColumn("_bucket", rebalance_bucket(rule))
            .withColumn("is_rebalance", F.coalesce(nxt != F.col("_bucket"), F.lit(True)))
            .drop("_bucket"))


def run_backtest(df: DataFrame, cost: Column | float = 0.0005, rebalance: str = "W-FRI", lag: int = 1,
                 weight: str | None = None, keys: Sequence[str] = STRATEGY_KEYS,
                 price: str = "close", flag: str = "flag") -> DataFrame:
    """Daily strategy panel from prices and a causal flag.

    ``cost`` is the one-way cost, a number or a column of ``df``.  The decision
    of a rebalance row acts ``lag`` rows later.  All windows share the key, so
    the panel is shuffled once.
    """
    if lag < 1:
        raise ValueError("lag must be at least 1: a close cannot be traded before it is known")
    w = by_series(keys)
    target = F.col(flag).cast("double")
    if weight is not None:
        target = clip(target * F.col(weight), 0.0, 1.0)
    cost = F.lit(float(cost)) if isinstance(cost, (int, float)) else cost
    first = F.lag("d").over(w).isNull()
    out = rebalance_rows(df.filter(F.col(price).isNotNull()), rebalance, keys)
    out = (out.withColumn("_cost", cost)
           .withColumn("held", F.last(F.when(F.col("is_rebalance"), target), ignorenulls=True).over(so_far(w)))
           .withColumn("executed", F.coalesce(F.lag("held", lag).over(w), F.lit(0.0)))
           .withColumn("asset_r", F.coalesce(simple_return_col(w, price), F.lit(0.0)))
           .withColumn("gross", F.col("executed") * F.col("asset_r"))
           .withColumn("turnover", F.abs(F.col("executed") - F.coalesce(F.lag("executed").over(w), F.lit(0.0))))
           .withColumn("cost", F.col("turnover") * F.col("_cost"))
           .withColumn("net", F.col("gross") - F.col("cost")))
    return (out.withColumn("equity", F.when(first, F.lit(1.0)).otherwise(F.product(1 + F.col("net")).over(so_far(w))))
            .withColumn("bench_equity", F.product(1 + F.col("asset_r")).over(so_far(w)))
            .drop("_cost"))


def with_drawdowns(panel: DataFrame, keys: Sequence[str] = STRATEGY_KEYS) -> DataFrame:
    w = by_series(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new_high = F.col("equity") > F.coalesce(F.max("equity").over(before), F.lit(float("-inf")))
    return (panel.withColumn("drawdown", ratio("equity", F.max("equity").over(so_far(w))) - 1)
            .withColumn("_top", F.when(new_high, F.col("d")))
            .withColumn("peak_d", F.last("_top", ignorenulls=True).over(so_far(w)))
            .withColumn("bench_drawdown", ratio("bench_equity", F.max("bench_equity").over(so_far(w))) - 1)
            .drop("_top"))


def strategy_summary(panel: DataFrame, keys: Sequence[str] = STRATEGY_KEYS) -> DataFrame:
    """One row per series and strategy."""
    years = F.greatest(F.datediff(F.max("d"), F.min("d")) / F.lit(365.25), F.lit(1e-9))
    agg = (with_drawdowns(panel, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("d").alias("first_d"), F.max("d").alias("last_d"),
        years.alias("_years"),
        F.count_if(F.col("turnover") > 1e-9).alias("trades"),
        F.sum("cost").alias("total_costs"),
        (F.product(1 + F.col("gross")) - 1).alias("gross_return"),
        F.max_by("equity", "d").alias("_final"),
        F.max_by("bench_equity", "d").alias("_bench_final"),
        (F.stddev_samp("net") * math.sqrt(ROWS_PER_YEAR)).alias("volatility"),
        sharpe_agg("net").alias("sharpe"),
        *drawdown_aggs(),
        F.avg((F.col("executed") > 0).cast("double")).alias("time_in_market"),
        F.min("bench_drawdown").alias("benchmark_max_drawdown")))
    return (agg.withColumn("net_return", F.col("_final") - 1)
            .withColumn("cagr", F.pow("_final", 1 / F.col("_years")) - 1)
            .withColumn("benchmark_return", F.col("_bench_final") - 1)
            .withColumn("benchmark_cagr", F.pow("_bench_final", 1 / F.col("_years")) - 1)
            .drop("_years", "_final", "_bench_final"))


def versus_passive(summary: DataFrame, passive: str = "buy_and_hold",
                   keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Metrics of each active strategy minus those of the passive one.

    The grid has a handful of strategies per series, so a window on the series
    key replaces the self-join.
    """
    w = Window.partitionBy(*keys)

    def base(c):
        return F.max(F.when(F.col("strategy") == passive, F.col(c))).over(w)

    names = ("net_return", "cagr", "sharpe", "max_drawdown")
    out = summary.select(*keys, "strategy", *names, *[base(c).alias(f"_{c}") for c in names])
    return (out.filter(F.col("strategy") != passive)
            .select(*keys, "strategy", *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_diff") for c in names],
                    (F.col("net_return") > F.col("_net_return")).alias("beats_passive")))


def out_of_sample(panel: DataFrame, min_train: int = 252, keys: Sequence[str] = STRATEGY_KEYS) -> DataFrame:
    """The pooled rows of all folds: everything after the first training window."""
    pos = F.row_number().over(by_series(keys))
    return panel.withColumn("_pos", pos).filter(F.col("_pos") > min_train).drop("_pos")


def walk_forward(panel: DataFrame, n_folds: int = 4, min_train: int = 252,
                 keys: Sequence[str] = STRATEGY_KEYS) -> tuple[DataFrame, DataFrame]:
    """(folds, summary) of expanding chronological folds.

    Flags must be causal (those of the catalogue are; for any other builder see
    :func:`walk_forward_builder`) and are executed a row later, so the returns of a
    shorter history are a prefix of the full run: one panel is enough.  Every fold is a
    pair of conditional aggregates over row numbers; rows are not replicated.
    Series shorter than ``min_train + 21 * n_folds`` rows are left out.
    """
    numbered = (panel.withColumn("_pos", F.row_number().over(by_series(keys)) - 1)
                .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
                .filter(F.col("_n") >= min_train + 21 * n_folds)
                .withColumn("_size", F.floor((F.col("_n") - min_train) / n_folds)))
    aggs = []
    for k in range(n_folds):
        start = min_train + k * F.col("_size")
        train = F.col("_pos") < start
        test = F.col("_pos") >= start
        if k < n_folds - 1:
            test = test & (F.col("_pos") < start + F.col("_size"))
        r_in, r_out, d_in, d_out = (F.when(c, F.col(x)) for x in ("net", "d") for c in (train, test))
        aggs += [F.min(d_in).alias(f"train_from_{k}"), F.max(d_in).alias(f"train_to_{k}"),
                 F.min(d_out).alias(f"test_from_{k}"), F.max(d_out).alias(f"test_to_{k}"),
                 sharpe_agg(r_in).alias(f"is_{k}"), sharpe_agg(r_out).alias(f"oos_{k}"),
                 F.count(r_out).alias(f"n_{k}"), (F.product(1 + r_out) - 1).alias(f"ret_{k}")]
    pooled = F.when(F.col("_pos") >= min_train, F.col("net"))
    per_series = numbered.groupBy(*keys).agg(*aggs, sharpe_agg(pooled).alias("oos_sharpe"))
    fold = F.array(*[F.struct(
        F.lit(k + 1).alias("fold"),
        *[F.col(f"{c}_{k}").alias(c) for c in ("train_from", "train_to", "test_from", "test_to")],
        F.col(f"is_{k}").alias("sharpe_is"),
        F.when(F.col(f"n_{k}") > 30, F.col(f"oos_{k}")).alias("sharpe_oos"),
        F.col(f"ret_{k}").alias("return_oos")) for k in range(n_folds)])
    folds = per_series.select(*keys, F.inline(fold))
    ins = F.array_compact(F.array(*[F.col(f"is_{k}") for k in range(n_folds)]))
    mean_is = F.when(F.size(ins) > 0, F.aggregate(ins, F.lit(0.0), lambda a, x: a + x) / F.size(ins))
    summary = (per_series.select(*keys, F.lit(n_folds).alias("folds"), "oos_sharpe", mean_is.alias("is_sharpe_mean"))
               .withColumn("degradation", ratio(F.col("oos_sharpe") - F.col("is_sharpe_mean"),
                                                F.abs(F.col("is_sharpe_mean"))))
               .withColumn("reading", fold_reading()))
    return folds, summary


def walk_forward_builder(prices: DataFrame, build: Callable[[DataFrame], DataFrame], cost: float = 0.0005, n_folds: int = 4,
                         min_train: int = 252, rebalance: str = "W-FRI", weight: str | None = None,
                         key: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """(folds, summary) of a user's builder, which is run on each history that a fold may know.

    A builder need not be causal, so its flags on the whole series say nothing
    about a shorter one.  Fold ``k`` trains on a prefix of the series and is judged
    on the end of the next longer prefix, so there are ``n_folds + 1`` prefixes.
    Rows are copied to the prefixes that hold them, each prefix is a series of its
    own name, and the builder, which only has to keep to the series column and to
    pass columns on, runs once over all of them.  Columns and short series are as
    in :func:`walk_forward`, which reads one panel where a builder is causal.
    """
    known = prices.filter(F.col("close").isNotNull())
    sized = (known.withColumn("_pos", F.row_number().over(by_series([key])) - 1)
             .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
             .filter(F.col("_n") >= min_train + 21 * n_folds)
             .withColumn("_size", F.floor((F.col("_n") - min_train) / n_folds)))
    length = F.when(F.col("_prefix") == n_folds, F.col("_n")).otherwise(min_train + F.col("_prefix") * F.col("_size"))
    copies = (sized.withColumn("_prefix", F.explode(F.sequence(F.lit(0), F.lit(n_folds)))).filter(F.col("_pos") < length)
              .withColumn("_series", F.col(key)).withColumn(key, F.concat_ws("#", F.col(key).cast("string"), F.col("_prefix").cast("string"))))
    daily = run_backtest(build(copies), cost, rebalance, weight=weight, keys=(key,))
    begins = F.when(F.col("_prefix") > 0, min_train + (F.col("_prefix") - 1) * F.col("_size"))
    judged = F.col("_pos") >= begins
    parts = daily.withColumn("_judged", F.coalesce(judged, F.lit(False)))
    r_out, d_out = F.when(F.col("_judged"), F.col("net")), F.when(F.col("_judged"), F.col("d"))
    each = parts.groupBy(F.col("_series").alias(key), "_prefix").agg(
        F.min("d").alias("train_from"), F.max("d").alias("train_to"), sharpe_agg("net").alias("sharpe_is"),
        F.min(d_out).alias("test_from"), F.max(d_out).alias("test_to"), F.count(r_out).alias("_tested"), sharpe_agg(r_out).alias("_oos"),
        (F.product(1 + r_out) - 1).alias("return_oos"), *pooled_moments(r_out))
    each = written(each, "prefixes")  # a row per series and prefix
    train = each.filter(F.col("_prefix") < n_folds).select(key, (F.col("_prefix") + 1).alias("fold"), "train_from", "train_to", "sharpe_is")
    test = each.filter("_prefix > 0").select(key, F.col("_prefix").alias("fold"), "test_from", "test_to",
                                             F.when(F.col("_tested") > 30, F.col("_oos")).alias("sharpe_oos"), "return_oos")
    folds = train.join(test, [key, "fold"]).select(key, "fold", "train_from", "train_to", "test_from", "test_to", "sharpe_is", "sharpe_oos", "return_oos")
    summary = (each.groupBy(key).agg(F.lit(n_folds).alias("folds"), pooled_sharpe().alias("oos_sharpe"),
                                     F.avg(F.when(F.col("_prefix") < n_folds, F.col("sharpe_is"))).alias("is_sharpe_mean"))
               .withColumn("degradation", ratio(F.col("oos_sharpe") - F.col("is_sharpe_mean"), F.abs(F.col("is_sharpe_mean"))))
               .withColumn("reading", fold_reading()))
    return folds, summary


def pooled_moments(r: Column) -> list[Column]:
    """Mergeable moments of returns."""
    return [F.count(r).alias("_k"), F.sum(r).alias("_s1"), F.sum(r * r).alias("_s2"), F.min(r).alias("_lo"), F.max(r).alias("_hi")]


def pooled_sharpe() -> Column:
    """Aggregate: annual Sharpe ratio of the returns behind rows of :func:`pooled_moments`."""
    k, s1, s2 = F.sum("_k"), F.sum("_s1"), F.sum("_s2")
    sd = F.sqrt(F.greatest(s2 - s1 * s1 / k, F.lit(0.0)) / (k - 1))
    return F.when((k >= 2) & (F.max("_hi") > F.min("_lo")) & (sd > 0), s1 / k / sd * math.sqrt(ROWS_PER_YEAR))


def fold_reading(degradation: str = "degradation", oos: str = "oos_sharpe") -> Column:
    return (F.when(F.col(degradation) < -0.50, "COLLAPSES_OUT_OF_SAMPLE")
            .when(F.col(oos) <= 0, "NO_RETURN_OUT_OF_SAMPLE")
            .otherwise("HOLDS_OUT_OF_SAMPLE"))


def regime_medians(summary: DataFrame, keys: Sequence[str] = ("regime", "strategy")) -> DataFrame:
    """Medians over many series and the share that never traded."""
    metrics = ("net_return", "sharpe", "max_drawdown", "trades")
    summary = written(summary.select(*keys, "time_in_market", *metrics), "summary")
    base = summary.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_series"),
        F.avg((F.col("time_in_market") == 0).cast("double")).alias("never_traded"))
    return join_null_safe(base, exact_quantiles(summary, keys, {f"median_{m}": m for m in metrics}), keys)


def regime_win_rates(summary: DataFrame, strategies: Sequence[str], by: str = "regime",
                     keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Share of series in which one strategy returned more than another, per pair."""
    wide = summary.groupBy(by, *keys).pivot("strategy", list(strategies)).agg(F.first("net_return"))
    pairs = [(a, b) for i, a in enumerate(strategies) for b in strategies[i + 1:]]
    rows = F.array(*[F.struct(F.lit(a).alias("strategy_a"), F.lit(b).alias("strategy_b"),
                              (F.col(a) > F.col(b)).cast("double").alias("win")) for a, b in pairs])
    return (wide.select(by, F.inline(rows)).groupBy(by, "strategy_a", "strategy_b")
            .agg(F.avg("win").alias("win_rate")))


def best_strategy(summary: DataFrame, metric: str = "sharpe", keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Strategy with the highest metric; ties go to the first name, NULLs never win."""
    best = F.min_by("strategy", F.struct((-F.col(metric)).alias("m"), F.col("strategy")))
    return (summary.filter(F.col(metric).isNotNull())
            .groupBy(*keys).agg(best.alias("best_strategy"), F.max(metric).alias(f"best_{metric}")))
