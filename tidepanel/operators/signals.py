"""Votes, weights and the strategy catalogue."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.numeric import by_series, clip, ratio
from tidepanel.operators.indicators import (
    KEYS, high_proximity_col, momentum_col, realized_vol_col, simple_return_col, trend_col)
from tidepanel.operators.states import mean_reversion


@dataclass(frozen=True)
class SignalParams:
    """Parameters from the literature; not meant to be tuned on the data."""

    lookback_months: int = 12
    skip_months: int = 1
    sma_window: int = 200
    high_window: int = 252
    high_threshold: float = 0.75
    vote_threshold: float = 0.60


def vote(condition: Column, defined: Column) -> Column:
    """1/0 vote, NULL where the indicator is undefined."""
    return F.when(defined.isNotNull(), condition.cast("double"))


def vote_label(vote_column: str) -> Column:
    v = F.col(vote_column)
    return F.when(v.isNull(), "NO_DATA").when(v > 0.5, "YES").otherwise("NO")


def build_signals(df: DataFrame, params: SignalParams = SignalParams(),
                  keys: Sequence[str] = KEYS, price: str = "close") -> DataFrame:
    """Three votes and their mean; NULL unless all three votes are defined."""
    w = by_series(keys)
    votes = (F.col("vote_momentum"), F.col("vote_trend"), F.col("vote_high"))
    score = (votes[0] + votes[1] + votes[2]) / 3
    return (df.withColumn("momentum", momentum_col(w, price, params.lookback_months, params.skip_months))
            .withColumn("trend", trend_col(w, price, params.sma_window))
            .withColumn("near_high", high_proximity_col(w, price, params.high_window))
            .withColumn("vote_momentum", vote(F.col("momentum") > 0, F.col("momentum")))
            .withColumn("vote_trend", F.col("trend"))
            .withColumn("vote_high", vote(F.col("near_high") >= params.high_threshold, F.col("near_high")))
            .withColumn("score", score)
            .withColumn("flag", vote(F.col("score") >= params.vote_threshold, F.col("score"))))


def latest_signal(signals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last fully defined row of each series with readable votes."""
    cols = ["momentum", "vote_momentum", "vote_trend", "near_high", "vote_high", "score", "flag"]
    out = signals.groupBy(*keys).agg(
        F.max_by(F.struct("d", *cols), F.when(F.col("score").isNotNull(), F.col("d"))).alias("s"))
    return (out.select(*keys, "s.*")
            .withColumn("momentum_vote", vote_label("vote_momentum"))
            .withColumn("trend_vote", vote_label("vote_trend"))
            .withColumn("high_vote", vote_label("vote_high"))
            .withColumn("decision", F.when(F.col("score").isNull(), "INSUFFICIENT_DATA")
                        .when(F.col("flag") > 0, "BUY_HOLD").otherwise("CASH"))
            .drop("vote_momentum", "vote_trend", "vote_high", "flag"))


def vol_target_weight(df: DataFrame, target: float = 0.15, window: int = 63, max_weight: float = 1.0,
                      keys: Sequence[str] = KEYS, price: str = "close", out: str = "weight") -> DataFrame:
    """Exposure inversely proportional to realised volatility, without leverage."""
    w = by_series(keys)
    weight = clip(ratio(F.lit(target), "vol"), high=max_weight)
    return (df.withColumn("_r", simple_return_col(w, price))
            .withColumn("vol", realized_vol_col(w, "_r", window))
            .withColumn(out, F.when(F.col("vol") > 0, weight))
            .drop("_r"))


# A strategy maps a price panel to the same panel with a causal `flag` column.
StrategyBuilder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Strategy:
    name: str
    build: StrategyBuilder
    passive: bool = False


def momentum_trend(df: DataFrame, params: SignalParams = SignalParams(), keys: Sequence[str] = KEYS) -> DataFrame:
    return build_signals(df, params, keys).select(*df.columns, "flag")


def reversion(df: DataFrame, keys: Sequence[str] = KEYS, **params) -> DataFrame:
    return mean_reversion(df, keys=keys, out="flag", **params).select(*df.columns, "flag")


def buy_and_hold(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.withColumn("flag", F.lit(1.0))


def catalog(keys: Sequence[str] = KEYS, params: SignalParams = SignalParams()) -> tuple[Strategy, ...]:
    """The strategies compared together; their number is the trial count."""
    return (Strategy("momentum_trend", lambda df: momentum_trend(df, params, keys)),
            Strategy("mean_reversion", lambda df: reversion(df, keys)),
            Strategy("buy_and_hold", lambda df: buy_and_hold(df, keys), passive=True))


def strategy_grid(df: DataFrame, strategies: Sequence[Strategy] | None = None,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Every series under every strategy, in one panel with a strategy column.

    All built-in flags come from windows on one key, so they are added side by
    side and unpivoted: one exchange instead of one per strategy.
    """
    chosen = strategies if strategies is not None else catalog(keys)
    wide = df
    for s in chosen:
        wide = s.build(wide).withColumnRenamed("flag", f"_flag_{s.name}")
    entries = F.array(*[F.struct(F.lit(s.name).alias("strategy"), F.lit(s.passive).alias("passive"),
                                 F.col(f"_flag_{s.name}").alias("flag")) for s in chosen])
    return (wide.select(*df.columns, F.explode(entries).alias("_s"))
            .select(*df.columns, "_s.strategy", "_s.passive", "_s.flag"))
