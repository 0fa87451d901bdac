"""Per-series and cross-sectional indicators as window expressions.

The ``*_col`` helpers return Columns so that several indicators share one
``select`` and therefore one exchange on the series key.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidepanel.functions.numeric import (
    ROWS_PER_MONTH, ROWS_PER_YEAR, at_least, by_series, ratio, so_far, trailing)
from tidepanel.operators.running import running_aggregates

KEYS = ("ticker",)


def log_return_col(w: WindowSpec, price: str = "close") -> Column:
    return F.ln(ratio(price, F.lag(price).over(w)))


def simple_return_col(w: WindowSpec, price: str = "close") -> Column:
    return ratio(price, F.lag(price).over(w)) - 1


def momentum_col(w: WindowSpec, price: str = "close", lookback: int = 12, skip: int = 1) -> Column:
    """Return over ``lookback`` months that ended ``skip`` months ago."""
    near, far = skip * ROWS_PER_MONTH, (skip + lookback) * ROWS_PER_MONTH
    return ratio(F.lag(price, near).over(w), F.lag(price, far).over(w)) - 1


def trend_col(w: WindowSpec, price: str = "close", window: int = 200) -> Column:
    """1 above the simple moving average, 0 otherwise, NULL while warming up."""
    frame = trailing(w, window)
    above = (F.col(price) > F.avg(price).over(frame)).cast("double")
    return at_least(above, price, frame, window)


def high_proximity_col(w: WindowSpec, price: str = "close", window: int = 252) -> Column:
    frame = trailing(w, window)
    return at_least(ratio(price, F.max(price).over(frame)), price, frame, window // 2)


def realized_vol_col(w: WindowSpec, ret: str = "r", window: int = 63, annualize: bool = True) -> Column:
    frame = trailing(w, window)
    vol = F.stddev_samp(ret).over(frame)
    return at_least(vol * math.sqrt(ROWS_PER_YEAR) if annualize else vol, ret, frame, window // 2)


def true_range_col(w: WindowSpec, high: str = "high", low: str = "low", close: str = "close") -> Column:
    prev = F.lag(close).over(w)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - prev), F.abs(F.col(low) - prev))


def log_returns(df: DataFrame, keys: Sequence[str] = KEYS, price: str = "close") -> DataFrame:
    w = by_series(keys)
    return (df.withColumn("log_r", log_return_col(w, price)).filter(F.col("log_r").isNotNull())
            .select(*keys, "d", "log_r"))


def simple_returns(df: DataFrame, keys: Sequence[str] = KEYS, price: str = "close",
                   keep_first: bool = False) -> DataFrame:
    """``keep_first`` sets the first return of a series to zero instead of dropping it."""
    w = by_series(keys)
    out = df.withColumn("r", simple_return_col(w, price))
    return out.withColumn("r", F.coalesce("r", F.lit(0.0))) if keep_first else out.filter("r IS NOT NULL")


def average_true_range(df: DataFrame, window: int = 14, keys: Sequence[str] = KEYS,
                       out: str = "atr") -> DataFrame:
    """Wilder's exponential mean of the true range, seeded with the first value.

    The recursion ``y = (1-a) y + a x`` is unrolled into a weighted running sum.
    Weights grow as ``(1-a)^-i``, so rows are cut into chunks short enough for a
    double; the end value of the chunk before is carried in, and what lies two
    chunks back has a weight far below double precision.  Every window is a
    running frame: linear in the rows, nothing is collected.
    """
    decay = 1.0 - 1.0 / window
    chunk = max(int(600 / -math.log(decay)), 64) if window > 1 else 64
    w = by_series(keys)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("d")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    base = (df.withColumn("_tr", true_range_col(w))
            .withColumn("_pos", F.row_number().over(w) - 1)
            .withColumn("_chunk", F.floor(F.col("_pos") / chunk))
            .withColumn("_i", F.col("_pos") % chunk))
    seed = F.when(F.col("_pos") == 0, F.lit(1.0)).otherwise(F.lit(1.0 / window))
    own = (F.sum(F.col("_tr") * seed * F.pow(F.lit(decay), -F.col("_i"))).over(so_far(inside))
           * F.pow(F.lit(decay), F.col("_i")))
    ends = F.when(F.col("_i") == chunk - 1, F.col("_own"))
    return (base.withColumn("_own", own)
            .withColumn("_carry", F.coalesce(F.last(ends, ignorenulls=True).over(before), F.lit(0.0)))
            .withColumn(out, at_least(
                F.col("_own") + F.col("_carry") * F.pow(F.lit(decay), F.col("_i") + 1),
                "_tr", so_far(w), window))
            .drop("_tr", "_pos", "_chunk", "_i", "_own", "_carry"))


def rolling_beta(asset: DataFrame, market: DataFrame, window: int = 252,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Rolling covariance over variance on the dates both sides have.

    ``asset``: keys, d, r.  ``market``: d, market_r, one row per date.
    """
    both = asset.join(market, "d").filter("r IS NOT NULL AND market_r IS NOT NULL")
    frame = trailing(by_series(keys), window)
    beta = ratio(F.covar_samp("r", "market_r").over(frame), F.var_samp("market_r").over(frame))
    return both.select(*keys, "d", at_least(beta, "r", frame, window // 2).alias("beta"))


def momentum_rank(df: DataFrame, keys: Sequence[str] = KEYS, price: str = "close",
                  lookback: int = 12, skip: int = 1) -> DataFrame:
    """Per-date percentile rank of momentum across series, ties averaged.

    Equal values are counted first, so a date ships one row per distinct value,
    and the counts are summed along ranges of date and value, so no task sorts a
    whole date.
    """
    scored = (df.select(*keys, "d", momentum_col(by_series(keys), price, lookback, skip).alias("momentum"))
              .filter("momentum IS NOT NULL"))
    counts = scored.groupBy("d", "momentum").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_aggregates(counts, ["d"], ["momentum"], {"_upto": ("sum", "_n")})
    totals = scored.groupBy("d").agg(F.count(F.lit(1)).alias("_total"))
    place = (F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_total")
    ranks = ranked.join(totals, "d").select("d", "momentum", place.alias("momentum_rank"))
    return scored.join(ranks, ["d", "momentum"]).select(*keys, "d", "momentum", "momentum_rank")


def drawdown_path(df: DataFrame, equity: str = "equity", keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds the fall from the running maximum and the date of that maximum."""
    w = by_series(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new_high = F.col(equity) > F.coalesce(F.max(equity).over(before), F.lit(float("-inf")))
    return (df.withColumn("drawdown", ratio(equity, F.max(equity).over(so_far(w))) - 1)
            .withColumn("_top", F.when(new_high, F.col("d")))
            .withColumn("peak_d", F.last("_top", ignorenulls=True).over(so_far(w)))
            .drop("_top"))


def drawdown_aggs(drawdown: str = "drawdown", peak: str = "peak_d") -> list[Column]:
    """Deepest fall with its first trough date and the peak before it."""
    first = F.struct(drawdown, "d")
    return [F.min(drawdown).alias("max_drawdown"),
            F.min_by(peak, first).alias("drawdown_peak"),
            F.min_by("d", first).alias("drawdown_trough")]


def max_drawdown(df: DataFrame, equity: str = "equity", keys: Sequence[str] = KEYS) -> DataFrame:
    return drawdown_path(df, equity, keys).groupBy(*keys).agg(*drawdown_aggs())


def extremes_cols(w: WindowSpec, price: str = "close", min_history: int = 252,
                  window: int | None = None) -> tuple[Column, Column]:
    """Running (or rolling) minimum and maximum once enough history exists."""
    frame = so_far(w) if window is None else trailing(w, window)
    need = min_history if window is None else window
    return (at_least(F.min(price).over(frame), price, frame, need),
            at_least(F.max(price).over(frame), price, frame, need))
