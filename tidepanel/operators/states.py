"""Path-dependent rules written as window algebra instead of loops."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import by_series, ratio, so_far
from tidepanel.operators.indicators import KEYS, average_true_range, extremes_cols


def latch(df: DataFrame, enter: Column, leave: Column, defined: Column,
          keys: Sequence[str] = KEYS, out: str = "position") -> DataFrame:
    """Two-state memory: 1 after ``enter``, 0 after ``leave``, unchanged otherwise.

    A row that satisfies only one condition fixes the state; a row that
    satisfies both flips it (out of the market it enters, in the market it
    leaves).  The state is thus the last fixed value plus the parity of the
    flips since then.
    """
    w = so_far(by_series(keys))
    fixed = (F.when(defined & enter & ~leave, F.lit(1))
             .when(defined & leave & ~enter, F.lit(0)))
    flip = F.when(defined & enter & leave, F.lit(1)).otherwise(F.lit(0))
    mark = F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", "_flips"))
    state = (F.coalesce(F.col("_last._fixed"), F.lit(0)) + F.col("_flips")
             - F.coalesce(F.col("_last._flips"), F.lit(0))) % 2
    return (df.withColumn("_fixed", fixed)
            .withColumn("_flip", flip)
            .withColumn("_defined", defined)
            .withColumn("_flips", F.sum("_flip").over(w))
            .withColumn("_last", F.last(mark, ignorenulls=True).over(w))
            .withColumn(out, F.when(F.col("_defined"), state.cast("double")))
            .drop("_fixed", "_flip", "_flips", "_last", "_defined"))


def mean_reversion(df: DataFrame, buy_within: float = 0.10, sell_within: float = 0.95,
                   min_history: int = 252, window: int | None = None,
                   keys: Sequence[str] = KEYS, price: str = "close",
                   out: str = "position") -> DataFrame:
    """Buy near the historical low, sell near the historical high.

    ``window=None`` uses all history so far, otherwise a rolling window.
    """
    low, high = extremes_cols(by_series(keys), price, min_history, window)
    ext = df.withColumn("low_so_far", low).withColumn("high_so_far", high)
    return latch(ext,
                 enter=(ratio(price, "low_so_far") - 1) <= buy_within,
                 leave=ratio(price, "high_so_far") >= sell_within,
                 defined=F.col(price).isNotNull() & F.col("low_so_far").isNotNull(),
                 keys=keys, out=out)


def atr_stop(df: DataFrame, flag: str = "flag", multiple: float = 3.0, atr_window: int = 14,
             keys: Sequence[str] = KEYS, out: str = "position") -> DataFrame:
    """Leave when the close falls ``multiple`` ATRs below the peak since entry;
    come back only after the signal has been off in between.

    Rows between two "off" rows form one episode.  Inside it the peak and the
    fact of having been stopped are running maxima.  Rows with an undefined flag
    or close change nothing.
    """
    w = by_series(keys)
    episode = Window.partitionBy(*keys, "_episode").orderBy("d")
    usable = F.col(flag).isNotNull() & F.col("close").isNotNull()
    on = usable & (F.col(flag) > 0)
    off = F.when(usable & (F.col(flag) <= 0), F.lit(1)).otherwise(F.lit(0))
    hit = F.when(F.col("_on") & (F.col("close") < F.col("_peak") - multiple * F.col("atr")), F.lit(1)).otherwise(F.lit(0))
    return (average_true_range(df, atr_window, keys, "atr")
            .withColumn("_usable", usable)
            .withColumn("_on", on)
            .withColumn("_episode", F.sum(off).over(so_far(w)))
            .withColumn("_peak", F.max(F.when(F.col("_on"), F.col("close"))).over(so_far(episode)))
            .withColumn("_hit", hit)
            .withColumn("_stopped", F.max("_hit").over(so_far(episode)))
            .withColumn(out, F.when(F.col("_usable"),
                                    F.when(F.col("_on") & (F.col("_stopped") == 0), F.lit(1.0))
                                    .otherwise(F.lit(0.0))))
            .drop("_usable", "_on", "_episode", "_peak", "_hit", "_stopped"))


def frozen_runs(df: DataFrame, min_run: int = 5, keys: Sequence[str] = KEYS,
                price: str = "close") -> DataFrame:
    """Runs of at least ``min_run`` unchanged prices.

    ``reported_d`` is the first changed row after the run; a run that reaches
    the end of the series has none and is marked ``open_run``.
    """
    w = by_series(keys)
    flat = F.coalesce(F.col(price) == F.lag(price).over(w), F.lit(False))
    runs = (df.select(*keys, "d", price)
            .withColumn("_flat", flat)
            .withColumn("_next", F.lead("d").over(w))
            .withColumn("_run", F.sum(F.when(F.col("_flat"), 0).otherwise(1)).over(so_far(w))))
    return (runs.filter("_flat").groupBy(*keys, "_run")
            .agg(F.count(F.lit(1)).alias("run_days"), F.min("d").alias("run_start"),
                 F.max("d").alias("run_end"), F.max_by("_next", "d").alias("reported_d"))
            .filter(F.col("run_days") >= min_run)
            .withColumn("open_run", F.col("reported_d").isNull())
            .drop("_run"))


def cooldown(df: DataFrame, min_days: int = 21, keys: Sequence[str] = KEYS) -> DataFrame:
    """Greedy throttle: keep a signal date only ``min_days`` calendar days after
    the last one kept.  Dates are made distinct first, so the folded array is
    bounded by the calendar."""
    start = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<date>").alias("kept"))

    def step(acc, d):
        keep = acc["last"].isNull() | (F.datediff(d, acc["last"]) >= min_days)
        return F.struct(F.when(keep, d).otherwise(acc["last"]).alias("last"),
                        F.when(keep, F.concat(acc["kept"], F.array(d))).otherwise(acc["kept"]).alias("kept"))

    days = df.select(*keys, "d").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("d")).alias("_days"))
    return days.select(*keys, F.explode(F.aggregate("_days", start, step)["kept"]).alias("d"))
