"""Two-source reconciliation and anomaly checks."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import by_series, ratio, so_far
from tidepanel.operators.indicators import KEYS, log_return_col


def align_inner(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, min_overlap: int = 0) -> DataFrame:
    """Rows both sides have, for series with at least ``min_overlap`` of them."""
    both = a.join(b, [*keys, "d"])
    if not min_overlap:
        return both
    # a series is bounded by the calendar; counting it in place reads both sides once
    enough = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return both.withColumn("_n", enough).filter(F.col("_n") >= min_overlap).drop("_n")


def common_dates(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dates of a series that both sides have, each once."""
    return a.select(*keys, "d").intersect(b.select(*keys, "d"))


def overlap_rejects(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, min_overlap: int = 20) -> DataFrame:
    """Series with too few common dates, with the count."""
    n = a.join(b.select(*keys, "d"), [*keys, "d"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("overlap"))
    return (a.select(*keys).distinct().join(n, list(keys), "left")
            .withColumn("overlap", F.coalesce("overlap", F.lit(0)))
            .filter(F.col("overlap") < min_overlap))


def reconcile(primary: DataFrame, secondary: DataFrame, tolerance_pct: float = 1.0,
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Compare the closes of two vendors on their common dates.

    A series without a second source is reported as such and is never clean.
    """
    second = secondary.select(*keys, "d", F.col("close").alias("_b"), F.lit(True).alias("_both"))
    days = (primary.select(*keys, "d", F.col("close").alias("_a")).join(second, [*keys, "d"], "left")
            .withColumn("_diff", F.abs(ratio(F.col("_a") - F.col("_b"), "_b") * 100)))
    over = F.col("_diff") > tolerance_pct
    found = F.count("_both")
    return days.groupBy(*keys).agg(
        found.alias("compared_days"), F.max("_diff").alias("max_abs_pct_diff"),
        F.percentile("_diff", F.lit(0.5)).alias("median_abs_pct_diff"),
        F.count_if(over).alias("days_over_tolerance"),
        F.when(found > 0, F.array_join(F.sort_array(F.collect_list(F.when(over, F.date_format("d", "yyyy-MM-dd")))), ","))
        .alias("days"), (found > 0).alias("secondary_available"), ((found > 0) & (F.count_if(over) == 0)).alias("clean"))


def duplicate_dates(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dates that occur more than once, with the number of extra rows."""
    return (rows.groupBy(*keys, "d").agg((F.count(F.lit(1)) - 1).alias("extra_rows"))
            .filter("extra_rows > 0"))


def extreme_jumps(df: DataFrame, sigmas: float = 8.0, min_returns: int = 30,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    r = (df.select(*keys, "d", log_return_col(by_series(keys)).alias("log_r")).filter("log_r IS NOT NULL"))
    spread = (r.groupBy(*keys).agg(F.stddev_samp("log_r").alias("_sd"), F.count("log_r").alias("_n"))
              .filter(F.col("_n") > min_returns))
    return (r.join(spread, list(keys)).filter(F.abs("log_r") > sigmas * F.col("_sd"))
            .select(*keys, "d", "log_r"))


def data_anomalies(df: DataFrame, sigmas: float = 8.0, min_run: int = 5,
                   keys: Sequence[str] = KEYS, min_returns: int = 30) -> DataFrame:
    """Typed anomalies of a close series: (series, kind, d, detail).

    The input is read once: what each kind needs stands in windows over one
    series (bounded by the calendar), and each row lists what it shows.
    """
    w = by_series(keys)
    whole = Window.partitionBy(*keys)
    same_day = w.rangeBetween(Window.currentRow, Window.currentRow)
    rows = (df.select(*keys, "d", "close")
            .withColumn("_r", log_return_col(w)).withColumn("_pos", F.row_number().over(w))
            .withColumn("_flat", F.coalesce(F.col("close") == F.lag("close").over(w), F.lit(False)))
            .withColumn("_next", F.lead("d").over(w)).withColumn("_extra", F.count(F.lit(1)).over(same_day) - 1)
            .withColumn("_again", F.coalesce(F.lag("d").over(w) == F.col("d"), F.lit(False)))
            .withColumn("_sd", F.stddev_samp("_r").over(whole)).withColumn("_n", F.count("_r").over(whole))
            .withColumn("_run", F.col("_pos") - F.max(F.when(~F.col("_flat"), F.col("_pos"))).over(so_far(w)))
            .withColumn("_ends", F.col("_flat") & ~F.coalesce(F.lead("_flat").over(w), F.lit(False))))

    def shown(when: Column, kind: str, d: Column, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), d.alias("d"), detail.cast("double").alias("detail")))

    d = F.col("d")
    kinds = F.array(
        shown(F.col("close") <= 0, "NON_POSITIVE_PRICE", d, F.col("close")),
        shown((F.col("_extra") > 0) & ~F.col("_again"), "DUPLICATE_DATE", d, F.col("_extra")),
        shown((F.col("_n") > min_returns) & (F.abs("_r") > sigmas * F.col("_sd")), "EXTREME_JUMP", d, F.col("_r")),
        shown(F.col("_ends") & (F.col("_run") >= min_run), "FROZEN_PRICE", F.coalesce("_next", "d"), F.col("_run")))
    return rows.select(*keys, F.inline(F.array_compact(kinds)))
