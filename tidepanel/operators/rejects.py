"""What could not be computed, and why: one (stage, series, reason, rows) table
per stage, so that a series never leaves a result without a word."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.operators.quality import overlap_rejects


def _table(df: DataFrame, stage: str, keys: Sequence[str], reason: Column, rows: Column) -> DataFrame:
    series = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return df.select(F.lit(stage).alias("stage"), series.alias("series"), reason.alias("reason"), rows.cast("long").alias("rows"))


def cross_validation_rejects(trials: DataFrame, group: Sequence[str] = ("ticker",), trial: str = "strategy",
                             r: str = "net", n_splits: int = 10) -> DataFrame:
    """Groups with one trial only, or with fewer than two complete dates per block."""
    group = list(group)
    have = trials.groupBy(*group, "d").agg(F.count(r).alias("_have"))
    width = trials.groupBy(*group, trial).agg(F.lit(1).alias("_x")).groupBy(*group).agg(F.count(F.lit(1)).alias("_trials"))
    counted = (have.join(width, group).groupBy(*group).agg(F.first("_trials").alias("_trials"), F.count_if(F.col("_have") == F.col("_trials")).alias("_dates")))
    reason = F.when(F.col("_trials") < 2, "FEWER_THAN_TWO_TRIALS").when(F.col("_dates") < 2 * n_splits, "TOO_FEW_DATES")
    return _table(counted.withColumn("_reason", reason).filter("_reason IS NOT NULL"), "cross_validation", group, F.col("_reason"), F.col("_dates"))


def fold_rejects(panel: DataFrame, n_folds: int = 4, min_train: int = 252, keys: Sequence[str] = ("ticker", "strategy")) -> DataFrame:
    """Series too short for the training rows and 21 rows per fold."""
    counted = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < min_train + 21 * n_folds)
    return _table(counted, "folds", keys, F.lit("HISTORY_TOO_SHORT"), F.col("_n"))


def conversion_rejects(df: DataFrame, rates: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Series of which no day has a rate."""
    dated = df.join(rates.select(*keys, "d", F.lit(1).alias("_hit")), [*keys, "d"], "left").groupBy(*keys).agg(
        F.count("_hit").alias("_n"))
    return _table(dated.filter("_n = 0"), "conversion", keys, F.lit("NO_COMMON_DATES"), F.col("_n"))


def alignment_rejects(a: DataFrame, b: DataFrame, min_overlap: int = 20, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    return _table(overlap_rejects(a, b, keys, min_overlap), "alignment", keys, F.lit("OVERLAP_TOO_SHORT"), F.col("overlap"))


def deflation_rejects(df: DataFrame, index: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Series of which no month has a level; all of them if the index is empty."""
    months = index.filter("level IS NOT NULL").select(F.trunc("month", "MM").alias("_month"), F.lit(1).alias("_hit")).distinct()
    hits = (df.withColumn("_month", F.trunc("d", "MM")).join(months, "_month", "left").groupBy(*keys)
            .agg(F.count("_hit").alias("_n")).filter("_n = 0"))
    return _table(hits, "deflation", keys, F.lit("NO_INDEX_LEVEL"), F.col("_n"))
