"""Implied exchange rate from a share quoted in two markets, and deflation."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.dates import month_start
from tidepanel.functions.numeric import ratio
from tidepanel.operators.indicators import KEYS
from tidepanel.operators.quality import align_inner


def with_validity(history: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``valid_to``, the next ``valid_from`` of the series (exclusive)."""
    w = Window.partitionBy(*keys).orderBy("valid_from")
    return history.withColumn("valid_to", F.lead("valid_from").over(w))


def ratio_asof(df: DataFrame, history: DataFrame, keys: Sequence[str] = KEYS,
               date: str = "d") -> DataFrame:
    """The ratio in force on each date, NULL before the first entry.

    Changes and rows are merged by date and the last change is carried forward:
    no range join, and a series stays bounded by the calendar.
    """
    changes = history.select(*keys, F.col("valid_from").alias(date), F.col("ratio").alias("_ratio"), F.lit(0).alias("_row"))
    w = Window.partitionBy(*keys).orderBy(date, "_row").rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("_row", F.lit(1)).unionByName(changes, allowMissingColumns=True)
            .withColumn("ratio", F.last(F.when(F.col("_row") == 0, F.col("_ratio")), ignorenulls=True).over(w))
            .filter("_row = 1").select(*[F.col(c) for c in df.columns if c != "ratio"], "ratio"))


def ratio_latest(history: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ratio in force today: the one that fits split-adjusted prices."""
    return history.groupBy(*keys).agg(F.max_by("ratio", "valid_from").alias("ratio"))


def implied_rate(local: DataFrame, foreign: DataFrame, history: DataFrame, adjusted: bool = True,
                 min_overlap: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Local price times shares per certificate over the foreign price.

    ``local``: keys, d, local.  ``foreign``: keys, d, adr.
    """
    both = align_inner(local, foreign, keys, min_overlap)
    if adjusted:
        with_ratio = both.join(ratio_latest(history, keys), list(keys), "left")
    else:
        with_ratio = ratio_asof(both, history, keys)
    return with_ratio.select(*keys, "d", ratio(F.col("local") * F.col("ratio"), "adr").alias("rate"))


def rows_around(df: DataFrame, marks: DataFrame, at: str = "valid_from", window: int = 5,
                keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``window`` rows of a series before each mark and from it on, with
    ``after`` and the distance ``k`` in rows.

    Rows are numbered, each mark is anchored to a number, and the two meet in an
    equi-join on it: only the rows that are kept are formed.
    """
    numbered = df.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy("d")))
    w = Window.partitionBy(*keys).orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0)
    dates = df.select(*keys, F.col("d").alias("_at"), F.lit(1).alias("_row"))
    anchors = (marks.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_row")).distinct().unionByName(dates)
               .withColumn("_before", F.sum("_row").over(w)).filter("_row = 0"))
    step = F.explode(F.sequence(F.lit(1 - window), F.lit(window)))
    wanted = (anchors.select(*keys, F.col("_at").alias(at), "_before", step.alias("_step"))
              .withColumn("_pos", F.col("_before") + F.col("_step")))
    return (wanted.join(numbered, [*keys, "_pos"]).withColumn("after", F.col("_step") > 0)
            .withColumn("k", F.when(F.col("_step") > 0, F.col("_step")).otherwise(1 - F.col("_step")))
            .drop("_pos", "_before", "_step"))


def rate_continuity(rates: DataFrame, history: DataFrame, window: int = 5, max_step_pct: float = 25.0,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """Median level before and after each ratio change; a jump there is a split
    applied to one side only.
    """
    side = rows_around(rates, history, "valid_from", window, keys)

    def part(flag: bool) -> tuple[Column, Column]:
        pick = F.when(F.col("after") == flag, F.col("rate"))
        return F.percentile(pick, F.lit(0.5)), F.count(pick)

    (m0, n0), (m1, n1) = part(False), part(True)
    out = (side.groupBy(*keys, "valid_from")
           .agg(m0.alias("median_before"), m1.alias("median_after"), n0.alias("_n0"), n1.alias("_n1"))
           .filter("_n0 >= 2 AND _n1 >= 2 AND median_before > 0"))
    factor = F.col("median_after") / F.col("median_before")
    hint = (F.when(F.abs(factor / 0.1 - 1) < 0.2, 0.1).when(F.abs(factor / 10.0 - 1) < 0.2, 10.0))
    return (out.withColumn("step_pct", (factor - 1) * 100)
            .withColumn("flagged", F.abs("step_pct") > max_step_pct)
            .withColumn("split_hint", F.when(F.col("flagged"), hint))
            .withColumn("usable", ~F.col("flagged")).drop("_n0", "_n1"))


def rate_level_gap(rates: DataFrame, official: DataFrame, max_gap_pct: float = 200.0,
                   min_overlap: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Median gap to the official rate and what it means."""
    gap = (ratio("rate", "official_rate") - 1) * 100
    marked = official.select(*keys, "d", "official_rate", F.lit(True).alias("_both"))
    out = rates.join(marked, [*keys, "d"], "left").groupBy(*keys).agg(
        F.count("_both").alias("common_days"), F.percentile(gap, F.lit(0.5)).alias("_gap"))
    enough = F.col("common_days") >= min_overlap
    return (out.withColumn("median_gap_pct", F.when(enough, F.col("_gap")))
            .withColumn("level", F.when(~enough, "NOT_VALIDATED")
                        .when(F.col("_gap") > max_gap_pct, "GAP_TOO_WIDE")
                        .when(F.col("_gap") < -20, "BELOW_OFFICIAL").otherwise("PLAUSIBLE"))
            .drop("_gap"))


def to_foreign(df: DataFrame, rates: DataFrame, columns: Sequence[str] = ("close",),
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Divide local prices by the rate of the same day; days without one drop out."""
    out = df.join(rates.select(*keys, "d", "rate"), [*keys, "d"])
    for c in columns:
        out = out.withColumn(c, ratio(c, "rate"))
    return out.filter(F.col("close").isNotNull()).drop("rate")


def deflate(df: DataFrame, index: DataFrame, price: str = "close", base_month: str | None = None,
            out: str = "real") -> DataFrame:
    """Constant-money prices of the last published (or given) month.

    A month without a level drops its days; nothing is carried forward.
    """
    months = index.select(month_start("month").alias("_month"), "level").filter("level IS NOT NULL")
    base = (months.agg(F.max_by("level", "_month").alias("_base")) if base_month is None
            else months.filter(F.col("_month") == F.lit(base_month).cast("date")).select(F.col("level").alias("_base")))
    return (df.withColumn("_month", month_start("d")).join(months, "_month")
            .crossJoin(F.broadcast(base))  # a single row
            .withColumn(out, F.col(price) * ratio("_base", "level"))
            .filter(F.col(out).isNotNull()).drop("_month", "level", "_base"))
