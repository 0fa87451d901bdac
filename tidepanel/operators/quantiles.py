"""Exact quantiles of groups too large for one task."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.operators.running import join_null_safe, running_aggregates


def exact_quantiles(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], p: float = 0.5,
                    weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles per key, ``values`` being output to input column.

    All columns are selected in one pass.  Equal values are counted first (with
    ``weight``, a whole number, as often as it says); the counts are summed along
    ranges of (key, column, value), so no group is gathered or sorted in one task,
    and the two ranks around the wanted one are read off the sums.  NULL values
    do not count; a key without any has NULL.
    """
    keys, state = list(keys), [*keys, "_column"]
    long = F.inline(F.array(*[F.struct(F.lit(out).alias("_column"), F.col(c).cast("double").alias("_v")) for out, c in values.items()]))
    counts = (df.select(*keys, (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"), long).filter("_v IS NOT NULL AND _w > 0")
              .groupBy(*state, "_v").agg(F.sum("_w").alias("_c")))
    ranked = running_aggregates(counts, state, ["_v"], {"_upto": ("sum", "_c")})
    rank = F.lit(p) * (F.max("_upto") - 1)
    wanted = ranked.groupBy(*state).agg(rank.alias("_rank"))

    def first_at(rank_: str) -> Column:
        return F.min(F.when(F.col("_upto") >= F.expr(rank_), F.col("_v")))

    picks = (join_null_safe(ranked, wanted, state).groupBy(*state)
             .agg(first_at("floor(_rank) + 1").alias("_a"), first_at("ceil(_rank) + 1").alias("_b"), F.first("_rank").alias("_r")))
    part = F.col("_r") - F.floor("_r")
    found = picks.withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * part)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_column") == out, F.col("_q"))).alias(out) for out in values])
    return join_null_safe(df.select(*keys).distinct(), wide, keys, "left")
