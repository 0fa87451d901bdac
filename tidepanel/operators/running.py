"""Running aggregates that do not need a whole group in one task.

A running window puts every row of a key into one task, and one account may hold
a large share of the table.  Rows are therefore dealt by ranges of (key, order),
so that a task holds a bounded stretch of the sorted table.  Inside a range the
state of every row is folded once and written; what a range adds is a small
mergeable state (a sum, an extreme, the highest running sum, the last value), and
only keys that go on behind the end of a range need the state of the ranges
before.  That is at most two keys a range, whatever the data.  The input is read
once, all keys take this way, and a NULL key is a key like any other.  Sums are
exact as long as the summed columns are whole numbers (see ``units``).
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.runtime import written

UNIT = 1_000_000  # money and quantities are summed in whole millionths

#: Output column to (kind, input column) or (kind, input column, "before").  Kinds:
#: sum, max and min so far; peak, the highest running sum so far; last, the latest
#: value that is not NULL; next, the value in the following row.  "before" leaves
#: the row itself out.
Outs = Mapping[str, tuple[str, ...]]

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "peak": F.max}


def units(c: Column | str) -> Column:
    """A quantity or an amount as a whole number of millionths.  A sum beyond the
    range of BIGINT raises (ANSI mode) instead of losing digits."""
    return F.round((F.col(c) if isinstance(c, str) else c) * UNIT).cast("long")


def from_units(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c) / float(UNIT)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   small: bool = False) -> DataFrame:
    """Equality join in which a NULL key meets a NULL key.  ``small``: the right side is bounded, send it along."""
    named = right.select(*[F.col(c).alias(f"_of_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(F.broadcast(named) if small else named, same, how).drop(*[f"_of_{k}" for k in keys])


def _local(out: str, kind: str, column: str, frames: tuple) -> list[tuple[str, Column]]:
    """Columns of the fold inside a range, in the order in which they need each other."""
    window, so_far, frame = frames
    name = f"_in_{out}"
    if kind == "next":
        return [(name, F.lead(column).over(window))]
    if kind == "last":
        return [(name, F.last(column, ignorenulls=True).over(frame))]
    if kind == "peak":
        return [(f"_run_{out}", F.sum(column).over(so_far)), (name, F.max(f"_run_{out}").over(frame))]
    return [(name, _FOLD[kind](column).over(frame))]


def _state(out: str, kind: str, column: str) -> list[Column]:
    """What one range adds for one key."""
    if kind == "next":
        return [F.min_by(column, "_place").alias(f"_all_{out}")]
    if kind == "last":
        return [F.max_by(column, F.when(F.col(column).isNotNull(), F.col("_place"))).alias(f"_all_{out}")]
    if kind == "peak":
        return [F.max(f"_run_{out}").alias(f"_all_{out}"), F.sum(column).alias(f"_sum_{out}")]
    return [_FOLD[kind](column).alias(f"_all_{out}")]


def running_aggregates(df: DataFrame, keys: Sequence[str], order: Sequence[str], outs: Outs) -> DataFrame:
    """Adds the running aggregates of ``outs`` along ``order`` within ``keys``.

    Sums and peaks of nothing are 0 and NULL.  Rows that are equal in ``order``
    follow each other in any order, so it should be total.
    """
    cell = [*keys, "_range"]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
             .withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))
    window = Window.partitionBy(*cell).orderBy("_place")
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    local = [step for out, (kind, column, *left_out) in outs.items()
             for step in _local(out, kind, column, (window, so_far, before if left_out else so_far))]
    rows = dealt.select("*", *[c.alias(n) for n, c in local if n.startswith("_run_")])
    rows = written(rows.select("*", *[c.alias(n) for n, c in local if not n.startswith("_run_")]), "scan")

    states = rows.groupBy(*cell).agg(*[c for out, (kind, column, *_) in outs.items() for c in _state(out, kind, column)])
    by_key = Window.partitionBy(*keys).orderBy("_range")
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("_ranges", F.count("*").over(Window.partitionBy(*keys)))
    for out, (kind, *_) in outs.items():
        whole = F.col(f"_all_{out}")
        if kind == "peak":
            states = states.withColumn(f"_base_{out}", F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)))
            states = states.withColumn(f"_top_{out}", whole + F.col(f"_base_{out}"))
            whole = F.col(f"_top_{out}")
        carried = (F.lead(whole).over(by_key) if kind == "next" else F.last(whole, ignorenulls=True).over(earlier)
                   if kind == "last" else _FOLD[kind](whole).over(earlier))
        states = states.withColumn(f"_off_{out}", carried)
    offsets = states.filter("_ranges > 1").select(*cell, *[c for c in states.columns if c.startswith(("_off_", "_base_"))])
    offsets = written(offsets.coalesce(1), "offsets")  # at most two keys a range
    joined = join_null_safe(rows, offsets, cell, "left", small=True)

    def value(out: str, kind: str) -> Column:
        inner, carried = F.col(f"_in_{out}"), F.col(f"_off_{out}")
        if kind == "sum":
            return F.coalesce(inner, F.lit(0)) + F.coalesce(carried, F.lit(0))
        if kind == "peak":
            return F.greatest(inner + F.coalesce(f"_base_{out}", F.lit(0)), carried)
        if kind in ("last", "next"):
            return F.coalesce(inner, carried)
        return (F.greatest if kind == "max" else F.least)(inner, carried)

    return joined.select(*df.columns, *[value(out, kind).alias(out) for out, (kind, *_) in outs.items()])
