"""Null-safe numeric column helpers.

Undefined values are NULL everywhere; NaN is turned into NULL at ingest because
Spark orders NaN above every number.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, Window, WindowSpec, functions as F

ROWS_PER_YEAR = 252
ROWS_PER_MONTH = 21


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c), c)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clamp; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    c = as_col(c)
    out = c
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    return F.when(c.isNotNull(), out)


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division that yields NULL on a zero or NULL divisor."""
    return F.try_divide(as_col(a), as_col(b))


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Output rounding; adding zero turns -0.0 into 0.0."""
    return F.round(as_col(c), digits) + F.lit(0.0)


def by_series(keys: Sequence[str] = ("ticker",), order: str = "d") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    """The last ``rows`` rows including the current one."""
    return w.rowsBetween(-(rows - 1), Window.currentRow)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def at_least(value: Column, counted: Column | str, frame: WindowSpec, rows: int) -> Column:
    """NULL unless the frame holds ``rows`` non-null observations."""
    return F.when(F.count(as_col(counted)).over(frame) >= rows, value)
