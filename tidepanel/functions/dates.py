"""Calendar helpers; dates carry no time and no zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidepanel.functions.numeric import as_col


def parse_day(text: Column | str) -> Column:
    """``YYYY-MM-DD`` to a date; anything else is NULL."""
    return F.try_to_date(as_col(text), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(as_col(text), "yyyy-MM-dd")


def month_start(d: Column | str) -> Column:
    """First day of the month, under which monthly tables are joined."""
    return F.to_date(F.trunc(as_col(d), "MM"))


def is_year_end(d: Column | str, from_day: int = 28) -> Column:
    """The last days of a year, on which holding taxes are assessed."""
    return (F.month(as_col(d)) == 12) & (F.dayofmonth(as_col(d)) >= from_day)


def days_since(d: Column | str, start: str) -> Column:
    return F.datediff(as_col(d), F.lit(start).cast("date"))
