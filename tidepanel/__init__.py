"""Spark-native analytics for panels of daily time series.

Every public function takes and returns DataFrames (or Columns).  A *daily
panel* is a long table with one row per ``(series keys, d)``; a series can
therefore never hold more rows than there are calendar days, which is the size
bound all per-series windows rely on.
"""

__version__ = "0.1.0"
