"""Universe selection by market capitalisation."""

from __future__ import annotations

import datetime
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

# Dated fallback list used when the ranking cannot be resolved.
FALLBACK_DATE = datetime.date(2026, 9, 15)
FALLBACK_SYMBOLS = ("NVDA", "AAPL", "GOOGL", "MSFT", "AMZN", "AVGO", "META", "TSLA", "MU", "AMD")


def unranked_symbols(symbols: DataFrame, caps: DataFrame) -> DataFrame:
    """Symbols without a positive capitalisation; excluded, never estimated."""
    return symbols.join(caps.filter("cap > 0"), "symbol", "left_anti")


def top_by_cap(symbols: DataFrame, caps: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest; ties keep the input position."""
    return (symbols.join(caps.filter("cap > 0"), "symbol")
            .orderBy(F.col("cap").desc(), "position").limit(n))


def resolve_universe(symbols: DataFrame, caps: DataFrame, n: int = 10,
                     fallback: Sequence[str] = FALLBACK_SYMBOLS, min_symbols: int = 50) -> DataFrame:
    """Top ``n`` if enough could be ranked, otherwise the dated fallback list."""
    spark = symbols.sparkSession
    ranked = top_by_cap(symbols, caps, n).select("symbol", F.col("cap"), "position")
    counts = (symbols.agg(F.count(F.lit(1)).alias("_listed"))
              .crossJoin(ranked.agg(F.count(F.lit(1)).alias("_ranked")))
              .select(((F.col("_listed") >= min_symbols) & (F.col("_ranked") >= n)).alias("_ok")))
    listed = spark.createDataFrame([(s, i) for i, s in enumerate(fallback[:n])], "symbol string, position int")
    found = (ranked.crossJoin(counts).filter("_ok")
             .select("symbol", "cap", F.lit(False).alias("is_fallback"), F.lit(None).cast("date").alias("as_of")))
    spare = (listed.crossJoin(counts).filter("NOT _ok")
             .select("symbol", F.lit(None).cast("double").alias("cap"), F.lit(True).alias("is_fallback"),
                     F.lit(FALLBACK_DATE).alias("as_of")))
    return found.unionByName(spare)
