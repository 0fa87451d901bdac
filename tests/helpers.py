"""Seeded fixtures and row access for the tests."""

import datetime

import numpy as np
import pandas as pd


def business_days(n, start="2021-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def random_closes(n=800, seed=1, drift=0.0003, sd=0.015):
    rng = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(rng.normal(drift, sd, n)))


def price_frame(spark, series):
    """``{ticker: closes}`` to (ticker, d, close)."""
    rows = [(t, d, float(c)) for t, closes in series.items()
            for d, c in zip(business_days(len(closes)), closes)]
    return spark.createDataFrame(rows, "ticker string, d date, close double")


def ohlcv_frame(spark, n=900, seed=3, ticker="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.018, n)))
    high = close * (1 + np.abs(rng.normal(0, 0.008, n)))
    low = close * (1 - np.abs(rng.normal(0, 0.008, n)))
    volume = rng.integers(1_000_000, 5_000_000, n).astype(float)
    rows = [(ticker, d, float(c), float(h), float(lo), float(c), float(v))
            for d, c, h, lo, v in zip(business_days(n, "2022-01-03"), close, high, low, volume)]
    return spark.createDataFrame(rows, "ticker string, d date, open double, high double, low double, close double, volume double")


def by_date(df, column, ticker=None):
    rows = df.collect()
    return {r["d"]: r[column] for r in rows if ticker is None or r["ticker"] == ticker}


def ordered(df, column):
    return [v for _, v in sorted(by_date(df, column).items())]


def day(text):
    return datetime.date.fromisoformat(text)
