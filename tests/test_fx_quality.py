import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import business_days, day, ordered, price_frame
from tidepanel.operators import fx, quality as ql


@pytest.fixture(scope="module")
def split(spark):
    days = business_days(120, "2026-06-01")
    rows = [("Y", d, 1450.0 * 50 / (10 if d >= day("2026-08-04") else 1), 1450.0 * 50 / 10, 50.0) for d in days]
    df = spark.createDataFrame(rows, "ticker string, d date, raw double, adj double, adr double")
    hist = spark.createDataFrame([("Y", day("1993-01-01"), 1.0), ("Y", day("2026-08-04"), 10.0)],
                                 "ticker string, valid_from date, ratio double")
    return df, hist


def rate(split, column, adjusted):
    df, hist = split
    return fx.implied_rate(df.select("ticker", "d", F.col(column).alias("local")), df.select("ticker", "d", "adr"), hist, adjusted)


def test_true_rate_recovered_both_ways(split):
    for column, adjusted in (("adj", True), ("raw", False)):
        assert {round(v, 9) for v in ordered(rate(split, column, adjusted), "rate")} == {1450.0}


def test_wrong_split_is_flagged(split):
    ok = [r.flagged for r in fx.rate_continuity(rate(split, "adj", True), split[1]).collect()]
    bad = fx.rate_continuity(rate(split, "raw", True), split[1]).first()
    assert ok == [False]
    assert bad.flagged and bad.split_hint == 0.1 and not bad.usable


def test_ratio_before_history_is_null(spark, split):
    df = spark.createDataFrame([("Y", day("1990-01-01")), ("Y", day("2026-08-04")), ("Y", day("2026-08-03"))], "ticker string, d date")
    got = {str(r.d): r.ratio for r in fx.ratio_asof(df, split[1]).collect()}
    assert got == {"1990-01-01": None, "2026-08-04": 10.0, "2026-08-03": 1.0}


def test_level_gap(spark, split):
    r = rate(split, "adj", True)
    for official, want in ((1000.0, "PLAUSIBLE"), (100.0, "GAP_TOO_WIDE"), (2000.0, "BELOW_OFFICIAL")):
        o = r.select("ticker", "d", F.lit(official).alias("official_rate"))
        assert fx.rate_level_gap(r, o).first().level == want
    few = r.limit(5).select("ticker", "d", F.lit(1.0).alias("official_rate"))
    assert fx.rate_level_gap(r, few).first().level == "NOT_VALIDATED"


def test_too_little_overlap_gives_no_rate(spark, split):
    df, hist = split
    short = df.orderBy("d").limit(10)
    out = fx.implied_rate(short.select("ticker", "d", F.col("adj").alias("local")), df.select("ticker", "d", "adr"), hist)
    assert out.isEmpty()
    assert ql.overlap_rejects(short, df).first().overlap == 10


def test_deflate_does_not_extrapolate(spark):
    df = price_frame(spark, {"A": [1000.0] * 120})
    idx = spark.createDataFrame([(day("2021-01-01"), 100.0), (day("2021-02-01"), 110.0), (day("2021-03-01"), 121.0), (day("2021-04-01"), 133.1)],
                                "month date, level double")
    out = fx.deflate(df, idx)
    got = {r.d: r.real for r in out.collect()}
    assert max(got) < day("2021-05-01") and got[day("2021-01-04")] == pytest.approx(1331.0)
    hole = fx.deflate(df, idx.filter("month <> DATE '2021-02-01'"))
    assert not [r for r in hole.collect() if r.d.month == 2]
    based = fx.deflate(df, idx, base_month="2021-01-01")
    assert {r.d: r.real for r in based.collect()}[day("2021-01-04")] == pytest.approx(1000.0)


def test_reconcile(spark):
    a = price_frame(spark, {"A": [100.0] * 60, "B": [50.0] * 60})
    b = price_frame(spark, {"A": [100.0] * 30 + [150.0] + [100.0] * 29})
    out = {r.ticker: r for r in ql.reconcile(a, b).collect()}
    assert out["A"].days_over_tolerance == 1 and out["A"].days == str(business_days(60)[30]) and not out["A"].clean
    assert not out["B"].secondary_available and not out["B"].clean
    same = {r.ticker: r.clean for r in ql.reconcile(a, a).collect()}
    assert same == {"A": True, "B": True}


def test_anomalies(spark):
    rng = np.random.default_rng(1)
    closes = np.concatenate([np.full(100, 1000.0), np.full(100, 100.0)]) + rng.normal(0, 1, 200)
    kinds = ql.data_anomalies(price_frame(spark, {"A": closes})).collect()
    assert [(r.kind, r.d) for r in kinds] == [("EXTREME_JUMP", business_days(200)[100])]
    bad = price_frame(spark, {"A": [5.0, -1.0, 5.0]})
    assert {r.kind for r in ql.data_anomalies(bad.unionByName(bad.filter("close = 5"))).collect()} == {"NON_POSITIVE_PRICE", "DUPLICATE_DATE"}
