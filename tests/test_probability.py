import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import probability as pr


def test_norm_cdf_over_the_whole_range(spark):
    x = spark.range(-3700, 3701, 13).select((F.col("id") / 100.0).alias("x"))
    for r in x.select("x", pr.norm_cdf("x").alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-9, abs=1e-15)


def test_norm_ppf_matches_and_is_null_outside(spark):
    rows = [(p,) for p in (1e-20, 1e-9, 0.01, 0.3, 0.5, 0.93, 1 - 1e-9, 0.0, 1.0)]
    got = [r.z for r in spark.createDataFrame(rows, "p double").select(pr.norm_ppf("p").alias("z")).collect()]
    assert got[-2:] == [None, None]
    for (p,), z in zip(rows[:-2], got):
        assert z == pytest.approx(NormalDist().inv_cdf(p), abs=1e-12)


def test_t_tail_table_values(spark):
    # Printed two-sided 5% points.
    table = [(12.706204736, 1), (4.30265273, 2), (3.182446305, 3), (2.228138852, 10), (2.200985160, 11),
             (1.983971519, 100), (1.969536868, 249)]
    df = spark.createDataFrame(table, "t double, df int")
    for r in df.select(pr.t_two_sided("t", "df").alias("p")).collect():
        assert r.p == pytest.approx(0.05, abs=2e-8)


def test_t_tail_large_df_agrees_with_series(spark, monkeypatch):
    df = spark.createDataFrame([(x / 4, n) for x in range(1, 40) for n in (61, 150, 399)], "t double, df int")
    near = df.select(pr.t_two_sided("t", "df").alias("p")).collect()
    monkeypatch.setattr(pr, "T_SERIES_MAX_DF", 1000)
    exact = df.select(pr.t_two_sided("t", "df").alias("p")).collect()
    assert max(abs(a.p - b.p) for a, b in zip(near, exact)) < 1e-11
