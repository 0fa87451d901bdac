import random

import pytest
from pyspark.sql import Window, functions as F

from tidepanel.operators import quantiles, running


@pytest.mark.parametrize("ranges", [1, 8, 60])
def test_ranges_equal_plain_windows(spark, ranges):
    """NULL is a key like any other, and one key holds most rows."""
    rng = random.Random(5)
    rows = [(k, rng.randrange(6), i, rng.randrange(-50, 50), rng.choice([None, i])) for i, k in enumerate([rng.choice(["a", "a", "a", "b", None]) for _ in range(3000)])]
    df = spark.createDataFrame(rows, "k string, day int, i int, v long, x int")
    w = Window.partitionBy("k").orderBy("day", "i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("run", F.sum("v").over(upto)).select(
        "i", F.col("run").alias("s"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("sb"), F.max("v").over(upto).alias("hi"), F.min("v").over(before).alias("lo"),
        F.max("run").over(upto).alias("p"), F.max("run").over(before).alias("pb"), F.last("x", True).over(upto).alias("l"), F.lead("i").over(w).alias("n"))
    outs = {"s": ("sum", "v"), "sb": ("sum", "v", "before"), "hi": ("max", "v"), "lo": ("min", "v", "before"), "p": ("peak", "v"), "pb": ("peak", "v", "before"),
            "l": ("last", "x"), "n": ("next", "i")}
    before_ranges = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        found = running.running_aggregates(df, ["k"], ["day", "i"], outs).select(plain.columns).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before_ranges)
    assert sorted(found) == sorted(plain.collect())


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 1.0])
def test_exact_quantiles(spark, p):
    """Several columns at once, whole-number weights, a key without values and one without a name."""
    rng = random.Random(9)
    rows = [("skew", float(int(rng.lognormvariate(0, 2))), rng.random(), 1 + i % 4) for i in range(2001)]
    rows += [(None, rng.gauss(0, 1e6), None, 1) for _ in range(1000)] + [("one", 3.0, 4.0, 7), ("none", None, None, 2)]
    df = spark.createDataFrame(rows, "k string, v double, x double, w int")
    for weight in (None, "w"):
        count = F.col(weight) if weight else F.lit(1)
        got = quantiles.exact_quantiles(df, ["k"], {"q": "v", "r": "x"}, p, weight).collect()
        want = df.groupBy("k").agg(F.percentile("v", F.lit(p), count).alias("q"), F.percentile("x", F.lit(p), count).alias("r")).collect()
        near = lambda x: None if x is None else pytest.approx(x, rel=1e-12)
        assert {r.k: (near(r.q), near(r.r)) for r in want} == {r.k: (r.q, r.r) for r in got}
