import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import business_days
from tidepanel.operators import inference as inf


def trials_frame(spark, matrix):
    days = business_days(matrix.shape[0], "2000-01-03")
    rows = [("g", f"t{j:03d}", days[i], float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
    return spark.createDataFrame(rows, "ticker string, strategy string, d date, net double")


def test_sharpe_and_moments(spark):
    r = np.random.default_rng(1).standard_t(5, 400) * 0.01
    a = inf.sharpe_assessment(trials_frame(spark, r[:, None])).first()
    n, m, s = len(r), r.mean(), r.std(ddof=1)
    z = (r - m) / r.std()
    g1, g2 = (z ** 3).mean(), (z ** 4).mean() - 3
    skew = g1 * math.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3
    sr = m / s
    assert a.sharpe_row == pytest.approx(sr) and a.skew == pytest.approx(skew) and a.kurt == pytest.approx(kurt)
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    psr = 0.5 * math.erfc(-sr * math.sqrt(n - 1) / math.sqrt(spread) / math.sqrt(2))
    assert a.psr == pytest.approx(psr) and a.deflated_sharpe == pytest.approx(psr)


def test_constant_and_short_series_have_no_sharpe(spark):
    df = trials_frame(spark, np.zeros((50, 1)))
    a = inf.sharpe_assessment(df).first()
    assert a.sharpe_annual is None and a.psr is None and a.min_track_record == float("inf")
    b = inf.bootstrap_sharpe(df, replicates=20).first()
    assert (b.ci_low, b.sharpe, b.p_value) == (None, None, None)
    c = inf.bootstrap_sharpe(trials_frame(spark, np.array([[0.01], [0.02], [-0.01]])), replicates=20).first()
    assert c.ci_low is None and c.sharpe is not None


def test_expected_max_grows_with_trials(spark):
    df = spark.createDataFrame([(t, 500) for t in (1, 2, 5, 50, 1000)], "trials int, observations int")
    got = [r.expected_max_sharpe for r in inf.with_expected_max(df, F.col("trials"), inf.default_variance()).orderBy("trials").collect()]
    assert got[0] == 0.0 and got == sorted(got)
    with pytest.raises(ValueError):
        inf.with_expected_max(df, 0, inf.default_variance())


def test_best_of_many_noise_series_is_rejected(spark):
    noise = np.random.default_rng(7).normal(0, 0.01, (500, 200))
    df = trials_frame(spark, noise)
    out = inf.sharpe_assessment(df, 200, inf.trial_variance(df))
    best = out.orderBy(F.desc("sharpe_annual")).first()
    assert best.psr > 0.95 and best.deflated_sharpe < 0.95


def brute_bootstrap(r, label, replicates, mean_block=21.0):
    """The same draws, row by row."""
    m, a = 2 ** 31 - 1, 48271
    n, p = len(r), 1 / mean_block
    most = min(n, math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p)) + 10))
    out = []
    for b in range(1, replicates + 1):
        seed = int(hashlib.md5(f"42|{label}|{b}".encode()).hexdigest()[:12], 16) % (m - 1) + 1
        idx = []
        for k in range(most):
            u0, u1 = (seed * pow(a, 2 * k + j, m) % m / m for j in (0, 1))
            length = n if k == most - 1 else 1 + math.floor(math.log(u1) / math.log(1 - p))
            start = math.floor(u0 * n)
            idx += [(start + i) % n for i in range(min(length, n - len(idx)))]
            if len(idx) >= n:
                break
        out.append(r[idx])
    return out


def test_bootstrap_equals_row_by_row_resampling(spark):
    r = np.random.default_rng(3).normal(0.001, 0.01, 333)
    df = trials_frame(spark, r[:, None])
    samples = brute_bootstrap(r, "g|t000", 60)
    reps = {x.b: x for x in inf.bootstrap_replicates(df, replicates=60).collect()}
    assert len(reps) == 60
    for b, s in enumerate(samples, 1):
        assert reps[b].rows_drawn == 333
        assert reps[b].sum_r == pytest.approx(s.sum(), abs=1e-12)
        assert reps[b].sum_r2 == pytest.approx((s * s).sum(), rel=1e-10)
    sh = [s.mean() / s.std(ddof=1) * math.sqrt(252) for s in samples]
    out = inf.bootstrap_sharpe(df, replicates=60).first()
    assert out.ci_low == pytest.approx(np.quantile(sh, 0.025)) and out.ci_high == pytest.approx(np.quantile(sh, 0.975))
    hits = sum(s.mean() - r.mean() >= abs(r.mean()) for s in samples)
    assert out.p_value == pytest.approx((hits + 1) / 61)


def brute_pbo(matrix, splits):
    from itertools import combinations
    n, t = matrix.shape
    size = n // splits
    blocks = [matrix[i * size:(i + 1) * size if i < splits - 1 else n] for i in range(splits)]
    logits = []
    for chosen in combinations(range(splits), splits // 2):
        a = np.concatenate([blocks[i] for i in chosen])
        b = np.concatenate([blocks[i] for i in range(splits) if i not in chosen])
        x, y = (m.mean(0) / m.std(0, ddof=1) for m in (a, b))
        w = y[np.argmax(x)]
        rank = (y < w).sum() + ((y == w).sum() + 1) / 2
        o = rank / (t + 1)
        logits.append(math.log(o / (1 - o)))
    return np.array(logits)


def test_pbo_equals_brute_force_and_separates_skill(spark):
    rng = np.random.default_rng(5)
    noise = rng.normal(0, 0.01, (607, 15))
    want = brute_pbo(noise, 8)
    got = inf.pbo(trials_frame(spark, noise), n_splits=8).first()
    assert got.n_combinations == 70
    assert got.pbo == pytest.approx((want < 0).mean()) and got.median_logit == pytest.approx(np.median(want))
    noise[:, 3] += 0.004
    assert inf.pbo(trials_frame(spark, noise), n_splits=8).first().pbo < 0.05


def test_pbo_drops_incomplete_dates(spark):
    m = np.random.default_rng(6).normal(0, 0.01, (200, 3))
    df = trials_frame(spark, m)
    hole = df.filter(~((F.col("strategy") == "t001") & (F.dayofmonth("d") < 5)))
    blocks = inf.cscv_blocks(hole, ["ticker"], n_splits=4)
    dates = df.filter(F.dayofmonth("d") >= 5).select("d").distinct().count()
    assert blocks.filter("strategy = 't000'").agg(F.sum("n")).first()[0] == dates
    with pytest.raises(ValueError):
        inf.cscv_splits(5)


def test_splits_of_any_even_number(spark):
    table = inf.split_table(spark, 8).filter("in_sample").groupBy("combo").agg(F.sort_array(F.collect_list("block")).alias("b")).orderBy("combo").collect()
    assert [(r.combo, r.b) for r in table] == inf.cscv_splits(8)
    assert inf.split_table(spark, 18).select("combo").distinct().count() == 48_620
    m = np.random.default_rng(3).normal(0, 0.01, (200, 2))
    assert inf.pbo(trials_frame(spark, m), n_splits=18).first().n_combinations == 48_620
