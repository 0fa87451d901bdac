import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import business_days, by_date, ohlcv_frame, ordered, price_frame, random_closes
from tidepanel.operators import indicators as ind
from tidepanel.operators import states as st


def loop_latch(closes, buy=0.10, sell=0.95, history=252):
    out, inside = [], False
    for i, p in enumerate(closes):
        if i + 1 < history:
            out.append(None)
            continue
        lo, hi = min(closes[:i + 1]), max(closes[:i + 1])
        if not inside and p / lo - 1 <= buy:
            inside = True
        elif inside and p / hi >= sell:
            inside = False
        out.append(1.0 if inside else 0.0)
    return out


@pytest.mark.parametrize("seed,sd", [(1, 0.015), (2, 0.003), (3, 0.04)])
def test_mean_reversion_equals_loop(spark, seed, sd):
    closes = [float(x) for x in random_closes(900, seed, sd=sd)]
    got = ordered(st.mean_reversion(price_frame(spark, {"A": closes})), "position")
    assert got == loop_latch(closes)


def test_v_shape_buys_low_and_sells_high(spark):
    closes = np.concatenate([np.linspace(100, 50, 300), np.linspace(50, 200, 300)])
    got = ordered(st.mean_reversion(price_frame(spark, {"A": closes})), "position")
    assert got[299] == 1.0 and got[-1] == 0.0


def test_atr_equals_recursion_across_chunks(spark):
    n = 9000  # longer than one chunk
    df = ohlcv_frame(spark, n)
    rows = sorted(df.collect(), key=lambda r: r.d)
    want, y, prev = [], None, None
    for r in rows:
        tr = r.high - r.low if prev is None else max(r.high - r.low, abs(r.high - prev), abs(r.low - prev))
        y = tr if y is None else y * 13 / 14 + tr / 14
        prev = r.close
        want.append(y)
    got = ordered(ind.average_true_range(df), "atr")
    assert got[:13] == [None] * 13
    np.testing.assert_allclose(got[13:], want[13:], rtol=1e-11)


def loop_stop(rows, k=3.0):
    inside = stopped = False
    peak, out = math.nan, []
    for r in rows:
        if r.flag is None:
            out.append(None)
            continue
        if r.flag <= 0:
            inside, stopped, peak = False, False, math.nan
        elif inside:
            peak = max(peak, r.close)
            if r.atr is not None and r.close < peak - k * r.atr:
                inside, stopped = False, True
        elif not stopped:
            inside, peak = True, r.close
        out.append(1.0 if inside else 0.0)
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_atr_stop_equals_loop_with_gaps(spark, seed):
    df = ohlcv_frame(spark, 700, seed)
    state = F.pmod(F.hash("d", F.lit(seed)), F.lit(17))
    df = df.withColumn("flag", F.when(state == 0, F.lit(0.0)).when(state == 1, F.lit(None)).otherwise(F.lit(1.0)))
    out = st.atr_stop(df, multiple=2.0)
    rows = sorted(out.collect(), key=lambda r: r.d)
    assert [r.position for r in rows] == loop_stop(rows, 2.0)
    assert 0.0 in {r.position for r in rows if r.flag == 1.0}


def test_frozen_run_reports_row_after_and_open_runs(spark):
    closes = list(np.linspace(100, 120, 40)) + [120.5] * 10 + list(np.linspace(121, 130, 30)) + [131.0] * 8
    runs = {r.open_run: r for r in st.frozen_runs(price_frame(spark, {"A": closes})).collect()}
    days = business_days(len(closes))
    assert runs[False].run_days == 9 and runs[False].reported_d == days[50]
    assert runs[True].run_days == 7 and runs[True].reported_d is None


def test_cooldown_equals_greedy_loop(spark):
    df = price_frame(spark, {"A": random_closes(300, 8)}).filter("close > 99")
    kept, last = [], None
    for d in sorted(by_date(df, "close")):
        if last is None or (d - last).days >= 21:
            kept.append(d)
            last = d
    assert sorted(r.d for r in st.cooldown(df).collect()) == kept
