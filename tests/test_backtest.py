import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from helpers import business_days, ohlcv_frame, ordered, price_frame, random_closes
from tidepanel.operators import backtest as bt
from tidepanel.operators import indicators as ind
from tidepanel.operators import signals as sg
from tidepanel.operators.states import atr_stop


@pytest.fixture(scope="module")
def closes(spark):
    return price_frame(spark, {"A": random_closes(800, 1), "B": random_closes(700, 2)}).cache()


def test_first_position_is_zero_and_lag_is_required(closes):
    p = bt.run_backtest(sg.strategy_grid(closes))
    first = p.groupBy("ticker", "strategy").agg(F.min_by("executed", "d").alias("x")).collect()
    assert {r.x for r in first} == {0.0}
    with pytest.raises(ValueError):
        bt.run_backtest(closes.withColumn("strategy", F.lit("x")).withColumn("flag", F.lit(1.0)), lag=0)


def test_backtest_equals_pandas_loop(spark, closes):
    df = closes.filter("ticker = 'A'").withColumn("strategy", F.lit("s")).withColumn(
        "flag", F.when(F.dayofmonth("d") < 4, F.lit(None)).when(F.month("d") % 2 == 0, 1.0).otherwise(0.0))
    rows = sorted(bt.run_backtest(df, 0.001).collect(), key=lambda r: r.d)
    held, executed, equity, prev = None, 0.0, 1.0, None
    for i, r in enumerate(rows):
        now = held if held is not None else 0.0
        change = abs(now - executed)
        ret = 0.0 if prev is None else r.close / prev - 1
        net = now * ret - change * 0.001
        equity = 1.0 if i == 0 else equity * (1 + net)
        assert r.executed == now and r.net == pytest.approx(net, abs=1e-15)
        assert r.equity == pytest.approx(equity, rel=1e-12)
        last_of_week = i + 1 == len(rows) or rows[i + 1].d.isocalendar()[1] != r.d.isocalendar()[1]
        if last_of_week and r.flag is not None:
            held = r.flag
        executed, prev = now, r.close


def test_costs_reduce_the_return(closes):
    grid = sg.strategy_grid(closes)
    cheap = {(r.ticker, r.strategy): r.net_return for r in bt.strategy_summary(bt.run_backtest(grid, 0.0)).collect()}
    dear = {(r.ticker, r.strategy): r for r in bt.strategy_summary(bt.run_backtest(grid, 0.01)).collect()}
    for k, r in dear.items():
        assert r.net_return < cheap[k] or r.trades == 0


@pytest.mark.parametrize("cut", [400, 650])
def test_signals_are_causal(spark, cut):
    """Dropping the future changes nothing in the past."""
    full = ohlcv_frame(spark, 800, 11)
    keep = sorted(r.d for r in full.select("d").collect())[:cut]
    short = full.filter(F.col("d") <= F.lit(keep[-1]))
    for build in (lambda d: sg.build_signals(d).select("d", F.col("flag").alias("x")),
                  lambda d: sg.reversion(d).select("d", F.col("flag").alias("x")),
                  lambda d: atr_stop(sg.build_signals(d)).select("d", F.col("position").alias("x")),
                  lambda d: sg.vol_target_weight(d).select("d", F.col("weight").alias("x"))):
        a = {r.d: r.x for r in build(full).collect()}
        b = {r.d: r.x for r in build(short).collect()}
        assert b == {d: a[d] for d in keep}


def test_first_momentum_row(spark, closes):
    got = ordered(closes.filter("ticker = 'A'").select("ticker", "d", ind.momentum_col(ind.by_series()).alias("m")), "m")
    assert got[272] is None and got[273] is not None


def test_weights_never_exceed_one(closes):
    w = sg.vol_target_weight(closes, target=5.0).agg(F.max("weight")).first()[0]
    assert w == 1.0


def test_drawdown_dates(spark):
    df = price_frame(spark, {"A": [100, 120, 90, 110, 120, 90, 130]})
    r = ind.max_drawdown(df, "close").first()
    days = business_days(7)
    assert r.max_drawdown == pytest.approx(-0.25)
    assert (r.drawdown_peak, r.drawdown_trough) == (days[1], days[2])


def test_walk_forward_equals_separate_runs(spark, closes):
    """One pass gives what a fresh run on every shorter history gives."""
    grid = sg.strategy_grid(closes.filter("ticker = 'A'"), [sg.catalog()[0]])
    panel = bt.run_backtest(grid)
    folds, summary = bt.walk_forward(panel)
    size = (800 - 252) // 4
    days = business_days(800)
    for f in folds.collect():
        end = 252 + (f.fold - 1) * size
        short = sg.strategy_grid(closes.filter("ticker = 'A'").filter(F.col("d") <= F.lit(days[end - 1])), [sg.catalog()[0]])
        alone = bt.strategy_summary(bt.run_backtest(short)).first()
        assert f.train_to == days[end - 1] and f.test_from == days[end]
        if alone.sharpe is None:
            assert f.sharpe_is is None
        else:
            assert f.sharpe_is == pytest.approx(alone.sharpe, rel=1e-9)
    assert summary.first().folds == 4


def above_mean(df):
    """Looks ahead: the mean is that of the whole history it is given."""
    return df.withColumn("flag", (F.col("close") > F.avg("close").over(Window.partitionBy("ticker"))).cast("double"))


def test_folds_of_a_builder_that_looks_ahead(spark, closes):
    """Each fold is what a run on its own history gives; the whole history would give something else."""
    two = closes.filter("ticker IN ('A', 'B')")
    folds, summary = bt.walk_forward_builder(two, above_mean)
    length, days = {"A": 800, "B": 700}, business_days(800)
    rows = {(r.ticker, r.fold): r for r in folds.collect()}
    assert len(rows) == 8
    for (ticker, fold), r in rows.items():
        size = (length[ticker] - 252) // 4
        begin = 252 + (fold - 1) * size
        end = begin + size if fold < 4 else length[ticker]
        known = lambda n: closes.filter((F.col("ticker") == ticker) & (F.col("d") <= F.lit(days[n - 1])))
        train = bt.run_backtest(above_mean(known(begin)), keys=("ticker",))
        tested = bt.run_backtest(above_mean(known(end)), keys=("ticker",)).filter(F.col("d") >= F.lit(days[begin]))
        assert (r.train_to, r.test_from, r.test_to) == (days[begin - 1], days[begin], days[end - 1])
        near = lambda df: (lambda x: None if x is None else pytest.approx(x, rel=1e-9))(df.agg(bt.sharpe_agg("net").alias("s")).first().s)
        assert (r.sharpe_is, r.sharpe_oos) == (near(train), near(tested))
    causal, _ = bt.walk_forward(bt.run_backtest(above_mean(two), keys=("ticker",)), keys=("ticker",))
    assert any(abs((r.sharpe_is or 0) - (rows[(r.ticker, r.fold)].sharpe_is or 0)) > 1e-3 for r in causal.collect())
    assert {r.folds for r in summary.collect()} == {4}


def test_builder_folds_equal_the_one_pass_of_a_causal_flag(spark, closes):
    build = lambda df: sg.momentum_trend(df)
    one, one_sum = bt.walk_forward(bt.run_backtest(build(closes), keys=("ticker",)), keys=("ticker",))
    many, many_sum = bt.walk_forward_builder(closes, build)
    near = lambda x: None if x is None else pytest.approx(x, rel=1e-9, abs=1e-12)
    assert [tuple(map(lambda v: near(v) if isinstance(v, float) else v, r)) for r in one.orderBy("ticker", "fold").collect()] == [tuple(r) for r in many.orderBy("ticker", "fold").collect()]
    assert {r.ticker: near(r.oos_sharpe) for r in one_sum.collect()} == {r.ticker: r.oos_sharpe for r in many_sum.collect()}


def test_short_series_has_no_folds(spark):
    df = price_frame(spark, {"S": random_closes(300, 3)})
    folds, summary = bt.walk_forward(bt.run_backtest(sg.strategy_grid(df)))
    assert folds.isEmpty() and summary.isEmpty()


def test_rebalance_rules(spark, closes):
    a = closes.filter("ticker = 'A'")
    n = {rule: bt.rebalance_rows(a, rule).filter("is_rebalance").count() for rule in ("D", "W-FRI", "M")}
    assert n["D"] == 800 and 155 <= n["W-FRI"] <= 165 and 36 <= n["M"] <= 38
    with pytest.raises(ValueError):
        bt.rebalance_rows(a, "Q").count()


def test_rank_averages_ties(spark):
    up = np.linspace(100, 200, 300)
    df = price_frame(spark, {"A": up, "B": up, "C": np.linspace(100, 90, 300), "D": np.linspace(100, 400, 300)})
    last = business_days(300)[-1]
    got = {r.ticker: r.momentum_rank for r in ind.momentum_rank(df).filter(F.col("d") == F.lit(last)).collect()}
    assert got == {"A": 0.625, "B": 0.625, "C": 0.25, "D": 1.0}
