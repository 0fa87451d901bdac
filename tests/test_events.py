import datetime

import numpy as np
import pytest

from helpers import business_days
from tidepanel.operators import event_study as ev


def panel(spark, shock=0.0, at=500, n=600, seed=2, missing=()):
    rng = np.random.default_rng(seed)
    market = rng.normal(0.0004, 0.011, n)
    asset = 0.0001 + 1.4 * market + rng.normal(0, 0.006, n)
    asset[at] += shock
    days = business_days(n)
    rows = [("A", days[i], float(asset[i]), None if i in missing else float(market[i])) for i in range(n)]
    return days, asset, market, spark.createDataFrame(rows, "ticker string, d date, r double, market_r double")


def events(spark, dates, category="c"):
    return spark.createDataFrame([(i, "A", d, category) for i, d in enumerate(dates)],
                                 "event_id int, ticker string, event_date date, category string")


def brute(asset, market, p, missing=()):
    rows = [i for i in range(max(0, p - 280), p - 29) if i not in missing]
    x, y = market[rows], asset[rows]
    beta = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    alpha = y.mean() - beta * x.mean()
    resid = y - alpha - beta * x
    win = [i for i in range(max(0, p - 1), min(len(asset), p + 4)) if i not in missing]
    car = sum(asset[i] - alpha - beta * market[i] for i in win)
    sd = np.sqrt((resid ** 2).sum() / (len(rows) - 2))
    return alpha, beta, sd, len(rows), car, car / (sd * np.sqrt(len(win)))


def test_equals_brute_force_with_gaps_and_edges(spark):
    missing = {200, 310, 499, 500, 501, 502}
    days, asset, market, df = panel(spark, missing=missing)
    at = [130, 150, 400, 501, 598, 599]
    out = {r.event_id: r for r in ev.event_results(events(spark, [days[i] for i in at]), df).collect()}
    for k, p in enumerate(at):
        alpha, beta, sd, n, car, t = brute(asset, market, p, missing)
        r = out[k]
        assert (r.anchor_d, r.estimation_obs) == (days[p], n)
        assert r.beta == pytest.approx(beta, rel=1e-9) and r.residual_sd == pytest.approx(sd, rel=1e-9)
        assert r.car == pytest.approx(car, rel=1e-8, abs=1e-12) and r.car_t == pytest.approx(t, rel=1e-8)


def test_weekend_event_anchors_on_monday_and_reasons(spark):
    days, *_, df = panel(spark)
    friday = next(d for d in days[300:] if d.weekday() == 4)
    late = days[-1] + datetime.timedelta(days=1)
    out = {r.event_id: r for r in ev.event_results(
        events(spark, [friday + datetime.timedelta(days=1), days[50], late]), df).collect()}
    assert out[0].anchor_d == friday + datetime.timedelta(days=3)
    assert out[1].skipped == "INSUFFICIENT_HISTORY" and out[2].skipped == "NO_LATER_ROW"


def test_shock_is_found_and_beta_recovered(spark):
    days, *_, df = panel(spark, shock=0.12)
    hit = ev.event_results(events(spark, [days[500]]), df).first()
    assert hit.beta == pytest.approx(1.4, abs=0.1) and hit.car == pytest.approx(0.12, abs=0.04) and hit.car_p < 0.05


def test_abnormal_rows_add_up_to_car(spark):
    days, *_, df = panel(spark, shock=0.05)
    e = events(spark, [days[500], days[450]])
    parts = {}
    for r in ev.event_abnormal(e, df).collect():
        parts[r.anchor_d] = parts.get(r.anchor_d, 0) + r.abnormal_r
    for r in ev.event_results(e, df).collect():
        assert parts[r.anchor_d] == pytest.approx(r.car)


def test_caar_counts_every_event(spark):
    days, *_, df = panel(spark, seed=9)
    dates = [days[300 + 25 * i] for i in range(8)]
    e = events(spark, dates + dates[:3], "x").unionByName(events(spark, dates[:2], "few"))
    res = ev.event_results(e, df)
    cars = np.array([r.car for r in res.filter("category = 'x'").collect()])
    out = {r.category: r for r in ev.caar_by_category(res).collect()}
    x = out["x"]
    assert x.n_events == 11 and x.mean_car == pytest.approx(cars.mean()) and x.median_car == pytest.approx(np.median(cars))
    assert x.t_stat == pytest.approx(cars.mean() / (cars.std(ddof=1) / np.sqrt(11)))
    assert x.hit_rate == pytest.approx((cars > 0).mean())
    assert out["few"].verdict == "TOO_FEW_EVENTS"


def test_recent_events_limits_before_the_shuffle(spark):
    days, *_, df = panel(spark)
    plan = ev.recent_events(events(spark, days), 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
