import random
from collections import deque

import pytest

from helpers import business_days, price_frame, random_closes
from tidepanel.operators import ledger as lg
from tidepanel.plans import panel as pn
from tidepanel.sources.dimensions import tax_models

SCHEMA = ("account string, d date, order_id long, line_no int, part_id long, kind string, qty double, "
          "amount double, price double")


def make(spark, trades):
    days = business_days(max(400, len(trades) // 3 + 1))
    rows = [(a, days[i // 3], i, 1, 1, kind, float(q), float(q * p), float(p)) for i, (a, kind, q, p) in enumerate(trades)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(trades):
    """First-in first-out with queues: (account, index) -> cost, and what is left."""
    lots, costs = {}, {}
    for i, (a, kind, q, p) in enumerate(trades):
        queue = lots.setdefault(a, deque())
        if kind == "BUY":
            queue.append([q, p])
            continue
        left, cost = q, 0.0
        while left > 1e-9 and queue:
            use = min(left, queue[0][0])
            cost += use * queue[0][1]
            queue[0][0] -= use
            left -= use
            if queue[0][0] <= 1e-9:
                queue.popleft()
        costs[(a, i)] = (cost, q - left)
    return costs, {a: sum(x[0] for x in q) for a, q in lots.items()}


@pytest.mark.parametrize("stretch", [5_000, 20])
def test_fifo_equals_queues_even_when_oversold(spark, stretch):
    rng = random.Random(4)
    trades = [(rng.choice("aaab"), rng.choice(["BUY", "SELL"]), rng.randrange(1, 60), rng.randrange(10, 99)) for _ in range(900)]
    trades.append(("b", "BUY", 5000, 11))
    trades.append(("b", "SELL", 4000, 12))
    costs, left = brute(trades)
    covered = lg.covered_trades(make(spark, trades))
    gains = lg.realized_gains(covered, lg.fifo_match(covered, stretch_rows=stretch), 0.15).collect()
    assert len(gains) == len(costs)
    for r in gains:
        cost, matched = costs[(r.account, r.order_id)]
        assert r.cost_basis == pytest.approx(cost) and r.matched_qty == pytest.approx(matched)
        assert r.tax == pytest.approx(max(r.qty * r.price - cost, 0) * 0.15)
    got = {r.account: r.open_qty for r in lg.unrealized_gains(covered).collect()}
    assert got == pytest.approx(left)


def test_stretches_follow_rows_not_quantity(spark):
    trades = [("a", "BUY", 10 ** 9, 10)] + [("a", "SELL" if k % 2 else "BUY", 1 + k % 7, 11) for k in range(3000)] + [("a", "SELL", 10 ** 9, 12)]
    covered = lg.covered_trades(make(spark, trades))
    per_cell = lg.stretches(covered, ["account"], 100).groupBy("_cell").count().collect()
    assert len(per_cell) > 10 and max(r["count"] for r in per_cell) <= 200
    whole = {(r.sale_seq, r.lot_seq): r.matched_qty for r in lg.fifo_match(covered).collect()}
    assert whole == {(r.sale_seq, r.lot_seq): r.matched_qty for r in lg.fifo_match(covered, stretch_rows=100).collect()}


def test_balances_are_the_same_for_any_ranges(spark):
    rng = random.Random(8)
    trades = [("a", rng.choice(["BUY", "SELL"]), rng.randrange(1, 999) / 8, rng.randrange(1000, 9999) / 97) for _ in range(800)]
    entries = lg.ledger_entries(make(spark, trades), 0.00137)
    runs = []
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for ranges in (1, 7, 50):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        runs += [sorted((r.order_id, r.cash_after, r.shares_after) for r in lg.running_balance(entries.repartition(n)).collect()) for n in (1, 5)]
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert all(run == runs[0] for run in runs)


def test_an_account_without_a_name_is_an_account(spark):
    rng = random.Random(11)
    trades = [(rng.choice([None, None, "b"]), rng.choice(["BUY", "SELL"]), rng.randrange(1, 60), rng.randrange(10, 99)) for _ in range(600)]
    costs, left = brute(trades)
    frame = make(spark, trades)
    assert lg.running_balance(lg.ledger_entries(frame)).count() == len(trades)
    covered = lg.covered_trades(frame)
    gains = lg.realized_gains(covered, lg.fifo_match(covered, stretch_rows=20)).collect()
    assert {(r.account, r.order_id): pytest.approx((r.cost_basis, r.matched_qty)) for r in gains} == costs
    assert {r.account: r.open_qty for r in lg.unrealized_gains(covered).collect()} == pytest.approx(left)
    assert lg.ledger_totals(lg.running_balance(lg.ledger_entries(frame))).count() == 2


def test_the_ledger_is_read_once(spark, sf_dir):
    covered = lg.covered_trades(pn.ledger_trades(spark, sf_dir))
    plan = lg.realized_gains(covered, lg.fifo_match(covered), 0.15)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("FileScan") <= 4, plan  # the written rows and few offsets, for sales and for lots


def test_two_lots(spark):
    covered = lg.covered_trades(make(spark, [("a", "BUY", 100, 10), ("a", "BUY", 100, 20), ("a", "SELL", 100, 30)]))
    r = lg.realized_gains(covered, lg.fifo_match(covered)).first()
    assert (r.cost_basis, r.gain) == (1000.0, 2000.0)
    assert lg.oversold_accounts(covered).isEmpty()


def test_balances_follow_the_ledger(spark):
    rng = random.Random(6)
    trades = [("a", rng.choice(["BUY", "SELL"]), rng.randrange(1, 9), rng.randrange(10, 99)) for _ in range(300)]
    out = sorted(lg.running_balance(lg.ledger_entries(make(spark, trades), 0.001)).collect(), key=lambda r: r.order_id)
    cash = shares = 0.0
    for r, (_, kind, q, p) in zip(out, trades):
        sign = -1 if kind == "BUY" else 1
        cash += sign * q * p - q * p * 0.001
        shares -= sign * q
        assert r.cash_after == pytest.approx(cash) and r.shares_after == shares
    totals = lg.ledger_totals(spark.createDataFrame(out)).first()
    assert totals.buys + totals.sells == 300 and totals.final_cash == pytest.approx(cash)
    wrong = spark.createDataFrame(out).withColumn("cash_noted", lg.F.col("cash_after") + (lg.F.col("order_id") == 7).cast("int"))
    assert lg.ledger_mismatches(wrong, "cash_noted", "shares_after").count() == 1


@pytest.mark.parametrize("chronological", [False, True])
def test_hold_statement_equals_loop(spark, chronological):
    closes = random_closes(800, 4)
    df = price_frame(spark, {"A": closes})
    days = business_days(800)
    paid = {days[i]: 0.4 + i / 1000 for i in (0, 100, 333, 500, 799)}
    div = spark.createDataFrame([("A", d, v) for d, v in paid.items()], "ticker string, d date, per_share double")
    got = {r.regime: r for r in lg.hold_statement(df, div, tax_models(spark), chronological=chronological).collect()}
    for regime, gains, wh, loc, wealth in [("NONE", 0, 0, 0, 0), ("ADR", 0.15, 0.3, 0, 0.0125), ("CEDEAR", 0, 0.3, 0.07, 0.0125)]:
        cash = -100 * closes[0] * 0.0005
        net = {d: 100 * v * (1 - wh - loc) for d, v in paid.items()}
        if not chronological:
            cash += sum(net.values())
        for y in sorted({d.year for d in days}):
            if chronological:
                cash += sum(v for d, v in net.items() if d.year == y)
            last = max(i for i, d in enumerate(days) if d.year == y)
            cash -= max(100 * closes[last] + cash, 0) * wealth
        r = got[regime]
        assert r.final_cash == pytest.approx(cash) and r.final_value == pytest.approx(100 * closes[-1] + cash)
        latent = 100 * (closes[-1] - closes[0])
        assert r.value_if_sold == pytest.approx(r.final_value - max(latent, 0) * gains)


def test_perfect_foresight_dominates(spark):
    closes = [float(c) for c in random_closes(500, 12)]
    r = lg.best_buy_then_sell(price_frame(spark, {"A": closes})).first()
    best = max((max(closes[i:]) / p, -i) for i, p in enumerate(closes))
    i = -best[1]
    assert r.buy_price == closes[i] and r.sell_price == max(closes[i:]) and r.final_value >= r.capital * closes[-1] / closes[0] * 0.998


def test_dividends_need_shares(spark):
    days = business_days(5)
    pos = spark.createDataFrame([("A", days[i], 100.0 if i == 1 else None) for i in range(5)], "ticker string, d date, shares double")
    div = spark.createDataFrame([("A", days[0], 2.0), ("A", days[3], 1.5)], "ticker string, d date, per_share double")
    assert [(r.d, r.gross) for r in lg.dividend_cashflows(pos, div).collect()] == [(days[3], 150.0)]
