"""Accounts: running balances, first-in first-out lots, taxes, statements."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import by_series, ratio
from tidepanel.operators.indicators import KEYS, extremes_cols
from tidepanel.operators.running import from_units, join_null_safe, running_aggregates, units
from tidepanel.runtime import written

ACCOUNT = ("account",)
ORDER = ("d", "order_id", "line_no", "part_id", "amount", "qty", "kind")


def ledger_entries(trades: DataFrame, cost: float = 0.0005) -> DataFrame:
    """Cash effect of every trade: costs add to a buy and reduce a sale.  Amounts
    are whole cents, costs and net whole millionths, so that sums stay clean."""
    sign = F.when(F.col("kind") == "BUY", -1).otherwise(1)
    return (trades.withColumn("gross", F.round(F.col("qty") * F.col("price"), 2))
            .withColumn("costs", F.round(F.col("gross") * cost, 6))
            .withColumn("net", F.round(sign * F.col("gross") - F.col("costs"), 6))
            .withColumn("signed_qty", -sign * F.col("qty")))


def running_balance(entries: DataFrame, keys: Sequence[str] = ACCOUNT, order: Sequence[str] = ORDER) -> DataFrame:
    """Holdings and cash after every entry, rebuilt from the ledger alone.  Both are
    summed in whole millionths, so no order of summation changes a digit."""
    rows = entries.withColumn("_shares", units("signed_qty")).withColumn("_cash", units("net"))
    outs = {"_shares_sum": ("sum", "_shares"), "_cash_sum": ("sum", "_cash")}
    return (running_aggregates(rows, keys, order, outs)
            .withColumn("shares_after", from_units("_shares_sum")).withColumn("cash_after", from_units("_cash_sum"))
            .drop("_shares", "_cash", "_shares_sum", "_cash_sum"))


def ledger_mismatches(balances: DataFrame, recorded_cash: str, recorded_shares: str,
                      tolerance: float = 1e-6) -> DataFrame:
    """Entries whose recorded balance differs from the rebuilt one."""
    return balances.filter((F.abs(F.col("cash_after") - F.col(recorded_cash)) > tolerance)
                           | (F.abs(F.col("shares_after") - F.col(recorded_shares)) > tolerance))


def ledger_totals(balances: DataFrame, keys: Sequence[str] = ACCOUNT) -> DataFrame:
    """Counts and sums per account, and whether outside money was ever needed."""

    def total(kind: str, column: str) -> Column:
        return from_units(F.coalesce(F.sum(F.when(F.col("kind") == kind, units(column))), F.lit(0)))

    return balances.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "BUY").alias("buys"), F.count_if(F.col("kind") == "SELL").alias("sells"),
        total("BUY", "gross").alias("bought"), total("SELL", "gross").alias("sold"),
        total("DIVIDEND", "net").alias("dividends"),
        from_units(F.sum(units("costs"))).alias("total_costs"), from_units(F.sum(units("net"))).alias("final_cash"),
        F.bool_or(F.col("cash_after") < -1e-6).alias("needed_outside_money"),
        (F.count_if(F.col("kind").isin("BUY", "SELL")) == 0).alias("never_traded"))


# --- first in, first out ---------------------------------------------------

def covered_trades(trades: DataFrame, keys: Sequence[str] = ACCOUNT, order: Sequence[str] = ORDER) -> DataFrame:
    """Every trade as an interval ``(lo, hi]`` of the cumulative quantity line.

    Buys tile the line by quantity bought, sales by quantity actually covered.
    A sale beyond the holdings is covered only as far as there are shares; the
    rest has no cost and later buys stay untouched.  The uncovered total up to a
    row is the running maximum of sold minus bought, floored at zero.  ``lo``,
    ``hi`` and ``uncovered`` are whole millionths of a share.
    """
    base = (trades.withColumn("_one", F.lit(1).cast("long"))
            .withColumn("_buy", F.when(F.col("kind") == "BUY", units("qty")).otherwise(0))
            .withColumn("_sell", F.when(F.col("kind") == "SELL", units("qty")).otherwise(0))
            .withColumn("_more", F.col("_sell") - F.col("_buy")))
    outs = {"seq": ("sum", "_one"), "_bought": ("sum", "_buy"), "_sold": ("sum", "_sell"), "_worst": ("peak", "_more", "before")}
    done = running_aggregates(base, keys, order, outs)
    zero = F.lit(0).cast("long")
    before = F.greatest(zero, F.coalesce("_worst", zero))
    now = F.greatest(before, F.col("_sold") - F.col("_bought"))
    is_buy = F.col("kind") == "BUY"
    return (done.withColumn("lo", F.when(is_buy, F.col("_bought") - F.col("_buy"))
                            .otherwise(F.col("_sold") - F.col("_sell") - before))
            .withColumn("hi", F.when(is_buy, F.col("_bought")).otherwise(F.col("_sold") - now))
            .withColumn("uncovered", F.when(is_buy, zero).otherwise(now - before))
            .drop("_one", "_buy", "_sell", "_more", "_bought", "_sold", "_worst"))


def oversold_accounts(covered: DataFrame, keys: Sequence[str] = ACCOUNT) -> DataFrame:
    """Gate: accounts that sold more than they held at some point."""
    return (covered.groupBy(*keys).agg(from_units(F.sum("uncovered")).alias("oversold_qty"),
                                       F.count_if(F.col("uncovered") > 0).alias("oversold_sales"))
            .filter("oversold_sales > 0"))


CUTS = 16  # a stretch that is too long is cut into so many parts of about equal row counts


def stretches(covered: DataFrame, keys: Sequence[str], stretch_rows: int) -> DataFrame:
    """The intervals, cut into stretches of the quantity line with at most twice
    ``stretch_rows`` of them each: columns ``_cell``, ``_from``, ``_to``.

    Cuts follow the rows, not the quantity: a stretch with too many intervals is
    cut at quantiles of where they begin, and again until none has too many.  One
    buy and one sale at most begin at the same place, so this ends.
    """
    keys = list(keys)
    pieces = (covered.filter(F.col("hi") > F.col("lo"))
              .withColumn("_cell", F.lit("")).withColumn("_from", F.col("lo")).withColumn("_to", F.col("hi")))
    while True:
        long = (pieces.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
                .filter(F.col("_rows") > 2 * max(stretch_rows, 1)).drop("_rows"))
        long = written(long, "long")
        if long.isEmpty():
            return pieces
        cuts = F.percentile_approx("_from", [k / CUTS for k in range(1, CUTS)], 10_000)
        full = (join_null_safe(pieces, long, [*keys, "_cell"], "left_semi")
                .groupBy(*keys, "_cell").agg(F.array_distinct(cuts).alias("_cuts")))
        full = written(full, "cuts")
        first = F.size(F.filter("_cuts", lambda x: x <= F.col("_from")))
        last = F.size(F.filter("_cuts", lambda x: x < F.col("_to")))
        parts = F.when(F.col("_cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(first, last))
        start, stop = F.get("_cuts", F.col("_part") - 1), F.get("_cuts", F.col("_part"))
        pieces = written(
            join_null_safe(pieces, full, [*keys, "_cell"], "left").withColumn("_part", F.explode(parts))
            .withColumn("_from", F.greatest("_from", start)).withColumn("_to", F.least("_to", stop))
            .withColumn("_cell", F.when(F.col("_cuts").isNull(), F.col("_cell")).otherwise(F.concat_ws(".", "_cell", "_part")))
            .drop("_cuts", "_part"), "pieces")


def fifo_match(covered: DataFrame, keys: Sequence[str] = ACCOUNT, stretch_rows: int = 5_000) -> DataFrame:
    """(sale, lot) pairs with the matched quantity.

    Lots and covered sales tile the same quantity line, so the matches are the
    segments between neighbouring boundaries.  The line of an account is cut
    into stretches of a bounded number of trades; intervals are clipped to the
    stretches they touch and, inside one, the current lot and the current sale
    are carried from boundary to boundary.  Only true matches are formed.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys, "_cell").orderBy("_from")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    entry = F.struct("seq", "price", "d", F.col("_to").alias("to"))

    def current(kind: str) -> Column:
        return F.last(F.when(F.col("kind") == kind, entry), ignorenulls=True).over(w)

    segments = (stretches(covered, keys, stretch_rows).withColumn("_lot", current("BUY")).withColumn("_sale", current("SELL"))
                .withColumn("_next", F.lead("_from").over(order))
                .withColumn("_units", F.least(F.col("_next"), F.col("_lot.to"), F.col("_sale.to")) - F.col("_from"))
                .filter((F.col("_units") > 0) & F.col("_lot").isNotNull() & F.col("_sale").isNotNull()))
    return (segments.groupBy(*keys, F.col("_sale.seq").alias("sale_seq"), F.col("_lot.seq").alias("lot_seq"))
            .agg(from_units(F.sum("_units")).alias("matched_qty"), F.first("_lot.price").alias("lot_price"),
                 F.first("_lot.d").alias("lot_d")))


def realized_gains(covered: DataFrame, matches: DataFrame, tax_rate: Column | float = 0.0,
                   keys: Sequence[str] = ACCOUNT) -> DataFrame:
    """Cost basis, gain and tax of every sale; a loss earns no credit."""
    basis = (matches.withColumn("_cost", F.col("matched_qty") * F.col("lot_price"))
             .groupBy(*keys, F.col("sale_seq").alias("seq"))
             .agg(F.sum("matched_qty").alias("matched_qty"), F.sum("_cost").alias("cost_basis")))
    rate = F.lit(float(tax_rate)) if isinstance(tax_rate, (int, float)) else tax_rate
    return (join_null_safe(covered.filter("kind = 'SELL'"), basis, [*keys, "seq"], "left")
            .withColumn("matched_qty", F.coalesce("matched_qty", F.lit(0.0)))
            .withColumn("cost_basis", F.coalesce("cost_basis", F.lit(0.0)))
            .withColumn("gain", F.col("qty") * F.col("price") - F.col("cost_basis"))
            .withColumn("tax", F.greatest("gain", F.lit(0.0)) * rate))


def open_lots(covered: DataFrame, keys: Sequence[str] = ACCOUNT) -> DataFrame:
    """What is left of every lot after all sales."""
    sold = (covered.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("kind") == "SELL", F.col("hi"))), F.lit(0).cast("long")).alias("_sold")))
    left = F.col("hi") - F.greatest("lo", "_sold")
    return (join_null_safe(covered.filter("kind = 'BUY'"), sold, list(keys)).filter(left > 0)
            .withColumn("remaining_qty", from_units(left)).drop("_sold"))


def unrealized_gains(covered: DataFrame, keys: Sequence[str] = ACCOUNT) -> DataFrame:
    """Open quantity and latent gain at the last traded price of each account."""
    last = covered.groupBy(*keys).agg(F.max_by("price", F.struct("d", "seq")).alias("last_price"))
    lots = open_lots(covered, keys).groupBy(*keys).agg(
        F.sum("remaining_qty").alias("open_qty"),
        F.sum(F.col("remaining_qty") * F.col("price")).alias("open_cost"))
    return (join_null_safe(last, lots, list(keys), "left")
            .withColumn("open_qty", F.coalesce("open_qty", F.lit(0.0)))
            .withColumn("open_cost", F.coalesce("open_cost", F.lit(0.0)))
            .withColumn("unrealized_gain", F.col("open_qty") * F.col("last_price") - F.col("open_cost")))


# --- taxes -------------------------------------------------------------------

def sale_tax(gain: Column, rate: Column) -> Column:
    return F.greatest(gain, F.lit(0.0)) * rate


def dividend_net(gross: Column, withholding: Column, local: Column) -> Column:
    """Withholding and local tax both apply to the gross amount."""
    return gross - (gross * withholding + gross * local)


def holding_tax(value: Column, rate: Column) -> Column:
    return F.greatest(value, F.lit(0.0)) * rate


def liquidation_value(value: Column, unrealized: Column, rate: Column) -> Column:
    """What is left after selling everything and paying the postponed tax."""
    return value - F.greatest(unrealized, F.lit(0.0)) * rate


# --- statements ----------------------------------------------------------------

def first_signal_date(panel: DataFrame, min_history: int = 252, window: int | None = None,
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """First date on which the extremes are defined."""
    low, _ = extremes_cols(by_series(keys), "close", min_history, window)
    return (panel.filter("close IS NOT NULL").withColumn("_low", low).filter("_low IS NOT NULL")
            .groupBy(*keys).agg(F.min("d").alias("first_signal_d")))


def zone_signals(panel: DataFrame, buy_within: float = 0.10, sell_within: float = 0.95,
                 min_history: int = 252, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows near the low or near the high with tomorrow's execution price."""
    w = by_series(keys)
    low, high = extremes_cols(w, "close", min_history)
    return (panel.filter("close IS NOT NULL").select(
                *keys, "d", "close", low.alias("low_so_far"), high.alias("high_so_far"),
                F.lead("d").over(w).alias("execution_d"), F.lead("close").over(w).alias("execution_price"))
            .filter("low_so_far IS NOT NULL AND execution_d IS NOT NULL")
            .withColumn("near_low", ratio("close", "low_so_far") - 1 <= buy_within)
            .withColumn("near_high", ratio("close", "high_so_far") >= sell_within))


def next_day_execution(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The date and price at which a decision of each row can act."""
    w = by_series(keys)
    return (panel.select(*keys, "d", "close", F.lead("d").over(w).alias("execution_d"),
                         F.lead("close").over(w).alias("execution_price")))


def best_buy_then_sell(panel: DataFrame, shares: float = 100, cost: float = 0.0005,
                       keys: Sequence[str] = KEYS) -> DataFrame:
    """Ceiling with perfect foresight: the best buy followed by the best sale.

    The future maximum is a running maximum over descending dates (linear); its
    first date is the last row, in that order, that reaches it.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    future = (panel.filter("close IS NOT NULL")
              .withColumn("_max", F.max("close").over(w))
              .withColumn("_max_d", F.last(F.when(F.col("close") >= F.col("_max"), F.col("d")), ignorenulls=True).over(w))
              .withColumn("_gain", ratio("_max", "close")))
    first = F.struct((-F.col("_gain")).alias("g"), F.col("d"))
    best = future.groupBy(*keys).agg(
        F.min_by(F.struct(F.col("d").alias("buy_d"), F.col("close").alias("buy_price"),
                          F.col("_max_d").alias("sell_d"), F.col("_max").alias("sell_price")), first).alias("_x"),
        (F.min_by("close", "d") * shares).alias("capital"))
    return (best.select(*keys, "_x.*", "capital")
            .withColumn("shares_bought", F.col("capital") / (F.col("buy_price") * (1 + cost)))
            .withColumn("final_value", F.col("shares_bought") * F.col("sell_price") * (1 - cost)))


def dividend_cashflows(positions: DataFrame, dividends: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cash per share times the shares held on the payment date.

    ``positions``: keys, d, shares (NULL where unchanged), one row per date of
    the price window.  Payments outside the window or without shares drop out.
    """
    w = by_series(keys).rowsBetween(Window.unboundedPreceding, 0)
    held = positions.select(*keys, "d", F.coalesce(F.last("shares", ignorenulls=True).over(w), F.lit(0.0)).alias("shares"))
    return (held.join(dividends, [*keys, "d"]).filter("shares > 0")
            .withColumn("gross", F.col("shares") * F.col("per_share")))


def hold_statement(panel: DataFrame, dividends: DataFrame, taxes: DataFrame, shares: float = 100,
                   cost: float = 0.0005, since: DataFrame | None = None, chronological: bool = False,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Buy once, collect net dividends, pay the yearly holding tax, sell never.

    ``taxes``: one row per regime (a fixed handful).  With
    ``chronological=False`` the yearly tax is assessed on cash that already
    holds every dividend; with ``True`` only on those paid by then.
    The yearly recurrence is folded over at most one entry per year.
    """
    keys = list(keys)
    px = panel.filter("close IS NOT NULL").select(*keys, "d", "close")
    if since is not None:
        px = px.join(since.select(*keys, F.col("first_signal_d")), keys).filter("d >= first_signal_d").drop("first_signal_d")
    years = (px.groupBy(*keys, F.year("d").alias("_y"))
             .agg(F.max_by("close", "d").alias("p"), F.min_by("close", "d").alias("_p0"),
                  F.min("d").alias("_d0"), F.max("d").alias("_d1")))
    span = px.groupBy(*keys).agg(F.min("d").alias("_f"), F.max("d").alias("_t"))
    paid = dividends.join(span, keys).filter("d >= _f AND d <= _t")
    paid = paid.groupBy(*keys, F.year("d").alias("_y")).agg(F.sum("per_share").alias("div"), F.count(F.lit(1)).alias("_k"))
    yearly = years.join(paid, [*keys, "_y"], "left")
    account = yearly.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_y", "p", F.coalesce("div", F.lit(0.0)).alias("div")))).alias("_years"),
        F.min("_d0").alias("start_d"), F.min_by("_p0", "_y").alias("buy_price"),
        F.max_by("p", "_y").alias("final_price"),
        F.coalesce(F.sum("div"), F.lit(0.0)).alias("_div"), F.coalesce(F.sum("_k"), F.lit(0)).alias("payments"))
    net_rate = 1 - F.col("dividend_withholding_rate") - F.col("dividend_local_rate")
    opening = -F.col("commission")
    all_net = F.col("dividends_net")
    rate = F.col("wealth_tax_rate")

    def year_end(cash: Column, y: Column) -> Column:
        cash = cash + y["div"] * shares * net_rate if chronological else cash
        return cash - F.greatest(y["p"] * shares + cash, F.lit(0.0)) * rate

    start = opening if chronological else opening + all_net
    out = (account.crossJoin(F.broadcast(taxes))
           .withColumn("capital", F.col("buy_price") * shares)
           .withColumn("commission", F.col("capital") * cost)
           .withColumn("dividends_net", F.col("_div") * shares * net_rate)
           .withColumn("final_cash", F.aggregate("_years", start, year_end)))
    dividend_tax = F.col("_div") * shares - F.col("dividends_net")
    return (out.withColumn("taxes_paid", dividend_tax + opening + all_net - F.col("final_cash"))
            .withColumn("final_value", F.col("final_price") * shares + F.col("final_cash"))
            .withColumn("unrealized_gain", (F.col("final_price") - F.col("buy_price")) * shares)
            .withColumn("value_if_sold", liquidation_value(
                F.col("final_value"), F.col("unrealized_gain"), F.col("capital_gains_rate")))
            .select(*keys, "regime", "start_d", "buy_price", "final_price", "capital", "commission", "payments",
                    "dividends_net", "taxes_paid", "final_cash", "final_value", "unrealized_gain", "value_if_sold"))
