"""Daily panels derived from the trade tables.

Logs of prices are summed as whole micro-units, so the sums do not depend on
the order in which rows arrive and any engine gets the same panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepanel.functions.numeric import by_series, trailing
from tidepanel.operators.indicators import simple_return_col

MICRO = 1_000_000
DAMPING_ROWS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micro_log(price: str) -> Column:
    return F.round(F.ln(price) * MICRO).cast("long")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with their ticker; only the columns the panels need are scanned."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.to_date("l_shipdate").alias("d"), "l_extendedprice", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("ticker"))
    return (items.filter(F.col("l_extendedprice") > 0)
            .join(orders, items.l_orderkey == orders.o_orderkey)
            .select("ticker", "d", "l_extendedprice", "l_quantity"))


def daily_bars(raw: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """One damped bar per series and day from any number of trades."""
    micro = _micro_log("l_extendedprice")
    days = (raw.groupBy(*keys, "d")
            .agg(F.sum(micro).alias("_s"), F.count(F.lit(1)).alias("_n"), F.max(micro).alias("_h"),
                 F.min(micro).alias("_l"), F.sum("l_quantity").alias("volume"))
            .withColumn("_c", F.round(F.col("_s") / F.col("_n")).cast("long")))
    frame = trailing(by_series(keys), DAMPING_ROWS)

    def damped(c: str) -> Column:
        return F.round(F.exp(F.sum(c).over(frame) / F.count(c).over(frame) / MICRO), 4)

    bars = (days.withColumn("close", damped("_c")).withColumn("high", damped("_h"))
            .withColumn("low", damped("_l")))
    prev = F.lag("close").over(by_series(keys))
    return bars.select(*keys, "d", F.coalesce(prev, F.col("close")).alias("open"),
                       "high", "low", "close", "volume")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(trades(spark, sf_dir))


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many series: one per supplier and return flag (the regime)."""
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.col("l_returnflag").alias("regime"),
        F.to_date("l_shipdate").alias("d"), "l_extendedprice", "l_quantity")
    return daily_bars(raw.filter(F.col("l_extendedprice") > 0), ("regime", "ticker"))


def market_returns(panel: DataFrame) -> DataFrame:
    """Equal-weighted mean of the simple returns of a date."""
    r = panel.select("d", simple_return_col(by_series()).alias("r"))
    return r.groupBy("d").agg(F.avg("r").alias("market_r")).filter("market_r IS NOT NULL")


def dividends(panel: DataFrame) -> DataFrame:
    """A payment on the first row of every quarter: half a percent of the close."""
    w = Window.partitionBy("ticker").orderBy("d")
    quarter = F.trunc("d", "quarter")
    return (panel.select("ticker", "d", F.round(F.col("close") * 0.005, 4).alias("per_share"),
                         quarter.alias("_q"), F.lag(quarter).over(w).alias("_p"))
            .filter("_p IS NULL OR _p <> _q").select("ticker", "d", "per_share"))


def secondary_close(panel: DataFrame) -> DataFrame:
    """A second vendor that is 3% off on every fiftieth day."""
    off = F.datediff("d", F.lit("1995-01-01")) % 50 == 0
    return panel.select("ticker", "d", F.when(off, F.col("close") * 1.03).otherwise(F.col("close")).alias("close"))


def monthly_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly price level: mean order value, summed in cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return (table(spark, sf_dir, "orders").groupBy(F.to_date(F.trunc("o_orderdate", "MM")).alias("month"))
            .agg(F.round(F.sum(cents) / F.count(F.lit(1)) / 100, 4).alias("level")))


def corporate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a dated event of its ticker."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("ticker"),
        F.to_date("o_orderdate").alias("event_date"), F.col("o_orderstatus").alias("category"))


def share_pairs(panel: DataFrame, fixed_from: str = "1998-01-01") -> DataFrame:
    """Local and foreign quotes of one share around a 10:1 split.

    The true rate is 1450 plus the day of the year; ``local_raw`` shows the
    split, ``local_adj`` is adjusted for it.
    """
    rate = F.lit(1450.0) + F.dayofyear("d")
    shares = F.when(F.col("d") < F.lit(fixed_from).cast("date"), 1.0).otherwise(10.0)
    return panel.select("ticker", "d", F.col("close").alias("adr"), rate.alias("true_rate"),
                        (F.col("close") * rate / shares).alias("local_raw"),
                        (F.col("close") * rate / 10.0).alias("local_adj"),
                        (F.lit(1000.0) + F.dayofyear("d")).alias("official_rate"))


def ledger_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of every account in a total order: date, then ids."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("account"), F.to_date("l_shipdate").alias("d"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("kind"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amount"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity"), 8).alias("price"))
