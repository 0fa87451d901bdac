"""Fixed rate tables: cost models and tax regimes (a handful of rows each)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class CostModel:
    """One-way costs as a share of the traded amount."""

    market: str
    commission: float
    market_fees: float
    slippage: float

    @property
    def one_way(self) -> float:
        return self.commission + self.market_fees + self.slippage


# Documented orders of magnitude per market.
US_EQUITY = CostModel("US", 0.0, 0.0, 0.0005)
BYMA_EQUITY = CostModel("BYMA", 0.0050, 0.0008, 0.0020)
DEFAULT_COSTS = CostModel("DEFAULT", 0.0005, 0.0001, 0.0005)

# Regime, gains on sale, dividend withholding, dividend local, yearly holding.
TAX_REGIMES = (
    ("NONE", 0.0, 0.0, 0.0, 0.0),
    ("ADR", 0.15, 0.30, 0.0, 0.0125),
    ("CEDEAR", 0.0, 0.30, 0.07, 0.0125),
    ("LOCAL_UNVERIFIED", 0.0, 0.0, 0.0, 0.0),
)


def cost_models(spark: SparkSession, models: tuple[CostModel, ...] = (US_EQUITY, BYMA_EQUITY)) -> DataFrame:
    return spark.createDataFrame(
        [(m.market, m.commission, m.market_fees, m.slippage, m.one_way) for m in models],
        "market string, commission double, market_fees double, slippage double, one_way double")


def market_of(ticker: Column) -> Column:
    """Local listings carry the ``.BA`` suffix."""
    return F.when(ticker.endswith(".BA"), F.lit("BYMA")).otherwise(F.lit("US"))


def with_costs(df: DataFrame, ticker: str = "ticker") -> DataFrame:
    models = F.broadcast(cost_models(df.sparkSession))  # two rows
    return df.withColumn("market", market_of(F.col(ticker))).join(models, "market", "left")


def tax_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(TAX_REGIMES),
        "regime string, capital_gains_rate double, dividend_withholding_rate double, "
        "dividend_local_rate double, wealth_tax_rate double")
