"""Money from prices and volumes: capture, contracts, bills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperline.functions.numeric import exact_mean, half_up, money, ratio


def capture_price(rows: DataFrame, keys: list[str], price: str, generated: str) -> DataFrame:
    """Mean price weighted by generation, plain mean, and their ratio; null without generation."""
    a = rows.groupBy(*keys).agg(F.sum(money(generated) * money(price)).alias("gp"), F.sum(money(generated)).alias("g"), exact_mean(money(price)).alias("mean"))
    return a.select(*keys, half_up(ratio(F.col("gp"), F.col("g"))).alias("capture"), half_up(F.col("mean")).alias("mean_price"), half_up(100 * F.try_divide(ratio(F.col("gp"), F.col("g")), F.col("mean"))).alias("capture_rate"))


def contract_value(rows: DataFrame, keys: list[str], spot: str, generated: str, contracted: str, strike: float) -> DataFrame:
    """Spot revenue and the settlement of a contract for differences: (strike - spot) on the lesser of contract and generation."""
    covered = F.least(money(generated), money(contracted))
    s = F.sum((F.lit(strike).cast("decimal(18,4)") - money(spot)) * covered)
    revenue = F.sum(money(spot) * money(generated))
    return rows.groupBy(*keys).agg(half_up(revenue.cast("double"), 2).alias("spot_revenue"), half_up(s.cast("double"), 2).alias("settlement"), half_up((revenue + s).cast("double"), 2).alias("total"))


def bill(rows: DataFrame, keys: list[str], energy: str, parts: dict[str, float]) -> DataFrame:
    """Charges per part from one energy sum."""
    e = F.sum(money(energy)).cast("double")
    return rows.groupBy(*keys).agg(half_up(e).alias("energy"), *(half_up(e * rate).alias(name) for name, rate in parts.items()))
