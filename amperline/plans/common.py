"""How the driver's tables stand for market data: event types as grids, users as equipment, values as prices, order lines as blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, day, hour_ts, grid, equipment, value."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts"), F.col("event_type").alias("grid"), F.col("user_id").alias("equipment"), "value")


EVENTS = """e AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS day, date_trunc('hour', ts) AS hour_ts, event_type AS grid, user_id AS equipment, value FROM events)"""


def r(x: str, digits: int = 4) -> str:
    """SQL of numeric.half_up."""
    s = "1" + "0" * digits + ".0"
    return f"(floor(({x}) * CAST({s} AS DOUBLE) + 0.5) / CAST({s} AS DOUBLE))"


def mean(x: str) -> str:
    """SQL of numeric.exact_mean over money."""
    return f"(CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) / count({x}))"


def dsum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"
