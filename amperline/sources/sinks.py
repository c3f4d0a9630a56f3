"""Exports: tidy CSV tables with an index, and features for maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def export_tables(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]], folder: str) -> DataFrame:
    """Write each table as CSV and an index of (name, rows, columns, description) as JSON; returns the index as it was written."""
    index = None
    for name, (df, description) in sorted(tables.items()):
        df.write.option("header", True).csv(f"{folder}/{name}")
        own = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(",".join(df.columns)).alias("columns"), F.lit(description).alias("description"))
        index = own if index is None else index.unionByName(own)
    index.write.json(f"{folder}/index")
    return spark.read.schema(index.schema).json(f"{folder}/index")


def features(rows: DataFrame, kind: str, coordinates: Column, properties: list[str]) -> DataFrame:
    """One map feature a row, as JSON text."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))
