"""Rasters made from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators.raster import rasterize, with_index

EVENTS_SIZE = (24, 30)
SHIP_SIZE = (105, 50)
HOURS = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind, hour and day."""
    df = table(spark, sf_dir, "events").select("event_type", "ts")
    return rasterize(df, F.col("event_type"), F.hour("ts"), F.dayofmonth("ts") - 1, *EVENTS_SIZE)


def ship_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by return flag, price in thousands and quantity."""
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return rasterize(df, F.col("l_returnflag"), F.floor(F.col("l_extendedprice") / 1000), F.col("l_quantity") - 1, *SHIP_SIZE)


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors side by side: a row for each, a column for each element."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "value"))
    rows = df.select(F.lit("embed").alias("image_id"), "x", F.col("vec_id").cast("int").alias("y"), F.col("value").cast("double").alias("v"))
    return with_index(rows, 64)


def user_hours(spark: SparkSession, sf_dir: str, users: int) -> DataFrame:
    """Events by user and hour of the month, one large image."""
    df = table(spark, sf_dir, "events").select("user_id", "ts")
    hour = (F.dayofmonth("ts") - 1) * 24 + F.hour("ts")
    return rasterize(df, F.lit("user_hour"), F.col("user_id"), hour, users, HOURS)
