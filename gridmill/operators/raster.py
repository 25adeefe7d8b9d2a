"""Rasters: a dense relation (image_id, x, y, i, v), a row for each pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions.scalars import pixel_index


#: Pixels of a row that are dealt together at most.
TILE = 4_096
#: Pixels of one image that a task makes, about.
TASK_PIXELS = 1 << 22


def grid(images: DataFrame, width: int, height: int) -> DataFrame:
    """``(image_id, y, tile)``: every row of every image, cut into tiles of ``TILE`` pixels. Images come with ``image_id``. Made by generators, without a join."""
    rows = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return rows.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit((width - 1) // TILE))).alias("tile"))


def rasterize(df: DataFrame, image: Column, x: Column, y: Column, width: int, height: int, value: Column | None = None) -> DataFrame:
    """Bin rows onto a grid: ``value`` is an aggregate (their number, if not given), 0 where no row falls.

    Rows are aggregated before they meet the grid; rows outside of it are left out. What is shuffled and held are cells that have rows, and
    tiles: the other pixels are made tile by tile as they are read.
    """
    value = F.count("*") if value is None else value
    binned = df.select(image.alias("image_id"), x.cast("int").alias("x"), y.cast("int").alias("y"), *[F.col(f"`{c}`").alias(f"_{c}") for c in df.columns])
    binned = binned.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1) & F.col("image_id").isNotNull())
    # A stated number of partitions, which adaptive execution leaves as it is: few rows are about to grow. It grows with the image.
    tasks = -(-width * height // TASK_PIXELS)
    dealt = [max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))] if tasks > 1 else []
    cells = binned.groupBy("image_id", "x", "y").agg(value.cast("double").alias("v"))
    cell = F.struct("x", F.coalesce(F.col("v") + 0.0, F.lit(0.0)).alias("v"))
    cells = cells.select("image_id", "y", F.floor(F.col("x") / TILE).cast("int").alias("tile"), cell.alias("cell"))
    images = df.select(image.alias("image_id")).where(F.col("image_id").isNotNull()).distinct()
    rows = cells.unionByName(grid(images, width, height).withColumn("cell", F.lit(None).cast("struct<x:int,v:double>")))
    # Dealt by image row: a horizontal pass over the result needs no shuffle of its own. Long rows are dealt by tiles.
    by = ["image_id", "y", "tile"] if width > TILE else ["image_id", "y"]
    tiles = rows.repartition(*dealt, *by).groupBy(*by).agg(F.collect_list("cell").alias("cells"))
    first = F.col("tile") * TILE if width > TILE else F.lit(0)
    empty = F.array_except(F.sequence(first, F.least(first + TILE, F.lit(width)) - 1), F.col("cells.x"))
    places = F.arrays_zip(F.concat("cells.x", empty).alias("x"), F.concat("cells.v", F.array_repeat(F.lit(0.0), F.size(empty))).alias("v"))
    return with_index(tiles.select("image_id", "y", F.inline(places).alias("x", "v")), width)


def with_index(pixels: DataFrame, width: int) -> DataFrame:
    return pixels.select("image_id", "x", "y", pixel_index(F.col("x"), F.col("y"), width).alias("i"), "v")


def min_max(pixels: DataFrame, by: str = "image_id") -> DataFrame:
    """Smallest and largest value of each image, 0 and 0 for none."""
    return pixels.groupBy(by).agg(F.coalesce(F.min("v"), F.lit(0.0)).alias("data_min"), F.coalesce(F.max("v"), F.lit(0.0)).alias("data_max"))


def at_least_mean(pixels: DataFrame) -> DataFrame:
    """Pixels whose value reaches the mean of their image's whole grid."""
    means = pixels.groupBy("image_id").agg(F.avg("v").alias("mean"))
    return pixels.join(means, "image_id").where(F.col("v") >= F.col("mean")).drop("mean")
