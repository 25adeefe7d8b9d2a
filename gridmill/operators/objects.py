"""Objects: what is known of each connected component, and counts by class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.scalars import fixed_point, marker_radius


def object_stats(labelled: DataFrame, scale: int = 1, by: list[str] | None = None) -> DataFrame:
    """Area, sums of fixed-point intensity and coordinates, extremes; one row for each component."""
    by = by or ["image_id"]
    fixed = fixed_point(F.col("v"), scale)
    return labelled.groupBy(*by, "label").agg(
        F.count("*").alias("area"), F.sum(fixed).alias("total"), F.sum(F.col("x").cast("long")).alias("sum_x"),
        F.sum(F.col("y").cast("long")).alias("sum_y"), F.min(fixed).alias("min_v"), F.max(fixed).alias("max_v"),
    )


def centroids(objects: DataFrame) -> DataFrame:
    """Centre and area; objects without area have none."""
    rows = objects.where(F.col("area") > 0)
    return rows.withColumns({"cx": F.col("sum_x") / F.col("area"), "cy": F.col("sum_y") / F.col("area")})


def intensities(objects: DataFrame, scale: int = 1) -> DataFrame:
    """Average and extremes in the source's own units."""
    return objects.withColumns({
        "avg_intensity": F.col("total") / F.col("area") / scale, "min_intensity": F.col("min_v") / scale, "max_intensity": F.col("max_v") / scale,
    })


def markers(objects: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Centres with the radius to draw; classes named in ``visible (cls, visible)`` as not visible are left out."""
    rows = centroids(objects).withColumn("radius", marker_radius(F.col("area")))
    if visible is None:
        return rows
    return rows.join(visible, "cls", "left").where(F.coalesce("visible", F.lit(True))).drop("visible")


def class_counts(objects: DataFrame, classes: int) -> DataFrame:
    """How many objects each class has; 0 where none."""
    every = objects.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    counted = objects.groupBy("cls").agg(F.count("*").alias("objects"))
    return every.join(counted, "cls", "left").withColumn("objects", F.coalesce("objects", F.lit(0)))


def counts_rollup(objects: DataFrame) -> DataFrame:
    return objects.rollup("image_id", "cls").agg(F.count("*").alias("objects"), F.sum("area").alias("area"))


def largest(objects: DataFrame, k: int, by: str = "image_id") -> DataFrame:
    """The ``k`` largest objects of each image, the lower label of equals first."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("area"), "label"))
    return objects.withColumn("place", place).where(F.col("place") <= k)
