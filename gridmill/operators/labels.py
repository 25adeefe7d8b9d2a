"""Painted labels ``(image_id, x, y, cls)``, one for a pixel: the last stroke wins."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.constants import MIN_LABELS_TO_TRAIN

PIXEL = ["image_id", "x", "y"]


def brush(strokes: DataFrame, radius: float, width: int, height: int) -> DataFrame:
    """The pixels each stroke ``(…, x, y)`` touches, as ``px`` and ``py``, clipped to the image.

    Radius 1 is exactly the pixel itself if that is inside; otherwise the disc around it.
    """
    reach = ceil(radius)
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    rows = strokes.withColumn("dx", F.explode(offsets)).withColumn("dy", F.explode(offsets))
    px, py = F.col("x") + F.col("dx"), F.col("y") + F.col("dy")
    inside = px.between(0, width - 1) & py.between(0, height - 1)
    disc = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= radius * radius
    if radius == 1:
        centre_inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
        disc = disc & (~centre_inside | ((F.col("dx") == 0) & (F.col("dy") == 0)))
    return rows.where(inside & disc).withColumns({"px": px, "py": py}).drop("dx", "dy")


def keep_latest(edits: DataFrame, order: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Of edits ``(image_id, x, y, cls, …)`` the last of each pixel; a null class erases.

    With ``order`` kept too, labels can be listed as they were painted: a pixel that is painted again goes to the end.
    """
    last = F.row_number().over(Window.partitionBy(*PIXEL).orderBy(*[F.desc(o) for o in order]))
    return edits.withColumn("rank", last).where((F.col("rank") == 1) & F.col("cls").isNotNull()).select(*PIXEL, "cls", *keep)


def upsert(labels: DataFrame, painted: DataFrame) -> DataFrame:
    return erase(labels, painted).unionByName(painted.select(*PIXEL, "cls"))


def erase(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    return labels.join(pixels.select(*PIXEL).distinct(), PIXEL, "left_anti")


def totals(labels: DataFrame) -> DataFrame:
    """Labels in all, and whether they are enough to train on."""
    return labels.agg(F.count("*").alias("labels")).withColumn("enough", F.col("labels") >= MIN_LABELS_TO_TRAIN)


def bounding_boxes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def blocks(labels: DataFrame) -> DataFrame:
    """Each image's labels as a dense block over their bounding box: class + 1, 0 where none."""
    box = bounding_boxes(labels)
    cells = box.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1"))).select(*PIXEL)
    return cells.join(labels.select(*PIXEL, "cls"), PIXEL, "left").withColumn("code", F.coalesce(F.col("cls") + 1, F.lit(0))).drop("cls")
