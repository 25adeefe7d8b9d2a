"""What is shown and exported of classified pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.constants import CLASS_COLORS, NUM_CLASSES, OVERLAY_ALPHA
from gridmill.functions.scalars import argmax_class, color_channels, contrast_window, css_color


def palette(spark, colors: tuple[str, ...] = CLASS_COLORS) -> DataFrame:
    """``(cls, r, g, b)`` with parts of 1; a row for each class."""
    rows = spark.createDataFrame(list(enumerate(colors)), "cls int, color string").withColumn("rgb", color_channels(F.col("color")))
    return rows.select("cls", *[(F.col(f"rgb.{c}") / 255.0).alias(c) for c in "rgb"])


def recolored(colors: DataFrame, edits: DataFrame) -> DataFrame:
    """The palette after edits ``(cls, color)``, colours as in style sheets: classes it lacks are ignored, those not named keep theirs."""
    new = edits.where(F.col("color").isNotNull()).select("cls", css_color(F.col("color")).alias("new"))
    return colors.join(new, "cls", "left").select("cls", *[F.coalesce(f"new.{c}", c).alias(c) for c in "rgb"])


def with_class(pixels: DataFrame, classes: int = NUM_CLASSES) -> DataFrame:
    """Adds the class with the largest probability; null where unclassified."""
    return pixels.withColumn("cls", argmax_class([F.coalesce(f"p{c}", F.lit(-1.0)) for c in range(classes)]))


def composite(pixels: DataFrame, colors: DataFrame, low: float, high: float, alpha: float = OVERLAY_ALPHA) -> DataFrame:
    """Grey by the display window, mixed with the class's colour where there is one; a class without colour takes class 0's.

    A palette has a row for each class, so it becomes one value of the plan and pixels need no join.
    """
    parts = colors.where(F.col("cls").between(0, NUM_CLASSES - 1)).select("cls", F.array(*"rgb").alias("rgb")).collect()
    known = {r["cls"]: r["rgb"] for r in parts}
    rows = with_class(pixels).withColumn("grey", contrast_window(F.col("v"), F.lit(low), F.lit(high)))

    def mixed(k: int) -> Column:
        of_class = F.lit(known.get(0, [0.0] * 3)[k])
        for cls, rgb in sorted(known.items()):
            of_class = F.when(F.col("cls") == cls, F.lit(rgb[k])).otherwise(of_class)
        return F.when(F.col("cls").isNull(), F.col("grey")).otherwise(F.col("grey") * (1 - alpha) + of_class * alpha)

    return rows.select("image_id", "x", "y", *[mixed(k).alias(c) for k, c in enumerate("rgb")])


def segmentation(pixels: DataFrame, classes: int = NUM_CLASSES) -> DataFrame:
    """0 where unclassified, else the class + 1."""
    return with_class(pixels, classes).select("image_id", "x", "y", "i", F.coalesce(F.col("cls") + 1, F.lit(0)).alias("code"))


def stored_probabilities(grid: DataFrame, classified: DataFrame, classes: int = NUM_CLASSES) -> DataFrame:
    """Every pixel's probabilities, -1 where unclassified."""
    p = [f"p{c}" for c in range(classes)]
    rows = grid.join(classified.select("image_id", "i", *p), ["image_id", "i"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in p})
