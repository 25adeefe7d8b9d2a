"""The whole dataflow: raster, features, forest, masks by class, components, objects, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.constants import DEFAULT_SIGMA, MEMBER_THRESHOLD, MIN_LABELS_TO_TRAIN, NUM_CLASSES
from gridmill.operators import ccl, filters, forest, objects
from gridmill.store import materialize, temporary_tables

#: Labels (some 50 bytes each) that are sent to all executors, at most; rows that one task numbers, at most.
MOST_BROADCAST = 500_000
FEW_ROWS = 100_000


def training_set(features: DataFrame, labels: DataFrame, known: int | None = None) -> DataFrame:
    """One feature vector for each label, all images together, with the labels' other columns.

    Labels whose number is ``known`` to be at most ``MOST_BROADCAST`` are sent to the features, which then stay where they are.
    """
    near = F.broadcast(labels) if known is not None and known <= MOST_BROADCAST else labels
    return features.select("image_id", "i", *filters.FEATURES).join(near, ["image_id", "i"])


def numbered(samples: DataFrame, order: list[str], known: int | None = None) -> DataFrame:
    """Rows numbered ``row`` from 0 in a stated order without ties.

    Up to ``FEW_ROWS`` (``known``, or counted here) are numbered by one task. More are sorted by ranges and counted in each, so no task holds all.
    """
    if (samples.count() if known is None else known) <= FEW_ROWS:
        return samples.withColumn("row", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    ranged = materialize(samples.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    few = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each task of the sort
    few = few.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(few.select("_range", "_before"), "_range").withColumn("row", (within - 1 + F.col("_before")).cast("long")).drop("_range", "_before")


def class_masks(classified: DataFrame, classes: int = NUM_CLASSES, threshold: float = MEMBER_THRESHOLD) -> DataFrame:
    """A row for each pixel and class it belongs to: by threshold, so a pixel may be in two classes or none."""
    rows = classified.select("*", F.posexplode(F.array(*[f"p{c}" for c in range(classes)])).alias("cls", "p"))
    return rows.where(F.col("p") >= threshold).select("image_id", "cls", "x", "y", "i", "v")


def class_objects(classified: DataFrame, width: int, height: int, scale: int = 1) -> DataFrame:
    by = ["image_id", "cls"]
    return objects.object_stats(ccl.label_components(class_masks(classified), width, height, by=by), scale, by)


def count_objects(pixels: DataFrame, nodes: Sequence[tuple], width: int, height: int, sigma: float = DEFAULT_SIGMA) -> DataFrame:
    classified = forest.probabilities(filters.features(pixels, sigma, width, height), nodes, filters.FEATURES)
    return objects.class_counts(class_objects(classified, width, height), NUM_CLASSES)


def retrain(
    pixels: DataFrame, labels: DataFrame, width: int, height: int, sigma: float = DEFAULT_SIGMA, config: forest.ForestConfig = forest.ForestConfig(), order: Sequence[str] = ("i",)
) -> DataFrame:
    """Train on the labels, classify every pixel, count objects by class; too few labels give counts of 0.

    The filter bank runs once: its features are written, and read by training and by classification. Labels ``(image_id, i, cls, …)`` are taken image by
    image in ``order``, which decides what each tree draws: by default that of pixels, for painting order say the columns of time and event.
    """
    return retrain_on(filters.features(pixels, sigma, width, height), labels, width, height, config, order)


def retrain_on(features: DataFrame, labels: DataFrame, width: int, height: int, config: forest.ForestConfig = forest.ForestConfig(), order: Sequence[str] = ("i",)) -> DataFrame:
    """:func:`retrain` from features ``(image_id, x, y, i, v, f0 … f7)``."""
    known = labels.count()
    if known < MIN_LABELS_TO_TRAIN:
        return features.sparkSession.range(config.classes).select(F.col("id").cast("int").alias("cls"), F.lit(0).cast("long").alias("objects"))
    features = materialize(features, "features")
    with temporary_tables(features.sparkSession):
        samples = materialize(training_set(features, labels, known), "samples")
        nodes = forest.collect_forest(forest.train(numbered(samples, ["image_id", *order], known), filters.FEATURES, config))
    classified = forest.probabilities(features, nodes, filters.FEATURES, config.classes)
    return objects.class_counts(class_objects(classified, width, height), config.classes)
