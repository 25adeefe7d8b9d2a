"""Project files for desktop pixel classification (``.ilp``, an HDF5 tree): images, labels, names, a feature selection.

No classifier goes along; the desktop program trains its own from the labels. The driver lays out the tree from the images' names, sums and boxes of labels;
planes and blocks of labels are written by tasks, at the places the layout leaves for them (see :mod:`gridmill.sinks.ranges`).
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.constants import CLASS_COLORS, NUM_CLASSES, NUM_TREES
from gridmill.functions.scalars import block_slice, label_set_name, lane_name, strip_extension
from gridmill.operators.labels import bounding_boxes
from gridmill.shipping import ship
from gridmill.sinks import hdf5
from gridmill.sinks.hdf5 import Dataset, Group

# Fixed values of the project format: its feature names, scales, and axis type flags.
FEATURE_IDS = (
    "GaussianSmoothing", "LaplacianOfGaussian", "GaussianGradientMagnitude", "DifferenceOfGaussians",
    "StructureTensorEigenvalues", "HessianOfGaussianEigenvalues",
)
FEATURE_SCALES = (0.3, 0.7, 1.0, 1.6, 3.5, 5.0, 10.0)
AXIS_FLAGS = {"t": 4, "z": 2, "y": 2, "x": 2, "c": 1}
# Fixed value: the classifier factory as the program pickles it, as text; only the number of trees varies.
CLASSIFIER_FACTORY = (
    "ccopy_reg\n_reconstructor\np0\n(clazyflow.classifiers.parallelVigraRfLazyflowClassifier\n"
    "ParallelVigraRfLazyflowClassifierFactory\np1\nc__builtin__\nobject\np2\nNtp3\nRp4\n(dp5\n"
    "VVERSION\np6\nL2L\nsV_num_trees\np7\nL{trees}L\nsV_label_proportion\np8\nNsV_variable_importance_path\n"
    "p9\nNsV_variable_importance_enabled\np10\nI00\nsV_kwargs\np11\n(dp12\nsV_num_forests\np13\nL4L\nsb."
)
#: The selection that is preset: this many features at this many scales.
PRESET = 2
#: Cells of a plane, or of a block of labels, that one range covers.
RANGE_CELLS = 1 << 16
_RANGES = "file string, size long, offset long, data binary"


@dataclass
class ProjectImage:
    """One plane as (height, width), with labels ``(x, y, cls)``."""

    name: str
    pixels: np.ndarray
    labels: list[tuple[int, int, int]] = field(default_factory=list)


def axis_tags(keys: str) -> str:
    # Whole numbers are written without a point, as in the files of that program's other writers.
    axes = [{"key": k, "typeFlags": AXIS_FLAGS.get(k, 2), "resolution": 0, "description": ""} for k in keys]
    return json.dumps({"axes": axes}, indent=2)


def _rgb(color: str) -> tuple[int, int, int]:
    digits = color.removeprefix("#")
    try:
        return tuple(bytes.fromhex(digits)) if len(digits) == 6 else (136, 136, 136)
    except ValueError:
        return 136, 136, 136


def _block_attributes(x0: int, y0: int, shape: tuple[int, ...]) -> dict[str, str]:
    return {"axistags": axis_tags("yxc"), "blockSlice": f"[{y0}:{y0 + shape[0]},{x0}:{x0 + shape[1]},0:1]"}


def label_block(labels: list[tuple[int, int, int]]) -> Dataset | None:
    """A dense block over the bounding box: class + 1, 0 where none; of two labels of a pixel the later counts."""
    if not labels:
        return None
    x, y, _ = (np.array(c) for c in zip(*labels, strict=True))
    x0, y0 = x.min(), y.min()
    block = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1, 1), np.uint8)
    for a, b, c in labels:
        block[b - y0, a - x0, 0] = c + 1
    return hdf5.array("block0000", block, _block_attributes(x0, y0, block.shape))


def _key(number: int, name: str, content: bytes) -> str:
    """A data set's identifier, in the form of a random UUID; the same for the same place, name and content."""
    digest = hashlib.sha256(f"{number}:{name}:".encode() + content).hexdigest()
    return f"{digest[:8]}-{digest[8:12]}-4{digest[13:16]}-8{digest[17:20]}-{digest[20:32]}"


def _info(name: str, key: str, shape: tuple[int, ...]) -> Group:
    inner = f"/Input Data/local_data/{key}"
    nickname = name.rsplit(".", 1)[0] if "." in name.rsplit("/", 1)[-1] else name
    return Group("Raw Data", [
        hdf5.text("__class__", "ProjectInternalDatasetInfo"), hdf5.flag("allowLabels", True), hdf5.text("axistags", axis_tags("zyx")),
        hdf5.text("datasetId", key), hdf5.text("display_mode", "default"), hdf5.text("filePath", inner), hdf5.text("inner_path", inner),
        hdf5.text("location", "ProjectInternal"), hdf5.text("nickname", nickname), hdf5.flag("normalizeDisplay", False),
        hdf5.array("shape", np.array(shape, np.int64)),
    ])


def _lane(image: ProjectImage, number: int) -> tuple[Group, Dataset]:
    key, shape = _key(number, image.name, image.pixels.tobytes()), (1, *image.pixels.shape)
    return _info(image.name, key, shape), hdf5.array(key, image.pixels.astype(np.float32).reshape(shape), {"axistags": axis_tags("zyx")})


def selection_matrix() -> np.ndarray:
    features, scales = np.indices((len(FEATURE_IDS), len(FEATURE_SCALES)))
    return (features < PRESET) & (scales < PRESET)


def _tree(
    lanes: list[tuple[Group, Dataset]], blocks: list[Dataset | None], time: str, class_names: list[str] | None, colors: tuple[str, ...], trees: int, classes: int
) -> list[Group | Dataset]:
    palette = np.array([_rgb(colors[k] if k < len(colors) else "") for k in range(classes)], np.int32)
    return [
        hdf5.text("ilastikVersion", "1.4.0"), hdf5.text("workflowName", "Pixel Classification"), hdf5.text("time", time),
        hdf5.array("currentApplet", np.int64(0)),
        Group("Input Data", [
            hdf5.text("StorageVersion", "0.2"), hdf5.texts("Role Names", ["Raw Data", "Prediction Mask"]),
            Group("infos", [Group(f"lane{k:04d}", [info]) for k, (info, _) in enumerate(lanes)]),
            Group("local_data", [data for _, data in lanes]),
        ]),
        Group("FeatureSelections", [
            hdf5.text("StorageVersion", "0.1"), hdf5.texts("FeatureIds", list(FEATURE_IDS)), hdf5.array("Scales", np.array(FEATURE_SCALES)),
            hdf5.flag("SelectionMatrix", selection_matrix()), hdf5.flag("ComputeIn2d", [True] * len(FEATURE_SCALES)),
        ]),
        Group("PixelClassification", [
            hdf5.text("StorageVersion", "0.1"), hdf5.texts("LabelNames", class_names or [f"Class {k + 1}" for k in range(classes)]),
            hdf5.array("LabelColors", palette), hdf5.array("PmapColors", palette), Group("Bookmarks"),
            Group("LabelSets", [Group(f"labels{k:03d}", [b] if b else []) for k, b in enumerate(blocks)]),
            hdf5.text("ClassifierFactory", CLASSIFIER_FACTORY.format(trees=trees)),
        ]),
    ]


def build(
    images: list[ProjectImage], time: str, class_names: list[str] | None = None, colors: tuple[str, ...] = CLASS_COLORS, trees: int = NUM_TREES, classes: int = NUM_CLASSES
) -> bytes:
    """The bytes of a small project in memory. More images than a group's node holds are an error."""
    lanes = [_lane(image, k) for k, image in enumerate(images)]
    return hdf5.serialize(_tree(lanes, [label_block(image.labels) for image in images], time, class_names, colors, trees, classes))


def _filled(cells: DataFrame, places: list[tuple[str, int, int]], kind: str, file: str, size: int) -> DataFrame:
    """Ranges of dense blocks, ``places (key, offset, cells)``, from ``cells (key, at, value)``; a cell that is missing is 0."""
    dtype = np.dtype(kind).newbyteorder("<")

    def make(table: pa.Table) -> pa.Table:
        first, n, start = (table[c][0].as_py() for c in ("part", "n", "start"))
        first *= RANGE_CELLS
        known = table.filter(table["at"].is_valid())
        data = np.zeros(min(RANGE_CELLS, n - first), dtype)
        data[known["at"].to_numpy() - first] = known["value"].to_numpy()
        row = [[file], [size], [start + first * dtype.itemsize], [data.tobytes()]]
        return pa.table([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "size", "offset", "data"])

    at = cells.sparkSession.createDataFrame(places, "key string, start long, n long")
    columns = ["key", "start", "n", "part", "at", "value"]
    rows = cells.select("key", F.col("at").cast("long").alias("at"), F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
    rows = rows.join(F.broadcast(at), "key").where((F.col("at") >= 0) & (F.col("at") < F.col("n"))).withColumn("part", F.floor(F.col("at") / RANGE_CELLS))
    # A row without a cell for each range, so that ranges without cells are written too.
    parts = at.where("n > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANGE_CELLS))))
    parts = parts.withColumns({"at": F.lit(None).cast("long"), "value": F.lit(None).cast("double")})
    return rows.select(columns).unionByName(parts.select(columns)).groupBy("key", "part").applyInArrow(make, _RANGES)


def project_ranges(
    pixels: DataFrame, labels: DataFrame, images: DataFrame, width: int, height: int, time: str, file: str = "project.ilp",
    class_names: list[str] | None = None, colors: tuple[str, ...] = CLASS_COLORS, trees: int = NUM_TREES, classes: int = NUM_CLASSES,
) -> DataFrame:
    """One project file as ranges of bytes: ``images (image_id, ord)`` with their ``pixels (image_id, i, v)`` and ``labels (image_id, x, y, cls)``.

    Lanes are numbered from 0 by ``ord``, then name. The driver sees a row for each image (more than a group's node holds are an error) and the file's headers; tasks fill
    planes and blocks range by range, so none holds an image. A pixel that is missing is 0, a null value NaN; pixels outside the image, of images that are not
    listed, and rows with a null image play no part. Pixels and labels have one row for each place.
    """
    spark = pixels.sparkSession
    ship(spark)
    listed = images.where("image_id is not null").select("image_id", "ord").orderBy("ord", "image_id").limit(hdf5.MOST_ENTRIES + 1).collect()
    if len(listed) > hdf5.MOST_ENTRIES:
        raise ValueError(f"more than {hdf5.MOST_ENTRIES} images, which a project holds")
    numbers = {r["image_id"]: k for k, r in enumerate(listed)}
    known = F.broadcast(spark.createDataFrame([(n,) for n in numbers], "image_id string"))
    samples = pixels.select("image_id", "i", "v").join(known, "image_id")
    painted = labels.select("image_id", "x", "y", "cls").where("cls is not null").join(known, "image_id")
    digest = F.sum(F.xxhash64("i", F.col("v").cast("float")).cast("decimal(20,0)"))
    sums = {r["image_id"]: str(r["digest"]) for r in samples.groupBy("image_id").agg(digest.alias("digest")).collect()}
    boxes = {r["image_id"]: r for r in bounding_boxes(painted).collect()}

    shape, lanes, blocks = (1, height, width), [], []
    for name, k in numbers.items():
        key = _key(k, name, sums.get(name, "").encode())
        lanes.append((_info(name, key, shape), hdf5.planned(key, np.dtype("f4"), shape, f"plane {k}", {"axistags": axis_tags("zyx")})))
        box = boxes.get(name)
        size = (box["y1"] - box["y0"] + 1, box["x1"] - box["x0"] + 1, 1) if box else None
        blocks.append(hdf5.planned("block0000", np.dtype("u1"), size, f"labels {k}", _block_attributes(box["x0"], box["y0"], size)) if box else None)
    plan = hdf5.layout(_tree(lanes, blocks, time, class_names, colors, trees, classes))

    heads = spark.createDataFrame([(file, plan.size, at, bytearray(block)) for at, block in plan.blocks], _RANGES)
    planes = [(name, plan.gaps[f"plane {k}"], width * height) for name, k in numbers.items() if width * height]
    out = heads.unionByName(_filled(samples.select(F.col("image_id").alias("key"), F.col("i").alias("at"), F.col("v").alias("value")), planes, "f4", file, plan.size))
    if not boxes:
        return out
    corners = spark.createDataFrame([(n, b["x0"], b["y0"], b["x1"] - b["x0"] + 1) for n, b in boxes.items()], "image_id string, x0 long, y0 long, w long")
    cells = painted.join(F.broadcast(corners), "image_id")
    cells = cells.select(F.col("image_id").alias("key"), ((F.col("y") - F.col("y0")) * F.col("w") + F.col("x") - F.col("x0")).alias("at"), (F.col("cls") + 1).alias("value"))
    starts = [(n, plan.gaps[f"labels {numbers[n]}"], (b["y1"] - b["y0"] + 1) * (b["x1"] - b["x0"] + 1)) for n, b in boxes.items()]
    return out.unionByName(_filled(cells, starts, "u1", file, plan.size))


def manifest(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """What a project of ``(ord, image_id, width, height)`` holds: lane, nickname, shape and the block of labels."""
    rows = images.join(boxes, "image_id", "left")
    return rows.select(
        lane_name(F.col("ord")).alias("lane"), label_set_name(F.col("ord")).alias("label_set"), strip_extension(F.col("image_id")).alias("nickname"),
        F.format_string("1,%d,%d", "height", "width").alias("shape"),
        F.when(F.col("x0").isNotNull(), block_slice(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"))).alias("block_slice"),
    )
