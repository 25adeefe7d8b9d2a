"""Project files read back: the driver reads their directories, tasks read planes and blocks of labels by ranges."""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.shipping import ship
from gridmill.sinks import hdf5
from gridmill.sinks.ranges import local_path

#: Cells that one row of a scan's plan covers.
PART_CELLS = 1 << 20
#: Fixed values of the project format: names of the texts that stand alone.
TEXTS = frozenset((
    "ilastikVersion", "workflowName", "time", "StorageVersion", "ClassifierFactory", "__class__", "axistags", "datasetId", "display_mode",
    "filePath", "inner_path", "location", "nickname",
))


class Project:
    """A project file on a file system that driver and executors mount."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, str(local_path(path))
        with open(self._path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            self._places = hdf5.read_places(data)

    def _small(self, dataset: tuple) -> bytes:
        _, start, length, _ = dataset
        with open(self._path, "rb") as f:
            f.seek(start)
            return f.read(length)

    def _cells(self, rows: list[tuple], columns: str, kind: str, value: str) -> DataFrame:
        """``rows (columns…, start, n)`` as a row for each of their ``n`` cells: the columns, the cell's number ``at``, and its value."""
        ship(self._spark)
        path, dtype = self._path, np.dtype(kind)
        names = [c.split()[0] for c in columns.split(", ")]
        parts = self._spark.createDataFrame(rows, f"{columns}, start long, n long").where("n > 0")
        parts = parts.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PART_CELLS).cast("long"))))
        parts = parts.repartition(max(1, min(sum(-(-r[-1] // PART_CELLS) for r in rows), 10_000)), "start", "first")

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.to_dict("records"):
                    count = min(PART_CELLS, row["n"] - row["first"])
                    values = np.fromfile(path, dtype, count, offset=row["start"] + row["first"] * dtype.itemsize)
                    yield pd.DataFrame({**{c: row[c] for c in names}, "at": np.arange(row["first"], row["first"] + count), value: values})

        kinds = {"f": "float", "u": "short"}
        return parts.mapInPandas(read, f"{columns}, at long, {value} {kinds[dtype.kind]}")

    def planes(self) -> DataFrame:
        """``(lane, nickname, i, v)``: raw data, by the paths that the lanes name."""
        inputs, rows = self._places["Input Data"], []
        for lane, info in inputs["infos"].items():
            raw = info["Raw Data"]
            shape, start, _, _ = inputs["local_data"][self._small(raw["inner_path"]).decode().rsplit("/", 1)[-1]]
            rows.append((lane, self._small(raw["nickname"]).decode(), start, int(np.prod(shape, dtype=object))))
        return self._cells(rows, "lane string, nickname string", "<f4", "v").withColumnRenamed("at", "i")

    def label_blocks(self) -> DataFrame:
        """``(label_set, x, y, code)``: cells of the blocks of labels, at the places that their slices name; 0 where none."""
        rows = []
        for name, blocks in self._places["PixelClassification"]["LabelSets"].items():
            for shape, start, _, attributes in blocks.values():
                (y0, _), (x0, _), _ = (map(int, part.split(":")) for part in attributes["blockSlice"][1:-1].split(","))
                rows.append((name, x0, y0, shape[1], start, shape[0] * shape[1]))
        cells = self._cells(rows, "label_set string, x0 long, y0 long, w long", "u1", "code")
        return cells.select("label_set", (F.col("x0") + F.col("at") % F.col("w")).alias("x"), (F.col("y0") + F.floor(F.col("at") / F.col("w"))).alias("y"), "code")

    def texts(self) -> DataFrame:
        """``(path, value)``: every text of the file that stands alone (not in a list), up to the null that ends it."""

        def walk(item: dict | tuple, path: str) -> Iterator[tuple[str, str]]:
            if isinstance(item, dict):
                for name, child in item.items():
                    yield from walk(child, f"{path}/{name}")
            elif path.rsplit("/", 1)[-1] in TEXTS:
                yield path, self._small(item).rstrip(b"\0").decode()

        return self._spark.createDataFrame(list(walk(self._places, "")), "path string, value string")

    def selection(self) -> DataFrame:
        """``(feature, scale_index, feature_id, scale, selected)``: the features and scales that the file selects."""
        found = self._places["FeatureSelections"]
        (n,), ids = found["FeatureIds"][0], self._small(found["FeatureIds"])
        names = [ids[k * len(ids) // n : (k + 1) * len(ids) // n].rstrip(b"\0").decode() for k in range(n)]
        scales = np.frombuffer(self._small(found["Scales"]), "<f8")
        matrix = np.frombuffer(self._small(found["SelectionMatrix"]), np.int8).reshape(found["SelectionMatrix"][0])
        rows = [(f, s, names[f], float(scales[s]), bool(v)) for (f, s), v in np.ndenumerate(matrix)]
        return self._spark.createDataFrame(rows, "feature int, scale_index int, feature_id string, scale double, selected boolean")
