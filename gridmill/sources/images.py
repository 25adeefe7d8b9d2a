"""Image files as pixel relations. Files are read by Spark's readers, so any store they reach will do."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from gridmill.functions.scalars import channel_name
from gridmill.shipping import ship
from gridmill.sources import tiff

_SCHEMA = "name string, file_size long, width int, height int, channel int, channels int, dtype string, y int, row array<double>"


def _rows(name: str, size: int, samples: np.ndarray, dtype: str) -> Iterator[tuple]:
    height, width, channels = samples.shape
    for c in range(channels):
        for y in range(height):
            yield name, size, width, height, c, channels, dtype, y, samples[y, :, c].astype(float)


_ARROW = pa.schema([
    ("name", pa.string()), ("file_size", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("channel", pa.int32()),
    ("channels", pa.int32()), ("dtype", pa.string()), ("y", pa.int32()), ("row", pa.list_(pa.float64())),
])


def _batches(rows: Iterator[tuple], most: int = 256, schema: pa.Schema = _ARROW) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_tiff_rows(spark: SparkSession, path: str) -> DataFrame:
    """A row of samples for each image row and channel of the TIFF files under ``path``."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][iI][fF]*").load(path).select("path", "length", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, size, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                image = tiff.decode(content.as_py())
                yield from _batches(_rows(where.as_py().rsplit("/", 1)[-1], size.as_py(), image.samples, image.dtype))

    return files.mapInArrow(run, _SCHEMA)


def _photos(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("pathGlobFilter", "*.{png,PNG,jpg,JPG,jpeg,JPEG}").load(path)


def unreadable_photos(spark: SparkSession, path: str) -> DataFrame:
    """``(origin)`` of files under ``path`` that are named like pictures and cannot be read as such."""
    return _photos(spark, path).where(F.col("image.nChannels") < 0).select("image.origin")


def read_photo_rows(spark: SparkSession, path: str) -> DataFrame:
    """The luma of PNG and JPG files, row by row. Spark's image reader gives blue, green, red.

    A file that is no picture is an error that names it; :func:`unreadable_photos` lists such files beforehand.
    """
    ship(spark)
    files = _photos(spark, path)
    valid = F.raise_error(F.concat(F.lit("not a picture: "), F.col("image.origin")))
    files = files.where(F.when(F.col("image.nChannels") < 0, valid.cast("boolean")).otherwise(F.lit(True)))
    files = files.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, w, h, n, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(float)
                grey = pixels[:, :, :1] if n == 1 else (pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299]))[:, :, None]
                yield from _batches(_rows(where.rsplit("/", 1)[-1], len(data), grey, "uint8"))

    return files.mapInArrow(run, _SCHEMA)


def pixels(rows: DataFrame) -> DataFrame:
    """``(image_id, x, y, i, v)`` of rows of samples; channels become images of their own."""
    named = rows.withColumn("image_id", channel_name(F.col("name"), F.col("channel"), F.col("channels")))
    start = F.col("x0") if "x0" in rows.columns else F.lit(0)
    spread = named.select("image_id", "y", "width", start.alias("x0"), F.posexplode("row").alias("at", "v")).withColumn("x", F.col("at") + F.col("x0"))
    return spread.select("image_id", "x", "y", (F.col("y").cast("long") * F.col("width") + F.col("x")).alias("i"), "v")


#: Bytes of samples, as they lie in files, that one partition of a scan reads, about.
PART_BYTES = 8 << 20


class TiffSource(DataSource):
    """``spark.read.format("gridmill_tiff").option("path", …)``: TIFF files of a folder, read by ranges of strips or tiles.

    Directories are read once, when the scan is planned; a partition reads the bytes of its own strips or tiles only. With the option ``pushdown``, which
    needs ``spark.sql.python.filterPushdown.enabled``, conditions on ``y``, ``channel`` and ``name`` leave out strips, planes and files. A row is a piece of an
    image row of one channel that begins at column ``x0``. Files lie on a mounted file system or one that pyarrow opens by its URI.
    """

    @classmethod
    def name(cls) -> str:
        return "gridmill_tiff"

    def schema(self) -> str:
        return _SCHEMA.replace("y int,", "y int, x0 int,")

    def reader(self, schema) -> DataSourceReader:
        pushdown = self.options.get("pushdown", "false").lower() == "true"
        return (PushedTiffReader if pushdown else TiffReader)(self.options["path"])


class _Files:
    """Listing and ranges of files, by path or URI."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        bare = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file:///") else path
        self._fs, self._root = fs.FileSystem.from_uri(bare) if "://" in bare else (fs.LocalFileSystem(), bare)

    def tiffs(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        at = self._fs.get_file_info(self._root)
        found = [at] if at.is_file else self._fs.get_file_info(fs.FileSelector(self._root))
        return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.lower().endswith((".tif", ".tiff")) and not f.base_name.startswith((".", "_")))

    def open(self, path: str):
        return self._fs.open_input_file(path)


@dataclass(frozen=True)
class Blocks(InputPartition):
    """Some strips or tiles of one file."""

    path: str
    file_size: int
    layout: tiff.Layout
    numbers: tuple[int, ...]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]


class TiffReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self._path = path
        self._low, self._high = 0, 1 << 40
        self._channels: set[int] | None = None
        self._names: set[str] | None = None

    def _wanted(self, at: tiff.Layout, k: int) -> bool:
        plane, y, _, h, _ = at.place(k)
        return y <= self._high and y + h > self._low and (self._channels is None or not at.planar or plane in self._channels)

    def partitions(self) -> list[InputPartition]:
        files, out = _Files(self._path), []
        for path, size in files.tiffs():
            if self._names is not None and path.rsplit("/", 1)[-1] not in self._names:
                continue
            with files.open(path) as f:
                at = tiff.layout(lambda offset, n, f=f: f.read_at(n, offset))
            wanted = [k for k in range(len(at.offsets)) if self._wanted(at, k)]
            bare = replace(at, offsets=(), sizes=())
            ends = np.cumsum([at.sizes[k] for k in wanted])
            cuts = [0, *(np.flatnonzero(np.diff(ends // PART_BYTES)) + 1).tolist(), len(wanted)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    some = wanted[a:b]
                    out.append(Blocks(path, size, bare, tuple(some), tuple(at.offsets[k] for k in some), tuple(at.sizes[k] for k in some)))
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Blocks):
            schema = pa.schema([*_ARROW][:8] + [pa.field("x0", pa.int32())] + [*_ARROW][8:])
            yield from _batches(self._rows(partition), schema=schema)

    def _rows(self, part: Blocks) -> Iterator[tuple]:
        at, name = part.layout, part.path.rsplit("/", 1)[-1]
        with _Files(self._path).open(part.path) as f:
            for k, offset, size in zip(part.numbers, part.offsets, part.sizes, strict=True):
                plane, y, x, _, _ = at.place(k)
                block = at.block(k, f.read_at(size, offset))
                for c in [plane] if at.planar else range(at.channels):
                    if self._channels is None or c in self._channels:
                        samples = block[:, :, 0 if at.planar else c].astype(float)
                        for d in range(max(0, self._low - y), min(len(samples), self._high - y + 1)):
                            yield name, part.file_size, at.width, at.height, c, at.channels, at.dtype, y + d, x, samples[d]


class PushedTiffReader(TiffReader):
    """Spark refuses a reader that takes conditions in a session where they are not handed on, so the plain one takes none."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """What is left out by whole strips Spark still checks row by row."""
        both = lambda old, new: new if old is None else old & new
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and column == "y":
                self._low, self._high = max(self._low, min(values)), min(self._high, max(values))
            elif values is not None and column == "channel":
                self._channels = both(self._channels, values)
            elif values is not None and column == "name":
                self._names = both(self._names, values)
            elif column == "y" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self._low = max(self._low, f.value)
            elif column == "y" and isinstance(f, LessThan | LessThanOrEqual):
                self._high = min(self._high, f.value)
            yield f


def scan_tiffs(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of rows of the TIFF files under ``path``, see :class:`TiffSource`; conditions on them reach the scan."""
    ship(spark)
    spark.dataSource.register(TiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("gridmill_tiff").option("path", path).option("pushdown", "true").load()
