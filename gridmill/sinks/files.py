"""Image files and archives of them, made of pixel relations as ranges of bytes (see :mod:`gridmill.sinks.ranges`)."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.constants import NUM_CLASSES
from gridmill.shipping import ship
from gridmill.sources import tiff
from gridmill.store import materialize

#: Bytes of a strip, and pixels that one range of an image file covers, about.
STRIP_BYTES = 1 << 20
RANGE_PIXELS = 1 << 16
_RANGES = "file string, size long, offset long, data binary"


def tiff_ranges(pixels: DataFrame, columns: list[str], kind: str, suffix: str, width: int, height: int) -> DataFrame:
    """A TIFF file for each image of a dense raster: its ``columns`` as channels, in ranges of ``RANGE_PIXELS`` pixels.

    The samples' places follow from pixel indices, so no task sees an image whole. Pixels that are missing leave their file unfilled, which is an
    error when it is written.
    """
    ship(pixels.sparkSession)
    dtype, channels = np.dtype(kind).newbyteorder("<"), len(columns)
    pixel_bytes = channels * dtype.itemsize
    head = tiff.header(width, height, channels, dtype, max(1, STRIP_BYTES // (width * pixel_bytes)))
    size = len(head) + width * height * pixel_bytes

    def make(table: pa.Table) -> pa.Table:
        i = table["i"].to_numpy()
        order = np.argsort(i, kind="stable")
        i = i[order]
        samples = np.stack([table[c].to_numpy()[order] for c in columns], axis=1).astype(dtype)
        starts = np.flatnonzero(np.append(True, np.diff(i) != 1))
        offsets = [len(head) + int(k) * pixel_bytes for k in i[starts]]
        data = [x.tobytes() for x in np.split(samples, starts[1:])]
        if i[0] == 0:
            offsets, data = [0, *offsets], [head, *data]
        file = table["file"][0].as_py()
        return pa.table({"file": [file] * len(data), "size": pa.array([size] * len(data), pa.int64()), "offset": pa.array(offsets, pa.int64()), "data": pa.array(data, pa.binary())})

    name = F.concat(F.regexp_replace("image_id", r"\.[^.]*$", ""), F.lit(suffix))
    part = F.floor(F.col("i") / RANGE_PIXELS)
    return pixels.select(name.alias("file"), part.alias("part"), "i", *columns).groupBy("file", "part").applyInArrow(make, _RANGES)


def segmentation_ranges(coded: DataFrame, width: int, height: int) -> DataFrame:
    """One byte a pixel: 0 unclassified, else class + 1."""
    return tiff_ranges(coded, ["code"], "u1", "_segmentation.tif", width, height)


def probability_ranges(pixels: DataFrame, width: int, height: int, classes: int = NUM_CLASSES) -> DataFrame:
    return tiff_ranges(pixels, [f"p{c}" for c in range(classes)], "f4", "_probabilities.tif", width, height)


# --- archives -------------------------------------------------------------------------------------

#: Fixed value: the polynomial of CRC-32, lowest power first.
_CRC_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of polynomials of 32 coefficients (the highest bit is 1) modulo the CRC's."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (_CRC_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of bytes in a row, from each part's length and CRC."""
    total = 0
    for n, crc in parts:
        power, by = 0x80000000, 0x00800000  # 1, and x to the 8th: a shift by one byte
        while n:
            power = _times(power, by) if n & 1 else power
            by, n = _times(by, by), n >> 1
        total = _times(power, total) ^ crc
    return total


def zip_ranges(ranges: DataFrame, archive: str) -> DataFrame:
    """The files of ``ranges`` as members of one ZIP file, again in ranges.

    Each range is deflated where it lies: its blocks end at a byte, so the blocks of a member's ranges in a row are one deflate stream. The
    members' places are sums of sizes. A table of a row for each member is all that is ordered at once; nothing comes to the driver. Without
    files there is no archive. One of 4 GB or of 65,535 members is an error.
    """
    ship(ranges.sparkSession)

    def pack(batches):
        for batch in batches:
            file, size, offset, data = (batch.column(k).to_pylist() for k in range(4))
            packed = []
            for n, at, raw in zip(size, offset, data, strict=True):
                z = zlib.compressobj(6, zlib.DEFLATED, -15)
                packed.append(z.compress(raw) + z.flush(zlib.Z_FINISH if at + len(raw) == n else zlib.Z_FULL_FLUSH))
            lengths = [len(x) for x in data]
            columns = [pa.array(file), pa.array(offset, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "offset", "n", "crc", "data"])

    packed = ranges.select("file", "size", "offset", "data").mapInArrow(pack, "file string, offset long, n long, crc long, data binary")
    packed = materialize(packed.where(F.col("n") > 0), "deflated")
    whole_crc = F.udf(lambda parts: joined_crc([(p["n"], p["crc"]) for p in parts]), "long")
    parts = F.array_sort(F.collect_list(F.struct("offset", "n", "crc")))
    members = packed.groupBy("file").agg(F.sum("n").alias("n"), F.sum(F.length("data")).cast("long").alias("packed"), whole_crc(parts).alias("crc"))
    name = F.octet_length("file").cast("long")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    members = members.withColumns({
        "start": sums(30 + name + F.col("packed"), before), "entry": sums(46 + name, before), "bodies": sums(30 + name + F.col("packed"), all_),
        "entries": sums(46 + name, all_), "members": F.count("*").over(all_), "last": F.lead("file").over(Window.orderBy("file")).isNull(),
    })
    members = materialize(members, "members")

    def heads(batches):
        for batch in batches:
            out = []
            for m in batch.to_pylist():
                total = m["bodies"] + m["entries"] + 22
                if total >= 1 << 32 or m["members"] >= 65535:
                    raise ValueError("an archive of this format holds less than 4 GB and 65,535 files")
                file = m["file"].encode()
                # Version, flags (names are UTF-8), deflate, time, date (the format's first day), CRC, sizes, name, no extra field.
                common = struct.pack("<HHHHHIIIHH", 20, 0x800, 8, 0, 33, m["crc"], m["packed"], m["n"], len(file), 0)
                out.append((total, m["start"], b"PK\3\4" + common + file))
                out.append((total, m["bodies"] + m["entry"], b"PK\1\2" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, m["start"]) + file))
                if m["last"]:
                    out.append((total, m["bodies"] + m["entries"], b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, m["members"], m["members"], m["entries"], m["bodies"], 0)))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(out)), *columns], names=["file", "size", "offset", "data"])

    within = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    bodies = packed.withColumn("packed_before", sums(F.length("data").cast("long"), within)).join(members.select("file", "start", "bodies", "entries"), "file")
    bodies = bodies.select(
        F.lit(archive).alias("file"), (F.col("bodies") + F.col("entries") + 22).alias("size"), (F.col("start") + 30 + name + F.col("packed_before")).alias("offset"), "data",
    )
    return members.mapInArrow(heads, _RANGES).unionByName(bodies)
