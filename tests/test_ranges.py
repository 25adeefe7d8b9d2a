import io
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from gridmill.sinks import files, ranges
from gridmill.sources import images, tiff


def coded(spark, n=6):
    return spark.range(n).selectExpr("'a.png' as image_id", "id as i", "int(id % 3) as code", *[f"double(id) / {k + 1} as p{k}" for k in range(4)])


def written(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if not p.name.endswith(".crc")}


def test_tiff_files_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RANGE_PIXELS", 7)
    monkeypatch.setattr(files, "STRIP_BYTES", 100)
    w, h = 8, 9
    pixels = coded(spark, w * h)
    both = files.segmentation_ranges(pixels, w, h).unionByName(files.probability_ranges(pixels, w, h))
    assert both.groupBy("file").count().agg(F.min("count")).first()[0] >= w * h // 7
    ranges.save(both, f"file://{tmp_path}/out")
    got = written(tmp_path / "out")
    assert sorted(got) == ["a_probabilities.tif", "a_segmentation.tif"]
    assert tiff.decode(got["a_segmentation.tif"]).samples.ravel().tolist() == [k % 3 for k in range(w * h)]
    p = tiff.decode(got["a_probabilities.tif"])
    assert p.dtype == "float32" and (p.samples[:, :, 3].ravel() == np.arange(w * h, dtype=np.float32) / 4).all()
    assert len(tiff.layout(lambda a, n: got["a_probabilities.tif"][a : a + n]).offsets) > 1


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    good = files.segmentation_ranges(coded(spark), 3, 2)
    ranges.save(good, str(tmp_path))
    before = written(tmp_path)

    def fail(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("lost")

    bad = spark.range(3).selectExpr("concat('b', id, '.tif') as file", "4L as size", "0L as offset", "cast('abcd' as binary) as data").repartition(3)
    with pytest.raises(Exception, match="lost"):
        ranges.save(bad.union(good.mapInArrow(fail, good.schema)), str(tmp_path))
    assert written(tmp_path) == before
    with pytest.raises(Exception, match="do not fill"):
        ranges.save(bad.withColumn("size", F.lit(5).cast("long")), str(tmp_path))
    with pytest.raises(Exception, match="not the name"):
        ranges.save(bad.withColumn("file", F.lit("../x")), str(tmp_path))
    assert written(tmp_path) == before
    with pytest.raises(Exception, match="mounted"):
        ranges.save(good, "hdfs://somewhere/x")


def test_ranges_as_a_stream(spark, tmp_path):
    files.segmentation_ranges(coded(spark), 3, 2).write.parquet(f"{tmp_path}/in")
    spark.dataSource.register(ranges.RangeSink)
    stream = spark.readStream.schema(ranges.SCHEMA).parquet(f"{tmp_path}/in")
    q = stream.writeStream.format("gridmill_ranges").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert tiff.decode(written(tmp_path / "out")["a_segmentation.tif"]).samples.shape == (2, 3, 1)


def test_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RANGE_PIXELS", 5)
    pixels = coded(spark, 42)
    both = files.segmentation_ranges(pixels, 6, 7).unionByName(files.probability_ranges(pixels.withColumn("image_id", F.lit("é.tif")), 6, 7))
    ranges.save(files.zip_ranges(both, "all.zip"), str(tmp_path))
    archive = zipfile.ZipFile(io.BytesIO(written(tmp_path)["all.zip"]))
    assert archive.testzip() is None and sorted(archive.namelist()) == ["a_segmentation.tif", "é_probabilities.tif"]
    ranges.save(both, f"{tmp_path}/plain")
    assert {n: archive.read(n) for n in archive.namelist()} == written(tmp_path / "plain")
    assert files.zip_ranges(both.where("false"), "none.zip").count() == 0


def test_joined_crc():
    rng = random.Random(1)
    for _ in range(20):
        parts = [rng.randbytes(rng.randrange(200)) for _ in range(5)]
        assert files.joined_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def blocks_of(reader):
    return sum(len(p.numbers) for p in reader.partitions() if isinstance(p, images.Blocks))


def test_split_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(images, "PART_BYTES", 600)
    plane = np.random.default_rng(2).integers(0, 1000, (40, 20, 2)).astype("u2")
    (tmp_path / "one.tif").write_bytes(tiff.header(20, 40, 2, plane.dtype, 3) + plane.tobytes())
    (tmp_path / "two.TIFF").write_bytes(tiff.encode(plane[:5, :4]))
    (tmp_path / "no.txt").write_text("no")
    rows = images.scan_tiffs(spark, str(tmp_path))
    got = {(r.image_id, r.x, r.y): r.v for r in images.pixels(rows).collect()}
    want = {(f"{f} [ch{c}]", x, y): float(p[y, x, c]) for f, p in (("one.tif", plane), ("two.TIFF", plane[:5, :4])) for c in range(2) for y in range(p.shape[0]) for x in range(p.shape[1])}
    assert got == want
    some = rows.where("name = 'one.tif' and y >= 10 and y < 13 and channel = 1")
    assert {(r.y, tuple(r.row)) for r in some.collect()} == {(y, tuple(plane[y, :, 1].astype(float))) for y in (10, 11, 12)}
    # 14 strips of three rows in one file, one in the other; rows 10 to 12 lie in two strips.
    assert blocks_of(images.TiffReader(str(tmp_path))) == 15 and len(images.TiffReader(str(tmp_path)).partitions()) > 5
    reader = images.PushedTiffReader(str(tmp_path))
    pushed = [EqualTo(("name",), "one.tif"), GreaterThanOrEqual(("y",), 10), LessThan(("y",), 13), In(("channel",), (1,))]
    assert list(reader.pushFilters(pushed)) == pushed and blocks_of(reader) == 2
    assert images.TiffReader(str(tmp_path / "one.tif")).partitions()[0].numbers[0] == 0


def test_tiles_are_pieces_of_rows():
    at = tiff.Layout(10, 7, 1, np.dtype("u1"), False, True, 4, 4, (), (), 1, 1)
    assert [at.place(k) for k in (0, 2, 5)] == [(0, 0, 0, 4, 4), (0, 0, 8, 4, 2), (0, 4, 8, 3, 2)]
    assert at.block(5, bytes(range(16))).shape == (3, 2, 1)
