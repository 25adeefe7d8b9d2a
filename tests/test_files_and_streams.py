import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.functions import scalars
from gridmill.operators import filters, forest, planes
from gridmill.operators.labels import keep_latest
from gridmill.sinks import hdf5, project, ranges
from gridmill.sources import images, tiff
from gridmill.sources import project as sources_project
from gridmill.streaming import events


@pytest.mark.parametrize("kind", ["u1", "i1", "u2", "i2", "u4", "i4", "f4", "f8"])
def test_tiff_round_trip(kind):
    plane = np.random.default_rng(0).integers(0, 100, (5, 7, 3)).astype(kind)
    got = tiff.decode(tiff.encode(plane))
    assert got.samples.dtype == plane.dtype and (got.samples == plane).all()


def _repacked(plane, compression, pack):
    """An image of one strip, packed otherwise."""
    data = tiff.encode(plane)
    body = pack(plane.tobytes())
    n = struct.unpack_from("<H", data, 8)[0]
    out = bytearray(data[: len(data) - plane.nbytes] + body)
    for k in range(n):
        at = 10 + 12 * k
        tag = struct.unpack_from("<H", out, at)[0]
        if tag == 259:
            struct.pack_into("<H", out, at + 8, compression)
        if tag == 279:
            struct.pack_into("<I", out, at + 8, len(body))
    return bytes(out)


def test_packed_tiff():
    plane = (np.arange(600, dtype=np.uint8) // 9).reshape(20, 30)
    literal = lambda b: b"".join(bytes([len(b[k : k + 128]) - 1]) + b[k : k + 128] for k in range(0, len(b), 128))
    for compression, pack in ((8, zlib.compress), (32773, literal)):
        assert (tiff.decode(_repacked(plane, compression, pack)).samples[:, :, 0] == plane).all()
    with pytest.raises(ValueError):
        tiff.decode(_repacked(plane, 1, lambda b: b[:100]))
    with pytest.raises(ValueError):
        tiff.decode(b"not an image")


def test_stacks_are_an_error():
    """A second image is appended to the chain; as a smaller version of the first it is passed over."""
    plane = np.arange(6, dtype=np.uint16).reshape(2, 3)
    data = tiff.encode(plane)
    entries = struct.unpack_from("<H", data, 8)[0]
    link = 10 + 12 * entries
    for reduced, error in ((0, True), (1, False)):
        page = struct.pack("<H", entries + 1) + struct.pack("<HHII", 254, 4, 1, reduced) + data[10:link] + struct.pack("<I", 0)
        stack = data[:link] + struct.pack("<I", len(data)) + data[link + 4 :] + page
        if error:
            with pytest.raises(ValueError, match="two-dimensional"):
                tiff.decode(stack)
        else:
            assert tiff.decode(stack).samples[:, :, 0].tolist() == plane.tolist()


def test_tiff_files_through_spark(spark, tmp_path):
    plane = np.arange(2 * 3 * 4, dtype=np.uint16).reshape(3, 4, 2)
    (tmp_path / "one.TIF").write_bytes(tiff.encode(plane))
    (tmp_path / "skip.txt").write_text("no")
    rows = images.read_tiff_rows(spark, f"file://{tmp_path}")
    got = {(r.image_id, r.x, r.y): r.v for r in images.pixels(rows).collect()}
    assert got == {(f"one.TIF [ch{c}]", x, y): float(plane[y, x, c]) for c in range(2) for y in range(3) for x in range(4)}
    spark.dataSource.register(images.TiffSource)
    again = spark.read.format("gridmill_tiff").option("path", str(tmp_path)).load()
    assert again.count() == rows.count() and again.first().dtype == "uint16"


def _png(rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    block = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + block(b"IDAT", zlib.compress(raw)) + block(b"IEND", b"")


def test_png_luma(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (2, 3, 3)).astype(np.uint8)
    (tmp_path / "p.png").write_bytes(_png(rgb))
    got = {(r.x, r.y): r.v for r in images.pixels(images.read_photo_rows(spark, f"file://{tmp_path}")).collect()}
    for y in range(2):
        for x in range(3):
            assert abs(got[x, y] - rgb[y, x] @ np.array([0.299, 0.587, 0.114])) < 1e-9


def test_project_file():
    ramp = (1000 + 0.25 * np.arange(12)).astype(np.float32).reshape(3, 4)
    data = project.build([project.ProjectImage(f"cells{k}.tif", ramp, [(2, 7, 0), (6, 9, 1), (4, 8, 2)] if k == 0 else []) for k in range(3)], "now", ["a", "b", "c", "d"])
    assert data[:8] == bytes.fromhex("894844460d0a1a0a") and struct.unpack_from("<Q", data, 40)[0] == len(data)
    tree = hdf5.read_tree(data)
    assert ramp.tobytes() in data
    assert sorted(tree["Input Data"]["infos"]) == ["lane0000", "lane0001", "lane0002"]
    sets = tree["PixelClassification"]["LabelSets"]
    assert sorted(sets) == ["labels000", "labels001", "labels002"] and sets["labels001"] == {}
    shape, raw, attributes = sets["labels000"]["block0000"]
    assert attributes["blockSlice"] == "[7:10,2:7,0:1]" and shape == (3, 5, 1)
    assert np.frombuffer(raw, np.uint8).reshape(3, 5).tolist() == [[1, 0, 0, 0, 0], [0, 0, 3, 0, 0], [0, 0, 0, 0, 2]]
    assert tree["Input Data"]["infos"]["lane0000"]["Raw Data"]["nickname"][1] == b"cells0"
    assert b"abcd" in tree["PixelClassification"]["LabelNames"][1]
    with pytest.raises(ValueError):
        project.build([project.ProjectImage(f"i{k}", ramp) for k in range(100)], "now")


def _edits(spark):
    rows = [(k, f"2024-01-01 00:00:{s:02d}", "a", k % 2, 0, None if k == 5 else k % 4) for k, s in enumerate((0, 1, 2, 30, 31, 59))]
    return spark.createDataFrame(rows, "event_id long, at string, image_id string, x int, y int, cls int").withColumn("ts", F.to_timestamp("at")).drop("at")


def _streamed(spark, df, tmp_path, build, out):
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    late = df.limit(1).withColumn("ts", F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    late.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = build(stream).writeStream.outputMode("append").format("memory").queryName(out).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(out)


def test_stream_twins(spark, tmp_path):
    df = _edits(spark)
    sessions = lambda d: events.debounced(d, "5 seconds", ["image_id"])
    want = sorted(map(tuple, sessions(df).collect()))
    assert [w[-1] for w in want] == [3, 2, 1]
    assert sorted(map(tuple, _streamed(spark, df, tmp_path / "s", sessions, "bursts").where("first_ts < '2024-06-01'").collect())) == want
    frames = lambda d: events.latest_of_frame(d, "10 seconds", ["image_id"], "event_id", tie="event_id")
    want = sorted(map(tuple, frames(df).collect()))
    assert sorted(map(tuple, _streamed(spark, df, tmp_path / "f", frames, "frames").where("frame_ts < '2024-06-01'").collect())) == want


def test_label_store(spark, tmp_path):
    df = _edits(spark)
    store = events.LabelStore(spark, tmp_path.name)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(store.sink()).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, store.labels().collect())) == sorted(map(tuple, keep_latest(df, ["ts", "event_id"]).collect())) == [("a", 0, 0, 0)]


def _project(spark, folder, *args, **kw):
    ranges.save(project.project_ranges(*args, time="now", **kw), f"file://{folder}")
    return folder / "project.ilp"


def test_project_export(spark, tmp_path):
    pixels = spark.range(12).selectExpr("'a.tif' as image_id", "id as i", "double(id) as v")
    labels = spark.createDataFrame([("a.tif", 1, 2, 3)], "image_id string, x int, y int, cls int")
    images = spark.createDataFrame([("a.tif", 0)], "image_id string, ord int")
    tree = hdf5.read_tree(_project(spark, tmp_path, pixels, labels, images, 4, 3).read_bytes())
    (plane,) = tree["Input Data"]["local_data"].values()
    assert plane[0] == (1, 3, 4) and np.frombuffer(plane[1], np.float32).tolist() == [float(k) for k in range(12)]
    assert tree["PixelClassification"]["LabelSets"]["labels000"]["block0000"][2]["blockSlice"] == "[2:3,1:2,0:1]"


def test_project_by_ranges_is_that_in_memory(spark, tmp_path, monkeypatch):
    """Images that end within a range, without labels or pixels, beside rows that play no part; only the keys differ."""
    monkeypatch.setattr(project, "RANGE_CELLS", 5)
    monkeypatch.setattr(sources_project, "PART_CELLS", 7)
    rng = np.random.default_rng(3)
    planes = {f"im{k}.x.tif": np.float32(rng.normal(size=(7, 9))) for k in range(3)} | {"none": np.zeros((7, 9), np.float32)}
    planes["im1.x.tif"][2:5] = 0
    cells = [(n, k, float(v)) for n, p in planes.items() for k, v in enumerate(p.reshape(-1)) if v]
    painted = {"im0.x.tif": [(8, 6, 0), (2, 1, 3)], "im2.x.tif": [(4, 4, 1)]}
    strokes = [(n, x, y, c) for n, ls in painted.items() for x, y, c in ls]
    others = [("unknown", 0, 1.0), (None, 0, 1.0), ("im0.x.tif", 63, 9.0), ("im0.x.tif", -1, 9.0)]
    pixels = spark.createDataFrame(cells + others, "image_id string, i long, v double")
    labels = spark.createDataFrame(strokes + [("unknown", 0, 0, 1), (None, 0, 0, 1), ("none", 3, 3, None)], "image_id string, x int, y int, cls int")
    images = spark.createDataFrame([(n, 9 - k) for k, n in enumerate(planes)] + [(None, 1)], "image_id string, ord int")
    order = list(reversed(planes))
    path = _project(spark, tmp_path, pixels, labels, images, 9, 7)
    want = hdf5.read_tree(project.build([project.ProjectImage(n, planes[n], painted.get(n, [])) for n in order], "now"))
    got = hdf5.read_tree(path.read_bytes())
    keys = [[x["Raw Data"]["datasetId"][1].decode() for _, x in sorted(t["Input Data"]["infos"].items())] for t in (got, want)]
    assert len(set(keys[0])) == 4
    for g, w in zip(*keys, strict=True):
        assert got["Input Data"]["local_data"][g] == want["Input Data"]["local_data"][w]
    assert got["PixelClassification"] == want["PixelClassification"] and got["FeatureSelections"] == want["FeatureSelections"]
    file = sources_project.Project(spark, f"file://{path}")
    read = {(r.lane, r.nickname, r.i): r.v for r in file.planes().collect()}
    assert read == {(f"lane{k:04d}", n.removesuffix(".tif"), i): float(v) for k, n in enumerate(order) for i, v in enumerate(planes[n].reshape(-1))}
    codes = {(r.label_set, r.x, r.y): r.code for r in file.label_blocks().collect()}
    assert {k: v for k, v in codes.items() if v} == {(f"labels{order.index(n):03d}", x, y): c + 1 for n, x, y, c in strokes} and len(codes) == 7 * 6 + 1
    again = _project(spark, tmp_path / "again", pixels.repartition(3), labels, images, 9, 7)
    assert again.read_bytes() == path.read_bytes()


def test_keys_of_data_sets(spark):
    """As an expression and on the driver."""
    got = spark.createDataFrame([("3:a.tif:x",), ("0::",), (None,)], "content string").select(scalars.key_uuid(F.col("content")))
    assert [r[0] for r in got.collect()] == [project._key(3, "a.tif", b"x"), project._key(0, "", b""), None]


def test_rank_errors(spark):
    shapes = spark.createDataFrame([([2, 3],), ([4],), ([1, 2, 3],), (None,), ([],)], "shape array<int>")
    got = [r["error"] for r in planes.with_rank_errors(shapes).collect()]
    assert got == [None, None, "only two-dimensional images are read, not 3 axes", "no shape", None]


def test_kernels_reach_so_far():
    assert filters.kernels(8.0)
    for sigma in (8.1, 0.0, -1.0):
        with pytest.raises(ValueError):
            filters.kernels(sigma)


def test_node_counts(spark):
    nodes = [(0, 0, 0, 5.0, 1, 2, -1), (0, 1, -1, 0.0, -1, -1, 0), (0, 2, -1, 0.0, -1, -1, 1), (1, 0, -1, 0.0, -1, -1, 3)]
    rows = spark.createDataFrame([(1.0,), (4.0,), (2.0,)], "f double")
    want = {(0, 0): 3, (0, 1): 3, (0, 2): 0, (1, 0): 3}
    assert {(r.tree, r.node): r.reached for r in forest.node_counts(rows, nodes, ["f"]).collect()} == want
    assert {r.reached for r in forest.node_counts(rows.limit(0), nodes, ["f"]).collect()} == {0}


def test_empty_and_large_projects(spark, tmp_path):
    pixels, labels = spark.createDataFrame([], "image_id string, i long, v double"), spark.createDataFrame([], "image_id string, x int, y int, cls int")
    none = spark.createDataFrame([], "image_id string, ord int")
    file = sources_project.Project(spark, str(_project(spark, tmp_path, pixels, labels, none, 4, 3)))
    assert file.planes().count() == file.label_blocks().count() == 0 and file.selection().where("selected").count() == 4
    many = spark.range(100).selectExpr("string(id) as image_id", "int(id) as ord")
    with pytest.raises(ValueError):
        project.project_ranges(pixels, labels, many, 4, 3, "now")


def test_null_pixels_in_projects(spark, tmp_path):
    pixels = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0)], "image_id string, i long, v double")
    labels = spark.createDataFrame([], "image_id string, x int, y int, cls int")
    images = spark.createDataFrame([("a", None)], "image_id string, ord int")
    (plane,) = hdf5.read_tree(_project(spark, tmp_path, pixels, labels, images, 2, 2).read_bytes())["Input Data"]["local_data"].values()
    got = np.frombuffer(plane[1], np.float32)
    assert np.isnan(got[0]) and got[1:].tolist() == [2.0, 0.0, 0.0]


def test_label_store_opens_again(spark, tmp_path):
    folder = f"file://{tmp_path}"
    edits = lambda *rows: spark.createDataFrame(rows, "image_id string, x int, y int, cls int, ts long, event_id long")
    store = events.LabelStore(spark, "a", folder)
    assert store.labels().count() == 0
    store.apply(edits(("a", 0, 0, 1, 1, 1), ("a", 1, 0, 2, 2, 2)), 0)
    store.apply(edits(("a", 1, 0, None, 3, 3)), 1)
    store.apply(edits(("a", 5, 5, 3, 4, 4)), 2)
    again = events.LabelStore(spark, "a", folder)
    assert sorted(map(tuple, again.labels().collect())) == [("a", 0, 0, 1), ("a", 5, 5, 3)]
    # A new stream counts its batches from 0; the same batch twice gives the same labels; an unfinished version does not count.
    for _ in range(2):
        again.apply(edits(("a", 9, 9, 0, 5, 5)), 0)
    (tmp_path / "labels-a" / "9-9").mkdir()
    third = events.LabelStore(spark, "a", folder)
    assert sorted(map(tuple, third.labels().collect())) == [("a", 0, 0, 1), ("a", 5, 5, 3), ("a", 9, 9, 0)]
    assert len([p for p in (tmp_path / "labels-a").iterdir() if (p / "_SUCCESS").exists()]) == 2


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from gridmill import shipping, store

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "local-cluster[2,1,1000]"

    assert not shipping.is_local(Session) and shipping.is_local(spark)
    with pytest.raises(RuntimeError):
        store.shared_dir(Session)
    sent = []
    Session.sparkContext.applicationId, Session.sparkContext.addPyFile = "app-x", staticmethod(sent.append)
    monkeypatch.setenv("PYTHONPATH", str(shipping._PACKAGE.parent))
    shipping.ship(Session)
    shipping.ship(Session)
    assert len(sent) == 1


def test_tables_are_released(spark):
    import os

    from gridmill import store

    df = store.materialize(spark.range(3), "few")
    path = df._gridmill_table.removeprefix("file://")
    assert df.count() == 3 and os.path.exists(path)
    store.release(df)
    assert not os.path.exists(path)


def test_temporary_tables(spark):
    import os

    from gridmill import store

    with store.temporary_tables(spark) as made:
        kept, gone = store.materialize(spark.range(3), "kept"), store.materialize(spark.range(4), "gone")
        made.remove(kept._gridmill_table)
    later = store.materialize(spark.range(2), "later")
    exists = [os.path.exists(x._gridmill_table.removeprefix("file://")) for x in (kept, gone, later)]
    assert exists == [True, False, True] and kept.count() == 3


def test_unreadable_photos(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(b"no picture")
    assert [r.origin.rsplit("/", 1)[-1] for r in images.unreadable_photos(spark, str(tmp_path)).collect()] == ["broken.png"]
    with pytest.raises(Exception, match="not a picture"):
        images.read_photo_rows(spark, str(tmp_path)).count()
