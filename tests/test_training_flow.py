import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.operators import filters, forest, labels, planes, raster
from gridmill.plans import pipeline
from gridmill.sinks import files
from gridmill.streaming import progress, state


def plane(spark, w, h, seed=0):
    values = np.random.default_rng(seed).integers(0, 50, w * h).tolist()
    rows = [("a", k % w, k // w, k, float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "image_id string, x int, y int, i long, v double").repartition(3)


@pytest.mark.parametrize("tile, sigma", [(1, 1.0), (5, 1.0), (7, 2.5), (100, 1.0)])
def test_tiles_change_nothing(spark, monkeypatch, tile, sigma):
    pixels = plane(spark, 31, 13)
    want = {(r.x, r.y): r for r in filters.features(pixels, sigma).collect()}
    monkeypatch.setattr(filters, "TILE", tile)
    got = filters.features(pixels, sigma, 31, 13).collect()
    assert len(got) == len(want) == 31 * 13
    for r in got:
        assert np.allclose(r[3:], want[r.x, r.y][3:], rtol=0, atol=1e-12)


def test_no_window_beyond_a_tile(spark):
    counts = filters._with_halos(plane(spark, 100, 3), "x", 10, 4).groupBy("y", "_tile").count().agg(F.max("count")).first()[0]
    assert counts == 10 + 2 * 4
    plan = filters.horizontal(plane(spark, 100, 3), tile=10)._jdf.queryExecution().executedPlan().toString()
    assert "_tile" in next(line for line in plan.splitlines() if "Window " in line)


def test_wide_rasters_are_dealt_by_tiles(spark, monkeypatch):
    rows = spark.createDataFrame([(x,) for x in range(0, 60, 2)], "x int")
    make = lambda: raster.rasterize(rows, F.lit("a"), F.col("x"), F.lit(0), 60, 2)
    want = sorted(map(tuple, make().collect()))
    monkeypatch.setattr(raster, "TILE", 10)
    assert sorted(map(tuple, make().collect())) == want


def test_painted_again_goes_to_the_end(spark):
    rows = [("a", 0, 0, 1, 1), ("a", 1, 0, 2, 2), ("b", 0, 0, 3, 3), ("a", 0, 0, 0, 4), ("a", 2, 0, None, 5)]
    edits = spark.createDataFrame(rows, "image_id string, x int, y int, cls int, at long")
    found = pipeline.numbered(labels.keep_latest(edits, ["at"], ["at"]), ["image_id", "at"])
    assert [tuple(r)[:5] for r in found.orderBy("row").collect()] == [("a", 1, 0, 2, 2), ("a", 0, 0, 0, 4), ("b", 0, 0, 3, 3)]


def test_numbers_by_ranges(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id * 37 % 200 as k").repartition(5)
    few = sorted(map(tuple, pipeline.numbered(rows, ["k"]).collect()))
    monkeypatch.setattr(pipeline, "FEW_ROWS", 10)
    assert sorted(map(tuple, pipeline.numbered(rows, ["k"]).collect())) == few == [(k, k) for k in range(200)]


def test_features_once(spark, monkeypatch):
    """The bank is planned once, and labels are sent to the features, which are read where they lie."""
    pixels = plane(spark, 12, 9)
    painted = pixels.where("i % 5 = 0").selectExpr("image_id", "i", "int(i % 3) as cls", "-i as at")
    made = []
    own = filters.features
    monkeypatch.setattr(filters, "features", lambda *a, **k: made.append(1) or own(*a, **k))
    config = forest.ForestConfig(trees=3, depth=4)
    counts = pipeline.retrain(pixels, painted, 12, 9, config=config, order=["at"])
    assert len(made) == 1 and sum(r.objects for r in counts.collect()) > 0
    plan = pipeline.training_set(pipeline.materialize(own(pixels), "features"), painted, 22)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    # The same rows in another order: trees draw others.
    forest_of = lambda order: forest.collect_forest(forest.train(pipeline.numbered(pipeline.training_set(own(pixels), painted), order), filters.FEATURES, config))
    assert forest_of(["i"]) != forest_of(["at"])
    few = pipeline.retrain(pixels, painted.limit(3), 12, 9, config=config)
    assert [r.objects for r in few.collect()] == [0] * 4


def test_intake_stream(spark, tmp_path):
    rng = random.Random(2)
    suffix = [".tif", ".TIFF", ".png", ".txt"]
    rows = [(k, f"f{rng.randrange(12)}{rng.choice(suffix)}", rng.randrange(3)) for k in range(120)]
    schema = "ord long, name string, file_size long"
    known = spark.createDataFrame([(-1, "f1.tif", 0), (-2, "f2.png", 1)], schema)
    own, folder = state.stateful(spark, 2), f"{tmp_path}/in"
    for a, b in ((0, 50), (50, 51), (51, 120)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = state.intake_stream(own.readStream.schema(schema).parquet(folder), own.createDataFrame(known.collect(), schema))
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    want = planes.intake(spark.createDataFrame(rows, schema), known).select("ord", "name", "file_size")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 15


def test_progress_of_an_export(spark, tmp_path):
    listener = progress.ExportProgress()
    spark.streams.addListener(listener)
    try:
        for k in range(3):
            pixels = spark.range(6).selectExpr(f"'image{k}' as image_id", "id as i", "int(id % 3) as code")
            files.segmentation_ranges(pixels, 3, 2).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        from gridmill.sinks import ranges

        spark.dataSource.register(ranges.RangeSink)
        stream = progress.observed(spark.readStream.schema(ranges.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        q = stream.writeStream.format("gridmill_ranges").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").start()
        q.processAllAvailable()
        until = time.time() + 20
        while listener.totals()["files"] < 3 and time.time() < until:
            time.sleep(0.2)
        assert q.isActive and [h["files"] for h in listener.history()][:4] == [0, 1, 2, 3]
        q.stop()
    finally:
        spark.streams.removeListener(listener)
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.tif"))
    assert listener.totals()["bytes"] == size and listener.totals()["ranges"] == 6
