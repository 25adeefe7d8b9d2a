import random

import pytest
from pyspark.sql import functions as F

from gridmill.operators import forest, labels
from gridmill.plans import pipeline
from gridmill.streaming import events, state


def edits(spark, rows):
    made = spark.createDataFrame(rows, "event_id long, second int, image_id string, x int, y int, cls int")
    return made.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("second"))).drop("second")


def some_edits(seed, n, first=0):
    rng = random.Random(seed)
    return [(first + k, first + rng.randrange(n), rng.choice("ab"), rng.randrange(6), rng.randrange(5), rng.choice([None, 0, 1, 2, 3])) for k in range(n)]


def add(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def run(stream, checkpoint, mode, sink="noop", **options):
    q = stream.writeStream.outputMode(mode).format(sink).options(**options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return [p for p in q.recentProgress if p["numInputRows"]]


def as_set(df):
    return sorted((r.image_id, r.x, r.y, r.cls) for r in df.collect())


def test_labels_in_state(spark, tmp_path):
    """Stopped and started again; late and repeated edits; work by micro-batch."""
    own, folder, at = state.stateful(spark, 2), f"{tmp_path}/in", f"{tmp_path}/at"
    first, second = some_edits(1, 300), some_edits(2, 40, 200)
    add(edits(spark, first), folder)
    schema = edits(spark, first).schema
    changes = lambda: state.label_changes(own.readStream.schema(schema).parquet(folder), "1 hour")
    (progress,) = run(changes(), at, "update")
    assert as_set(state.labels_in(spark, at)) == as_set(labels.keep_latest(edits(spark, first), ["ts", "event_id"]))
    add(edits(spark, second + second[:5]), folder)
    add(edits(spark, [(9000, 0, None, 1, 1, 1)]), folder)
    latest = edits(spark, first + second)
    again = run(changes(), at, "update")
    assert as_set(state.labels_in(spark, at)) == as_set(labels.keep_latest(latest, ["ts", "event_id"]))
    touched = len({r[2:5] for r in second})
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in again) <= touched < progress["stateOperators"][0]["numRowsUpdated"]


def test_erasures_are_forgotten(spark, tmp_path):
    own, folder, at = state.stateful(spark, 1), f"{tmp_path}/in", f"{tmp_path}/at"
    schema = edits(spark, []).schema
    for rows in ([(1, 0, "a", 0, 0, 1), (2, 1, "a", 0, 0, None)], [(3, 5000, "a", 1, 1, 2)], [(4, 9000, "a", 2, 2, 2)], [(5, 0, "a", 0, 0, 3)]):
        add(edits(spark, rows), folder)
        run(state.label_changes(own.readStream.schema(schema).parquet(folder), "10 seconds"), at, "update")
    # The erasure's state is gone, and the last edit came too late.
    assert as_set(state.labels_in(spark, at)) == [("a", 1, 1, 2), ("a", 2, 2, 2)]
    kept = spark.read.format("statestore").option("stateVarName", "label").load(at)
    assert kept.where("key.x = 0").count() == 0


def plain_painting(rows):
    """One event after the other, as a browser would deliver them."""
    down, stroke, out = {}, {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        device, _, seq, pointer, primary, kind, image = r
        held = down.setdefault(device, set())
        if kind == "press":
            if primary:
                stroke[device] = image
                out.append(seq)
            held.add(pointer)
        elif kind == "move":
            if primary and len(held) <= 1 and stroke.get(device) == image:
                out.append(seq)
        else:
            if primary and stroke.get(device) == image:
                stroke[device] = None
            held.discard(pointer)
    return sorted(out)


def pointer_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        pointer = rng.randrange(3)
        rows.append((rng.randrange(4), rng.randrange(200), k, pointer, pointer == 0, rng.choice(["press", "move", "move", "move", "release"]), rng.choice(["a", "a", "a", "b"])))
    return rows


def pointers(spark, rows):
    made = spark.createDataFrame(rows, "device long, second int, seq long, pointer long, is_primary boolean, kind string, image_id string")
    return made.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("second"))).drop("second")


STROKE = [(1, 0, 0, 0, True, "press", "a"), (1, 1, 1, 0, True, "move", "a"), (1, 2, 2, 7, False, "press", "a"), (1, 3, 3, 0, True, "move", "a"), (1, 4, 4, 7, False, "move", "a"),
    (1, 5, 5, 7, False, "release", "a"), (1, 6, 6, 0, True, "move", "a"), (1, 7, 7, 0, True, "move", "b"), (1, 8, 8, 0, True, "release", "a"), (1, 9, 9, 0, True, "move", "a")]


@pytest.mark.parametrize("rows, want", [(STROKE, [0, 1, 6]), (pointer_rows(1), None), (pointer_rows(2), None), ([], [])])
def test_painting(spark, rows, want):
    got = sorted(r.seq for r in state.painting(pointers(spark, rows)).collect())
    assert got == (plain_painting(rows) if want is None else want)


def test_painting_stream(spark, tmp_path):
    """Events out of order within and between micro-batches."""
    own, folder, at = state.stateful(spark, 2), f"{tmp_path}/in", f"{tmp_path}/at"
    rows = pointer_rows(5, 150) + [(9, *r[1:]) for r in STROKE]
    schema = pointers(spark, rows).schema
    stream = lambda: state.painting_stream(own.readStream.schema(schema).parquet(folder), "10 minutes")
    random.Random(3).shuffle(rows)
    for some in (rows[:80], rows[80:], [(8, 5000, 10**6, 0, True, "move", "a")], [(8, 9000, 10**6 + 1, 0, True, "move", "a")]):
        add(pointers(spark, some), folder)
        run(stream(), at, "append", "parquet", path=f"{tmp_path}/out")
    got = sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(plain_painting(rows))


def test_quiet_edits_retrain(spark, tmp_path):
    """Labels in one stream's state, bursts of another start the training; the last counts are those of the batch."""
    own, folder = state.stateful(spark, 2), f"{tmp_path}/in"
    w, h = 8, 6
    pixels = spark.range(w * h).selectExpr("'a' as image_id", f"int(id % {w}) as x", f"int(id div {w}) as y", "id as i", "double((id * 37) % 11) as v")
    config = forest.ForestConfig(trees=3, depth=3)
    now = lambda: state.labels_in(spark, f"{tmp_path}/labels").select("image_id", "x", "y", "cls")
    retrain = state.QuietRetrain(pixels, w, h, now, f"{tmp_path}/counts", config)
    assert retrain.counts() is None
    schema = edits(spark, []).schema
    runs = []
    for k, rows in enumerate((some_edits(7, 30), some_edits(8, 20, 1000), [(5000, 9000, "a", 0, 0, 1)])):
        rows = [r for r in rows if r[2] == "a"]
        add(edits(spark, rows), folder)
        stream = lambda: own.readStream.schema(schema).parquet(folder)
        run(state.label_changes(stream(), "1 hour"), f"{tmp_path}/labels", "update")
        bursts = events.debounced(stream(), "30 seconds", ["image_id"], watermark="30 seconds")
        q = bursts.writeStream.foreachBatch(lambda df, n: (runs.append((k, n, df.count())), retrain.run(df, n))).option("checkpointLocation", f"{tmp_path}/bursts").trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
    assert sum(n > 0 for _, _, n in runs) == 2
    want = pipeline.retrain(pixels, now().withColumn("i", F.col("y").cast("long") * w + F.col("x")), w, h, config=config)
    last = sorted(map(tuple, retrain.counts().collect()))
    assert last == sorted(map(tuple, want.collect()))
    retrain.run(edits(spark, [(1, 1, "a", 0, 0, 1)]), 99)
    retrain.run(edits(spark, []), 100)
    assert sorted(map(tuple, retrain.counts().collect())) == last
