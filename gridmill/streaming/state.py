"""Keyed state on streams: labels by pixel, and pointers by device.

State lives in the query's checkpoint, so a stopped query goes on where it was. A micro-batch touches the state of its own keys
only, so its work grows with its rows and not with all labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gridmill.operators import forest, planes
from gridmill.operators.labels import PIXEL
from gridmill.plans import pipeline
from gridmill.shipping import ship
from gridmill.store import complete_tables

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB, in so many partitions (a checkpoint fixes their number)."""
    ship(spark)
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    return own


# --- labels ---------------------------------------------------------------------------------------


class _Labels(StatefulProcessor):
    """The last edit of a pixel by time and event; an erasure is kept as a null class until none that is older can come."""

    def __init__(self, keep_ms: int) -> None:
        self._keep = keep_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._last = handle.getValueState("label", "painted int, at long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self._last.get() if self._last.exists() else None
        before = last
        for frame in rows:
            for cls, at, event in zip(frame["cls"].tolist(), frame["at"].tolist(), frame["event_id"].tolist(), strict=True):
                if last is None or (at, event) > (last[1], last[2]):
                    last = (None if pd.isna(cls) else int(cls), at, event)
        if last != before:
            self._last.update(last)
            if last[0] is None:
                self._handle.registerTimer(last[1] // 1000 + self._keep + 1)
            yield self._row(key, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self._last.get() if self._last.exists() else None
        if last is not None and last[0] is None and last[1] // 1000 + self._keep + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self._last.clear()
        return iter(())

    def _row(self, key, last) -> pd.DataFrame:
        return pd.DataFrame({"image_id": [key[0]], "x": [key[1]], "y": [key[2]], "cls": pd.array([last[0]], "Int32"), "ts": [pd.Timestamp(last[1], unit="us")]})

    def close(self) -> None:
        pass


def label_changes(edits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """What each micro-batch of ``edits (image_id, x, y, cls, ts, event_id)`` changes: the new label, or a null class where one was erased.

    ``edits`` is a stream of a :func:`stateful` session. The last edit of a pixel by ``ts``, then ``event_id``, holds, in whatever order they arrive, as long as
    they are at most ``late`` behind; what is later is dropped. An erasure is forgotten when nothing that is older can arrive any more. Rows with a null
    pixel or time play no part. The output mode is ``update``; :func:`labels_in` reads the labels from the query's checkpoint.
    """
    rows = edits.dropna(subset=[*PIXEL, "ts"]).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select(F.col("image_id").cast("string").alias("image_id"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"),
        F.col("cls").cast("int").alias("cls"), F.unix_micros("ts").alias("at"), F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"), "ts")
    keep = int(pd.Timedelta(late).total_seconds() * 1000)
    schema = "image_id string, x int, y int, cls int, ts timestamp"
    return rows.groupBy(*PIXEL).transformWithStateInPandas(_Labels(keep), schema, "Update", "EventTime")


def labels_in(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(image_id, x, y, cls, at, event_id)``: the labels as the last finished micro-batch of a :func:`label_changes` query left them; ``at`` in microseconds."""
    found = spark.read.format("statestore").option("stateVarName", "label").load(checkpoint)
    return found.select("key.*", F.col("value.painted").alias("cls"), F.col("value.at").alias("at"), F.col("value.event_id").alias("event_id")).where("cls is not null")


# --- pointers -------------------------------------------------------------------------------------

_POINTER = ["device", "ts", "seq", "pointer", "is_primary", "kind", "image_id"]


def painting(pointers: DataFrame) -> DataFrame:
    """Of pointer events ``(device, ts, seq, pointer, is_primary, kind, image_id)`` those that paint.

    ``kind`` is ``press``, ``move`` or ``release``. The primary pointer paints where it is pressed, and on the image it was pressed on along its moves until it is
    released there; moves pause while more than one pointer of the device is down and go on after. Events are ordered by ``ts``, then ``seq``. On a
    batch this is running counts in windows over each device; on a stream see :func:`painting_stream`.
    """
    order = lambda *by: Window.partitionBy(*by).orderBy("ts", "seq")
    now = order("device").rowsBetween(Window.unboundedPreceding, 0)
    press, release = F.col("kind") == "press", F.col("kind") == "release"
    status = F.when(press, 1).when(release, 0)
    before = F.coalesce(F.last(status, ignorenulls=True).over(order("device", "pointer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pointers.withColumn("_step", F.coalesce(status, before) - before)
    rows = rows.withColumns({"_down": F.sum("_step").over(now), "_image": F.last(F.when(F.col("is_primary") & press, F.struct("image_id")), ignorenulls=True).over(now)["image_id"]})
    here = F.col("image_id").eqNullSafe(F.col("_image"))
    drawing = F.last(F.when(F.col("is_primary") & press, True).when(F.col("is_primary") & release & here, False), ignorenulls=True).over(now)
    rows = rows.withColumn("_drawing", F.coalesce(drawing, F.lit(False)))
    moves = (F.col("kind") == "move") & F.col("_drawing") & here & (F.col("_down") <= 1)
    return rows.where(F.col("is_primary") & (press | moves)).drop("_step", "_down", "_image", "_drawing")


class _Gate(StatefulProcessor):
    """A device's waiting events, the pointers that are down, and the image of the stroke that is being drawn."""

    def init(self, handle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "at long, seq long, pointer long, is_primary boolean, kind string, image_id string")
        self._down = handle.getMapState("down", "pointer long", "since long")
        self._stroke = handle.getValueState("stroke", "image_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for frame in rows for r in frame[["at", "seq", "pointer", "is_primary", "kind", "image_id"]].itertuples(index=False, name=None)]
        for r in new:
            self._waiting.appendValue(tuple(None if pd.isna(x) else x for x in r))
        self._handle.registerTimer(min(r[0] for r in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All that the watermark has passed, in order of time; nothing earlier can arrive any more."""
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(r) for r in self._waiting.get()), key=lambda r: r[:2])
        ready = [r for r in waiting if r[0] // 1000 <= passed]
        later = waiting[len(ready) :]
        out = []
        for at, seq, pointer, primary, kind, image in ready:
            if kind == "press":
                self._down.updateValue((pointer,), (at,))
                if primary:
                    self._stroke.update((image,))
            elif kind == "release" and self._down.containsKey((pointer,)):
                self._down.removeKey((pointer,))
            here = self._stroke.exists() and self._stroke.get()[0] == image
            if primary and kind == "release" and here:
                self._stroke.clear()
            if primary and (kind == "press" or kind == "move" and here and sum(1 for _ in self._down.keys()) <= 1):
                out.append((key[0], pd.Timestamp(at, unit="us"), seq, pointer, True, kind, image))
        if ready:
            self._waiting.put(later) if later else self._waiting.clear()
        if later:
            self._handle.registerTimer(later[0][0] // 1000)
        if out:
            yield pd.DataFrame(out, columns=_POINTER)

    def close(self) -> None:
        pass


def painting_stream(pointers: DataFrame, late: str = "1 second") -> DataFrame:
    """:func:`painting` on a stream of a :func:`stateful` session, in append mode: an event is judged once the watermark, ``late`` behind, has passed it.

    Events wait in the device's state, so their order of arrival does not matter; those more than ``late`` behind are dropped.
    """
    rows = pointers.dropna(subset=["device", "ts", "seq", "pointer"]).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("device", "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("pointer").cast("long").alias("pointer"), "is_primary", "kind", "image_id")
    schema = f"device {pointers.schema['device'].dataType.simpleString()}, ts timestamp, seq long, pointer long, is_primary boolean, kind string, image_id string"
    return rows.groupBy("device").transformWithStateInPandas(_Gate(), schema, "Append", "EventTime")


# --- retraining -----------------------------------------------------------------------------------


class QuietRetrain:
    """Retrains when edits have been quiet: for ``foreachBatch`` of a stream of :func:`gridmill.streaming.events.debounced` bursts.

    A micro-batch with a closed burst trains once on all labels there are, and writes the counts under its number; without one it does nothing.
    Micro-batches run one after the other, so runs never overlap; one that is run again replaces its own counts.
    """

    def __init__(self, pixels: DataFrame, width: int, height: int, labels: Callable[[], DataFrame], folder: str, config: forest.ForestConfig = forest.ForestConfig()) -> None:
        self._pixels, self._size, self._labels, self._folder, self._config = pixels, (width, height), labels, folder, config

    def run(self, bursts: DataFrame, batch: int) -> None:
        if bursts.isEmpty():
            return
        width, _ = self._size
        labels = self._labels().withColumn("i", F.col("y").cast("long") * width + F.col("x"))
        counts = pipeline.retrain(self._pixels, labels, *self._size, config=self._config)
        counts.write.mode("overwrite").parquet(f"{self._folder}/{batch}")

    def counts(self) -> DataFrame | None:
        """``(cls, objects)`` of the last finished run."""
        spark = self._pixels.sparkSession
        done = sorted(map(int, complete_tables(spark, self._folder)))
        return spark.read.parquet(f"{self._folder}/{done[-1]}") if done else None


# --- intake ---------------------------------------------------------------------------------------


class _FirstOnly(StatefulProcessor):
    """Remembers that a file has been seen; of a micro-batch's rows of a new one the first by ``ord`` passes."""

    def init(self, handle) -> None:
        self._seen = handle.getValueState("seen", "first long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self._seen.update((-1,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self._seen.exists():
            return
        first = min((frame.sort_values("ord", kind="stable").head(1) for frame in rows), key=lambda f: f["ord"].iloc[0])
        self._seen.update((int(first["ord"].iloc[0]),))
        yield first

    def close(self) -> None:
        pass


def intake_stream(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """:func:`gridmill.operators.planes.intake` on a stream of a :func:`stateful` session: image files that were not seen before.

    A file is known by name and size, in this micro-batch, in earlier ones (after a restart too), or among ``known (name, file_size)`` when the stream first
    starts. The first that arrives wins, within a micro-batch that with the least ``ord``. The mode is append.
    """
    key = ["name", "file_size"]
    rows = planes.accepted(files)
    initial = known.select(*key).distinct().groupBy(*key) if known is not None else None
    return rows.groupBy(*key).transformWithStateInPandas(_FirstOnly(), rows.schema, "Append", "None", initial)
