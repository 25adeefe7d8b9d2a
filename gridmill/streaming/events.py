"""Stream operators without keyed state of their own: quiet-time sessions, latest of a frame, a label table for ``foreachBatch``. Each works on batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.operators.labels import PIXEL, keep_latest
from gridmill.store import complete_tables, remove, shared_dir


def debounced(events: DataFrame, gap: str, by: list[str], ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """One row for each burst of events that are at most ``gap`` apart; on a stream, once the watermark closes it."""
    if events.isStreaming:
        events = events.withWatermark(ts, watermark or gap)
    grouped = events.groupBy(*by, F.session_window(ts, gap).alias("burst")).agg(F.count("*").alias("events"), F.max(ts).alias("last_ts"))
    return grouped.select(*by, F.col("burst.start").alias("first_ts"), "last_ts", "events")


def latest_of_frame(events: DataFrame, frame: str, by: list[str], value: str, ts: str = "ts", tie: str | None = None, watermark: str | None = None) -> DataFrame:
    """The last value within each fixed frame; of equal times that with the larger ``tie``."""
    if events.isStreaming:
        events = events.withWatermark(ts, watermark or frame)
    order = [F.col(ts).alias("at"), *([F.col(tie).alias("tie")] if tie else [])]
    last = F.max(F.struct(*order, F.col(value).alias("value")))
    return events.groupBy(*by, F.window(ts, frame).alias("frame")).agg(last.alias("last")).select(*by, F.col("frame.start").alias("frame_ts"), F.col("last.value").alias(value))


class LabelStore:
    """Labels as a table of a shared folder, replaced by each micro-batch of edits (a null class erases).

    Versions are numbered by opening of the store and by batch. A store that is opened again goes on from the newest version
    that was written to its end; a batch that is run again starts from the version before it, so its result is the same.
    The newest two versions are kept. ``folder`` is by default the session's shared folder.
    """

    def __init__(self, spark, name: str, folder: str | None = None) -> None:
        self._spark, self._path = spark, f"{folder or shared_dir(spark)}/labels-{name}"
        self._opening = max((v[0] for v in self._versions()), default=-1) + 1

    def _versions(self) -> list[tuple[int, int]]:
        return sorted(tuple(map(int, v.split("-"))) for v in complete_tables(self._spark, self._path))

    def _read(self, version: tuple[int, int] | None) -> DataFrame:
        if version is None:
            return self._spark.createDataFrame([], "image_id string, x int, y int, cls int")
        return self._spark.read.parquet(f"{self._path}/{version[0]}-{version[1]}")

    def labels(self) -> DataFrame:
        return self._read(max(self._versions(), default=None))

    def apply(self, edits: DataFrame, batch: int) -> None:
        now = (self._opening, batch)
        before = [v for v in self._versions() if v < now]
        latest = edits.withColumn("order", F.col("ts"))
        touched = edits.select(*PIXEL).distinct()
        kept = self._read(max(before, default=None)).join(touched, PIXEL, "left_anti")
        merged = kept.unionByName(keep_latest(latest, ["order", "event_id"]))
        merged.write.mode("overwrite").parquet(f"{self._path}/{now[0]}-{now[1]}")
        for a, b in before[:-1]:
            remove(self._spark, f"{self._path}/{a}-{b}")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``."""
        return self.apply
