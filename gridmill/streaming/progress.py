"""How far a write is: counts observed where rows pass, told batch by batch."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "gridmill_export"


def observed(ranges: DataFrame) -> DataFrame:
    """``ranges (file, size, offset, data)`` with counts of files (their first ranges), ranges and bytes taken as they pass."""
    first = F.coalesce(F.sum((F.col("offset") == 0).cast("long")), F.lit(0))
    return ranges.observe(NAME, first.alias("files"), F.count("*").alias("ranges"), F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("bytes"))


class ExportProgress(StreamingQueryListener):
    """Totals of :func:`observed` streams; add it with ``spark.streams.addListener``, and read :meth:`totals` while the stream runs."""

    def __init__(self) -> None:
        self._lock, self._history = Lock(), [{"files": 0, "ranges": 0, "bytes": 0}]
        self.ended = False

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(NAME)
        if row is not None:
            with self._lock:
                self._history.append({k: n + row[k] for k, n in self._history[-1].items()})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended = True

    def totals(self) -> dict[str, int]:
        return self.history()[-1]

    def history(self) -> list[dict[str, int]]:
        with self._lock:
            return list(self._history)
