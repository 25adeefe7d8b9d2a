"""Files written range by range: every task puts bytes at their offsets, so none holds a whole file.

``df.write.format("gridmill_ranges").mode("append").option("path", folder).save()``, also as a stream, takes rows ``(file, size, offset, data)``.
Ranges go to a file in a hidden folder of the job; when all tasks have ended, files whose ranges add up to their size are
renamed, all together. A failed job leaves nothing, as its folder goes and tasks that still run cannot make it again; a task that runs again writes the same bytes to the same places. ``folder``
is on a file system that driver and executors mount, as writing at an offset needs: object stores do not offer it.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from gridmill.shipping import ship

SCHEMA = "file string, size long, offset long, data binary"


def local_path(path: str) -> Path:
    """A path on a mounted file system; other schemes are an error."""
    bare = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in bare:
        raise ValueError(f"{path}: ranges are written to mounted file systems only")
    return Path(bare)


@dataclass
class Written(WriterCommitMessage):
    """The bytes a task has written of each file, and the files' sizes."""

    written: Counter = field(default_factory=Counter)
    sizes: dict[str, int] = field(default_factory=dict)


class _Ranges:
    """What batch and stream writers share."""

    def __init__(self, path: str, job: str) -> None:
        self._folder = local_path(path)
        self._hidden_folder = self._folder / f".{job}"

    def _hidden(self, name: str) -> Path:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"not the name of a file: {name!r}")
        return self._hidden_folder / name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, now, fd = Written(), None, -1
        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("file", "size", "offset", "data")]
                for name, size, offset, data in zip(*(c.to_pylist() for c in columns[:3]), columns[3], strict=True):
                    if name != now:
                        if fd >= 0:
                            os.close(fd)
                        fd, now = os.open(self._hidden(name), os.O_CREAT | os.O_WRONLY, 0o644), name
                    data = memoryview(data.as_buffer())
                    out.written[name] += len(data)
                    out.sizes[name] = size
                    while len(data):
                        n = os.pwrite(fd, data, offset)
                        data, offset = data[n:], offset + n
        finally:
            if fd >= 0:
                os.close(fd)
        return out

    def _commit(self, messages: list[WriterCommitMessage | None]) -> None:
        written, sizes = Counter(), {}
        for m in messages:
            if m is not None:
                written.update(m.written)
                sizes.update(m.sizes)
        wrong = sorted(name for name, size in sizes.items() if written[name] != size)
        if wrong:
            self._abort()
            raise ValueError(f"ranges do not fill {wrong[:3]}")
        for name in sizes:
            os.replace(self._hidden(name), self._folder / name)
        self._abort()

    def _abort(self) -> None:
        """Moved away first, so that no task finds the folder while it is emptied."""
        gone = self._folder / f".{uuid.uuid4().hex}"
        try:
            os.replace(self._hidden_folder, gone)
        except FileNotFoundError:
            return
        shutil.rmtree(gone)


class RangeWriter(_Ranges, DataSourceArrowWriter):
    """Made once for a job, on the driver; tasks and the committing side have copies."""

    def __init__(self, path: str, job: str) -> None:
        super().__init__(path, job)
        self._hidden_folder.mkdir(parents=True)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._commit(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._abort()


class RangeStreamWriter(_Ranges, DataSourceStreamArrowWriter):
    """A batch that is run again replaces its files by the same. A task makes the folder where it is not there, as each has a writer of its own."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        self._hidden_folder.mkdir(parents=True, exist_ok=True)
        return super().write(iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        self._commit(messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        self._abort()


class RangeSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridmill_ranges"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> RangeWriter:
        return RangeWriter(self.options["path"], uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> RangeStreamWriter:  # noqa: N802
        # Tasks and the committing side each make a writer of their own: they meet by a common name.
        return RangeStreamWriter(self.options["path"], "stream")


def save(ranges: DataFrame, folder: str) -> None:
    """Write the files of ``ranges`` (see the module) to ``folder``."""
    spark = ranges.sparkSession
    ship(spark)
    spark.dataSource.register(RangeSink)
    ranges.select("file", "size", "offset", "data").write.format("gridmill_ranges").mode("append").option("path", folder).save()
