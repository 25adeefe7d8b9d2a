"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from gridmill.shipping import is_local, ship

#: Set when the session names no folder, as in local tests.
_OWN: list[str] = []
#: Tables made within open :func:`temporary_tables`, the innermost last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where that is unset and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="gridmill-"))
    return f"file://{_OWN[0]}"


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def complete_tables(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables below ``path`` whose writing was finished."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return []
    found = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()]
    return [name for name in found if fs.exists(_at(spark, f"{path}/{name}/_SUCCESS")[0])]


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def release(df: DataFrame) -> None:
    """Remove the table of :func:`materialize` that ``df`` reads; nothing may read it any more."""
    remove(df.sparkSession, df._gridmill_table)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that :func:`materialize` makes within are removed at its end, but for those taken out of the list it gives.

    For steps whose results have been written before it ends.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.pop()
        for path in made:
            remove(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that go when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/gridmill/{name}-{uuid.uuid4().hex}"
    where, fs = _at(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The written table survives the loss of executors, and every later use of it
    reads files instead of repeating the work. Shuffle files of the writing
    query are dropped when it ends. Tables go when they are released, or else when the driver's
    JVM ends, whether or not the session was stopped before.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/gridmill/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    where, fs = _at(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridmill_table = path
    if _OPEN:
        _OPEN[-1].append(path)
    return out
