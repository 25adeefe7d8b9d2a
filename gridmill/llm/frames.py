"""Helpers for adding columns to batches without touching what a table already has."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.shipping import ship


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column is called that (case does not count)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def with_batch_columns(
    df: DataFrame, text: str, added: list[T.StructField], compute: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """All columns of ``df``, then ``added``, which ``compute`` makes from each batch's texts.

    The added names must be free; see :func:`fresh`.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *added])
    names, at = [f.name for f in schema.fields], df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch.column(at))], names=names)

    return df.mapInArrow(run, schema)


def id_and_text(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that other columns, whatever their names, play no part."""
    ship(df.sparkSession)
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
