"""Deterministic splits by ``crc32`` of the identifier's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crc_mod(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string")) % by


def in_fold(doc_id: Column, by: int, fold: int) -> Column:
    """True where the remainder is ``fold``; a null identifier is in no fold."""
    return F.coalesce(crc_mod(doc_id, by) == fold, F.lit(False))
