"""Hashed items of many documents, dealt into buckets and answered, without a row for each item.

A sender gathers the items of some megabytes of text (a parcel), and deals them
by hash into buckets: one record for each parcel and bucket holds the items as
packed arrays. A bucket sees all items of its hashes, from all documents, and
answers with the places of some of them. The answers of a parcel meet its
directory, which knows which document each place belongs to. Of items that are
alike a parcel sends one, so records are evenly sized whatever the documents share:
a hash that all documents have costs its bucket one item from each parcel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import tokens
from gridmill.shipping import ship

#: Bytes of text whose items a bucket gets at least, about; their growth with the root of all bytes.
BUCKET_BYTES = 12 << 20
BUCKET_GROWTH = 25
#: Items in a parcel at least, about; their growth with the root of all bytes, and most (some 20 bytes of memory each).
PARCEL_ITEMS = 1_500_000
PARCEL_GROWTH = 2
MOST_PARCEL_ITEMS = 16_000_000
MOST_ROWS = 1_000_000
#: The size of a key filter: 2^24 bits are at most 2^18 rows of 16 bytes.
FILTER_BITS = 24
#: Stands for a null identifier, after all others.
NO_ID = (1 << 63) - 1
_SKIP = 0xFFFF

_RECORD = pa.schema([("bucket", pa.int32()), ("parcel", pa.string()), ("directory", pa.bool_()), ("data", pa.list_(pa.binary()))])
RECORD_SCHEMA = "bucket int, parcel string, directory boolean, data array<binary>"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), and the key of a row: its identifier without null, and two hashes of its text."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("tie"), F.xxhash64(F.length(text), text).alias("tie2"),
    )


def likely(rows: DataFrame, wanted: DataFrame, key: str = "tie") -> DataFrame:
    """The rows whose 64-bit key may be among ``wanted``'s: none of those is lost, few others stay.

    A bitmap of ``2^FILTER_BITS`` bits, whatever the number of keys, is broadcast; so rows that a join would
    only drop need not be shuffled. With far more keys than bits it lets all through, and costs no more.
    """
    bit = lambda c: F.pmod(c, F.lit(1 << FILTER_BITS))
    word, mask = F.shiftright(bit(F.col(key)), 6), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(key)).bitwiseAND(F.lit(63)).cast("int"))
    bitmap = wanted.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    kept = rows.withColumn("_word", word).join(F.broadcast(bitmap), "_word").where(F.col("_bits").bitwiseAND(mask) != 0)
    return kept.drop("_word", "_bits")


@dataclass(frozen=True)
class Deal:
    """How many buckets items are dealt into, and how many items are gathered before."""

    buckets: int
    parcel_items: int


def deal(docs: DataFrame) -> Deal:
    """Enough buckets for all text, and for all cores.

    Buckets and parcels get larger with the root of the text's bytes (a bucket has the items of 12 MB of text up to a quarter of a
    terabyte, 80 MB at ten, 250 MB at a hundred; a parcel 1.5 to 16 million): so a record never holds but a few items.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(total / max(BUCKET_BYTES, BUCKET_GROWTH * sqrt(total))))
    return Deal(buckets, max(PARCEL_ITEMS, min(MOST_PARCEL_ITEMS, int(PARCEL_GROWTH * sqrt(total)))))


def pack_places(places: np.ndarray) -> bytes:
    """Ascending places as 16-bit steps; longer steps are walked in parts."""
    steps = np.diff(places, prepend=-1)
    skips = (steps - 1) // (_SKIP - 1)
    out = np.full(len(steps) + int(skips.sum()), _SKIP, np.uint16)
    at = np.arange(len(steps)) + np.cumsum(skips)
    out[at] = steps - skips * (_SKIP - 1)
    return out.tobytes()


def unpack_places(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16)
    skip = steps == _SKIP
    return (np.cumsum(np.where(skip, _SKIP - 1, steps).astype(np.int64)) - 1)[~skip]


@dataclass(frozen=True)
class Items:
    """A parcel's items, alike ones side by side: group ``k`` is ``order[starts[k] : starts[k] + sizes[k]]``, one of which leads."""

    places: np.ndarray
    hashes: np.ndarray
    flags: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    leaders: np.ndarray

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.order)))

    @cached_property
    def any_flag(self) -> np.ndarray:
        return np.maximum.reduceat(self.flags[self.order], self.starts) if len(self.starts) else self.flags


Rows = dict[str, np.ndarray]
#: Which items are alike: their order by groups, where in it each group begins, and each group's leader.
Alike = Callable[[Rows, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def by_hash(rows: Rows, places: np.ndarray, hashes: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of one hash are alike; the one with the least place leads."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(order)])
    return order, starts, np.minimum.reduceat(order, starts) if len(starts) else order


@dataclass
class Parcel:
    """Rows with their keys and ``columns``, and items with the place each has among all places of the parcel."""

    deal: Deal
    rows: list[Rows] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    flags: list[np.ndarray] = field(default_factory=list)
    n_rows: int = 0
    n_places: int = 0
    n_items: int = 0
    sent: int = 0

    def add(self, rows: Rows, n_places: np.ndarray, at: np.ndarray, hashes: np.ndarray, flags: np.ndarray) -> None:
        """``n_places`` by row; ``at`` ascends over the places of these rows."""
        self.rows.append(rows | {"n_places": n_places})
        self.places.append(at + self.n_places)
        self.hashes.append(hashes)
        self.flags.append(flags)
        self.n_rows += len(n_places)
        self.n_places += int(n_places.sum())
        self.n_items += len(at)

    @property
    def full(self) -> bool:
        return self.n_items >= self.deal.parcel_items or self.n_rows >= MOST_ROWS

    def records(self, payload: Callable[[Rows, Items, np.ndarray], list[bytes]], alike: Alike = by_hash) -> Iterator[pa.RecordBatch]:
        """One record a bucket, then the directory; leaves the parcel empty.

        Of items that are alike only the leader goes to a bucket: a hash that all documents have costs its bucket one
        item from each parcel. The directory keeps whom each other item follows. ``payload`` makes a record of some groups.
        """
        if not self.n_rows:
            return
        rows = {k: np.concatenate([r[k] for r in self.rows]) for k in self.rows[0]}
        places, hashes, flags = (np.concatenate(x) for x in (self.places, self.hashes, self.flags))
        context = TaskContext.get()
        name = hashlib.blake2b(b"".join(rows[k].tobytes() for k in sorted(rows)), digest_size=8).hexdigest()
        name = f"{context.partitionId() if context else 0}-{self.sent}-{name}"
        order, starts, leaders = alike(rows, places, hashes, flags)
        items = Items(places, hashes, flags, order, starts, leaders)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(starts)), items.sizes)
        # Places ascend, so leaders and followers taken as they come are ordered by place.
        leads = np.zeros(len(order), bool)
        leads[leaders] = True
        followed = [pack_places(places[~leads]), places[leaders[group[~leads]]].astype(np.uint32).tobytes()]
        ranked = group[leads]
        bucket = ((hashes[leaders[ranked]] >> np.uint64(32)) % np.uint64(self.deal.buckets)).astype(np.uint16 if self.deal.buckets <= 1 << 16 else np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        ranked, bucket = ranked[by_bucket], bucket[by_bucket]
        edges = np.searchsorted(bucket, np.arange(self.deal.buckets + 1))
        numbers = np.flatnonzero(np.diff(edges)).tolist()
        data = [payload(rows, items, ranked[edges[b] : edges[b + 1]]) for b in numbers]
        numbers.append(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "big") % self.deal.buckets)
        data.append([rows[k].tobytes() for k in sorted(rows)] + followed)
        self.rows, self.places, self.hashes, self.flags = [], [], [], []
        self.n_rows = self.n_places = self.n_items = 0
        self.sent += 1
        n = len(numbers)
        for a in range(0, n, 64):
            b = min(a + 64, n)
            columns = [pa.array(numbers[a:b], pa.int32()), pa.array([name] * (b - a)), pa.array([k == n - 1 for k in range(a, b)]), pa.array(data[a:b], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, schema=_RECORD)


def answered(records: DataFrame, answer: Callable[[list[list[bytes]]], list[list[bytes] | None]]) -> DataFrame:
    """Each bucket's answer to each of its records (None: nothing to say), with the directories as they are."""

    def run(table: pa.Table) -> pa.Table:
        directory = np.array(table["directory"].to_pylist(), bool)
        asked = table.filter(pa.array(~directory)).combine_chunks()
        answers = answer(asked["data"].to_pylist()) if asked.num_rows else []
        keep = [k for k, a in enumerate(answers) if a is not None]
        out = asked.select(["parcel", "directory"]).take(pa.array(keep, pa.int64()))
        out = out.append_column("data", pa.array([answers[k] for k in keep], pa.list_(pa.binary())))
        kept = table.filter(pa.array(directory)).select(["parcel", "directory", "data"])
        return pa.concat_tables([out.cast(kept.schema), kept])

    return records.groupBy("bucket").applyInArrow(run, "parcel string, directory boolean, data array<binary>")


@dataclass(frozen=True)
class Followers:
    """Items that were not sent, by ascending place, each with the place of the item that was sent for it."""

    places: np.ndarray
    leaders: np.ndarray

    def of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The followers of leaders among the places ``found``, and which of these each follows."""
        if not len(found) or not len(self.places):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(found)
        at = np.minimum(np.searchsorted(found[order], self.leaders), len(found) - 1)
        hit = found[order][at] == self.leaders
        return self.places[hit], order[at[hit]]


def settled(answers: DataFrame, names: dict[str, type], settle: Callable[[Rows, list[list[bytes]], Followers], pa.Table], schema: str) -> DataFrame:
    """A parcel's answers with its directory's columns; ``names`` gives their kinds."""
    ordered = sorted({**names, "n_places": np.int64})
    kinds = {**names, "n_places": np.int64}

    def run(table: pa.Table) -> pa.Table:
        rows: Rows = {}
        found, followers = [], Followers(np.zeros(0, np.int64), np.zeros(0, np.int64))
        for is_directory, data in zip(table["directory"].to_pylist(), table["data"].to_pylist(), strict=True):
            if is_directory:
                rows = {k: np.frombuffer(x, kinds[k]) for k, x in zip(ordered, data, strict=False)}
                followers = Followers(unpack_places(data[-2]), np.frombuffer(data[-1], np.uint32).astype(np.int64))
            else:
                found.append(data)
        return settle(rows, found, followers)

    return answers.groupBy("parcel").applyInArrow(run, schema)


def key_columns(batch: pa.RecordBatch, chunk: tokens.Chunk) -> dict[str, np.ndarray]:
    some = slice(chunk.first_row, chunk.first_row + chunk.rows)
    return {k: batch.column(k).to_numpy()[some] for k in ("id", "tie", "tie2")}


KEYS = {"id": np.int64, "tie": np.int64, "tie2": np.int64}
