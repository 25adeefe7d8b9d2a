"""Exact top-k search by inner product: columnar branch-and-bound.

Components are scaled and floored to integers. Vectors are packed into blocks that hold one
dimension after the other; a block comes from one task of the scan, so packing shuffles nothing,
and equal or frequent vectors are spread as they lie. Queries are marked rows of the same blocks, gathered in bands; candidates'
blocks are gathered in spans; a task compares one band with one span. The marked rows are thus compared with all
rows in blocks of bounded size, whatever the values.

Within a task, dimensions come in the order of their mass, a few at a time: partial products of some queries
with a block are extended from one group of dimensions to the next. By Cauchy and Schwarz what is still to come
lies within the product of the remaining lengths of query and candidate. Candidates whose partial product and
that bound do not reach the query's k-th best so far drop out: columns that no query wants any more are compacted away, and when few
pairs are left, these alone are carried on. The k best of each span meet in a window over the query's row.

Products of integers are exact: single precision where lengths prove that sums stay below 2^24, double below 2^53, else Python's integers,
which are compared without bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.shipping import ship
from gridmill.store import materialize

SCALE = 64
K = 20
#: Components in a block, about; blocks in a span and queries in a band, about.
BLOCK_COMPONENTS = 1 << 19
SPAN_BLOCKS = 32
BAND_QUERIES = 4_096
#: Queries compared at once, dimensions taken at once, and the share of pairs below which they are carried on one by one.
BATCH = 128
STEP = 16
SPARSE = 0.02
NO_ID = (1 << 63) - 1
_TOP = (1 << 63) - 1

_BLOCK_SCHEMA = "block long, n int, dims int, queries int, kind string, ids binary, wanted binary, data binary"


def blocks(vectors: DataFrame, wanted: Column, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE) -> DataFrame:
    """Blocks of vectors, dimension by dimension, as integers of the smallest kind that holds them; ``wanted`` marks queries.

    Vectors that are null or have a null or non-finite component (or one that is non-finite when scaled) are left out.
    """
    ship(vectors.sparkSession)
    whole = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(whole, lambda x: F.coalesce(F.abs(x * scale) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.select(F.coalesce(F.col(f"`{vec_id}`").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(wanted, F.lit(False)).alias("wanted"), whole.alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))

    def packed(number: int, ids: np.ndarray, flags: np.ndarray, values: np.ndarray) -> list:
        most = np.abs(values).max(initial=0)
        kind = next((k for k, top in (("<i1", 127), ("<i2", 32767), ("<i4", 2147483647)) if most <= top), "<f8")
        return [number, len(ids), values.shape[0], int(flags.sum()), kind, ids.astype("<i8").tobytes(), np.packbits(flags).tobytes(), values.astype(kind).tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, sent = TaskContext.get(), 0
        part = context.partitionId() if context else 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, sent
            ids, flags, lengths, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            dims = int(lengths.max(initial=0))
            values = np.zeros((dims, len(ids)))
            row = np.repeat(np.arange(len(ids)), lengths)
            values[np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = np.floor(flat * scale)
            out = packed((part << 32) + sent, ids, flags, values)
            held, size, sent = [], 0, sent + 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in _BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            low = 0
            while low < batch.num_rows:
                lists = batch.column(2).slice(low)
                lengths = np.diff(np.asarray(lists.offsets)).astype(np.int64)
                high = max(1, int(np.searchsorted(np.cumsum(lengths + 1), BLOCK_COMPONENTS - size, "right")))
                some = slice(0, high)
                flat = np.asarray(lists.slice(0, high).flatten())
                held.append((np.asarray(batch.column(0).slice(low, high)), np.asarray(batch.column(1).slice(low, high).to_numpy(zero_copy_only=False), bool), lengths[some], flat))
                low += high
                size += int(lengths[some].sum()) + min(high, len(lengths))
                if size >= BLOCK_COMPONENTS or low < batch.num_rows:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, _BLOCK_SCHEMA)


def _queries(packed: DataFrame) -> DataFrame:
    """The marked vectors of each block, with their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.flatnonzero(np.unpackbits(np.frombuffer(r["wanted"], np.uint8), count=r["n"]))
                values = np.frombuffer(r["data"], r["kind"]).reshape(r["dims"], r["n"])[:, at]
                out = {"block": r["block"], "n": len(at), "dims": r["dims"], "kind": r["kind"], "ids": np.frombuffer(r["ids"], "<i8")[at].tobytes(), "places": at.astype("<i4").tobytes(), "data": values.tobytes()}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("places", pa.binary()), ("data", pa.binary())])
    return packed.where("queries > 0").mapInArrow(run, "block long, n int, dims int, kind string, ids binary, places binary, data binary")


def _read(record: dict, dims: int) -> np.ndarray:
    own = np.frombuffer(record["data"], record["kind"]).reshape(record["dims"], record["n"])
    return own if record["dims"] == dims else np.concatenate([own, np.zeros((dims - record["dims"], record["n"]), own.dtype)])


def _exact_kind(longest: float) -> np.dtype:
    return np.dtype(np.float32 if longest < 1 << 24 else np.float64 if longest < 1 << 53 else object)


@dataclass
class Side:
    """Vectors dimension by dimension in the order of mass, and their lengths over all dimensions from each cut on."""

    values: np.ndarray
    rest: list[np.ndarray]

    @classmethod
    def of(cls, values: np.ndarray, order: np.ndarray, cuts: list[int], kind: np.dtype) -> Side:
        values = values[order]
        if kind == object:
            return cls(np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape), [])
        squares = values.astype(np.float64) ** 2
        rest = [np.sqrt(squares[c:].sum(axis=0)).astype(kind) for c in cuts]
        return cls(np.ascontiguousarray(values, kind), rest)


@dataclass
class Best:
    """The best of some queries so far, flat: query, score, identifier; and what a further score must reach."""

    n: int
    k: int
    kind: np.dtype
    #: By how much rounding may move a bound.
    slack: float

    def __post_init__(self) -> None:
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, np.int64)
        self.floor = np.full(self.n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if self.kind == object:
            score = np.array([max(-_TOP - 1, min(_TOP, x)) for x in score], object)
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        if self.kind == object:  # sorted by rank, as numpy does not sort such keys together
            by_score = np.argsort(-score, kind="stable")
            rank = np.empty(len(score), np.int64)
            rank[by_score] = np.cumsum(np.append(True, score[by_score][1:] != score[by_score][:-1])[: len(score)])
            order = np.lexsort((ids, rank, query))
        else:
            order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        if self.kind != object:
            self.floor[query[place == self.k - 1]] = score[last]
        self.query, self.score, self.id = query[place < self.k], score[keep], ids[keep]


def _scan(queries: Side, block: Side, ids: np.ndarray, own: tuple[np.ndarray, np.ndarray], cuts: list[int], best: Best) -> None:
    """Take the candidates of a block into the best of some queries; ``own`` are pairs of a query and itself."""
    n = block.values.shape[1]
    q, x, columns = queries.values, block.values, np.arange(n)
    partial = np.zeros((best.n, n), best.kind)
    allowed = np.ones((best.n, n), bool)
    allowed[own] = False
    if best.kind == object:  # numbers beyond any bound in doubles
        qi, ci = np.nonzero(allowed)
        best.add(qi, (q.T @ x)[qi, ci], ids[ci])
        return
    pairs, first = None, not np.isfinite(best.floor).all()
    for c, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if pairs is None:
            partial = q[low:high].T @ x[low:high] if c == 0 else partial + q[low:high].T @ x[low:high]
            if first and len(columns) > best.k:
                _raise_floor(queries, block, columns, allowed, partial, high, best)
            near = np.outer(queries.rest[c + 1], block.rest[c + 1][columns])
            near += partial
            alive = near >= (best.floor - best.slack).astype(best.kind)[:, None]
            alive &= allowed
            if np.count_nonzero(alive) < SPARSE * best.n * n:
                qi, ci = np.nonzero(alive)
                pairs = qi, columns[ci], partial[qi, ci]
                continue
            allowed = alive
            wanted = alive.any(axis=0)
            if np.count_nonzero(wanted) < 0.75 * len(wanted):
                columns, partial, allowed, x = columns[wanted], partial[:, wanted], allowed[:, wanted], x[:, wanted]
        else:
            qi, ci, part = pairs
            part = part + (q[low:high, qi] * block.values[low:high, ci]).sum(axis=0)
            near = part + queries.rest[c + 1][qi] * block.rest[c + 1][ci]
            alive = near >= (best.floor - best.slack)[qi]
            pairs = qi[alive], ci[alive], part[alive]
    if pairs is None:
        qi, ci = np.nonzero(allowed)
        pairs = qi, columns[ci], partial[qi, ci]
    qi, ci, part = pairs
    reach = part >= best.floor[qi]
    best.add(qi[reach], part[reach], ids[ci[reach]])


def _raise_floor(queries: Side, block: Side, columns: np.ndarray, allowed: np.ndarray, partial: np.ndarray, done: int, best: Best) -> None:
    """The k-th best of those candidates that lead after the first ``done`` dimensions bounds a query's k-th best from below."""
    lead = np.where(allowed, partial, -np.inf).astype(np.float64)
    at = np.argpartition(-lead, best.k - 1, axis=1)[:, : best.k]
    for r in np.flatnonzero(np.take_along_axis(allowed, at, axis=1).all(axis=1)):
        score = partial[r, at[r]] + queries.values[done:, r] @ block.values[done:, columns[at[r]]]
        best.floor[r] = max(best.floor[r], score.min())


def _compared(parts: DataFrame, k: int) -> DataFrame:
    """The k best of each span for each query of each band."""

    def run(table: pa.Table) -> pa.Table:
        records = table.to_pylist()
        asked = [r for r in records if r["places"] is not None]
        there = [r for r in records if r["places"] is None]
        found: list[list[np.ndarray]] = []
        dims = max(1, *(r["dims"] for r in records))
        if asked and there:
            raw_q = np.concatenate([_read(r, dims).astype(np.float64) for r in asked], axis=1)
            raw_x = [_read(r, dims) for r in there]
            np.seterr(over="ignore")
            norm = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(axis=0)).max(initial=0)
            longest = norm(raw_q) * max(map(norm, raw_x)) * (1 + 1e-9) + 1
            kind = _exact_kind(longest)
            slack = 1 + longest * (1e-6 if kind == np.float32 else 1e-14)
            mass = (raw_q**2).sum(axis=1) * sum((v.astype(np.float64) ** 2).sum(axis=1) for v in raw_x)
            order = np.argsort(-mass, kind="stable")
            cuts = [*range(0, dims, STEP), dims]
            sides = [Side.of(v, order, cuts, kind) for v in raw_x]
            ids = [np.frombuffer(r["ids"], "<i8") for r in there]
            q_block = np.repeat([r["block"] for r in asked], [r["n"] for r in asked])
            q_place = np.concatenate([np.frombuffer(r["places"], "<i4") for r in asked])
            q_id = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in asked])
            for low in range(0, len(q_id), BATCH):
                some = slice(low, low + BATCH)
                queries = Side.of(raw_q[:, some], order, cuts, kind)
                best = Best(len(q_id[some]), k, kind, slack)
                for r, side, own_ids in zip(there, sides, ids, strict=True):
                    mine = np.flatnonzero(q_block[some] == r["block"])
                    _scan(queries, side, own_ids, (mine, q_place[some][mine]), cuts, best)
                score = best.score.astype(np.int64)
                found.append([q_block[some][best.query], q_place[some][best.query], q_id[some][best.query], best.id, score])
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("q_block", "q_place", "query_id", "vec_id", "score"), columns, strict=True)})

    return parts.groupBy("band", "span").applyInArrow(run, "q_block long, q_place long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, wanted: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of every row where ``wanted`` holds, the k rows with the greatest inner products, but itself.

    Ties go to the smaller identifier; null identifiers come last and stay null. Rows that share an identifier are
    different rows: each is a candidate of the others, and each that is wanted has its own k results. Fewer than k candidates are all
    returned. A vector shorter than another counts as filled up with zeros; an empty one scores 0 with all. Null, NaN and
    infinite components keep a vector out on both sides. A score beyond 64 bits counts as the nearest number of 64 bits.
    """
    packed = materialize(blocks(vectors, wanted, vec_id, embedding, scale), "vector-blocks")
    n_blocks, n_queries = packed.agg(F.count("*"), F.coalesce(F.sum("queries"), F.lit(0))).first()
    bands = max(1, ceil(n_queries / BAND_QUERIES))
    cores = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = max(1, ceil(n_blocks / SPAN_BLOCKS), min(n_blocks, ceil(cores / bands)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    columns = ["block", "n", "dims", "kind", "ids", "data"]
    there = packed.select(*columns, F.lit(None).cast("binary").alias("places"), dealt(spans).alias("span"), every(bands).alias("band"))
    asked = _queries(packed).select(*columns, "places", every(spans).alias("span"), dealt(bands).alias("band"))
    found = _compared(there.unionByName(asked), k)
    by = Window.partitionBy("q_block", "q_place").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return best.select(back("query_id"), F.col("rank").cast("int").alias("rank"), back("vec_id"), "score")
