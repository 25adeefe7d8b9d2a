"""Exact substring deduplication with fixed-block anchors.

A window is ``WINDOW`` successive words. Words covered by a window that also
starts earlier (in a document with a smaller identifier, or earlier in the
same) are removed; windows are judged on the input.

Every window holds a whole block of ``BLOCK`` words at a multiple of ``BLOCK`` of
the document it first stands in. So: (1) all documents' blocks are indexed and
probed with every rolling run of ``BLOCK`` words; (2) hits, a block met in
another place, are extended to the windows around them, and of each window's
places all but the first are repeats; runs of repeats make up maximal repeats;
(3) their words go. Equal texts are settled by their first document alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import exchange, tokens
from gridmill.store import materialize

WINDOW = 20
BLOCK = 10
#: Windows have a second hash of 32 bits, made with this multiplier.
_CHECK = 0xD6E8FEB86659FD93

_MARKS = "id long, tie long, tie2 long, places binary"


def _by_row(rows: dict[str, np.ndarray], places: np.ndarray) -> pa.Table:
    """The keys of rows with places, and these places counted from the row's first, as packed 32-bit numbers."""
    ends = np.cumsum(rows["n_places"])
    starts = ends - rows["n_places"]
    places = np.sort(places)
    row = np.searchsorted(ends, places, "right")
    hit, first = np.unique(row, return_index=True)
    local = (places - starts[row]).astype(np.int32)
    parts = [x.tobytes() for x in np.split(local, first[1:])] if len(hit) else []
    columns = [pa.array(rows[k][hit], pa.int64()) for k in exchange.KEYS]
    return pa.Table.from_arrays([*columns, pa.array(parts, pa.binary())], names=["id", "tie", "tie2", "places"])


def _settle_places(rows: exchange.Rows, found: list[list[bytes]], followers: exchange.Followers) -> pa.Table:
    places = np.concatenate([np.zeros(0, np.int64), *(exchange.unpack_places(x[0]) for x in found)])
    return _by_row(rows, np.concatenate([places, followers.of(places)[0]]))


def _settle_repeats(rows: exchange.Rows, found: list[list[bytes]], followers: exchange.Followers) -> pa.Table:
    """Leaders by the answers; their followers are repeats too, but for those that start where their leader does."""
    places = np.concatenate([np.zeros(0, np.int64), *(exchange.unpack_places(x[0]) for x in found)])
    ends = np.cumsum(rows["n_places"])
    start = lambda at: (rows["id"][row := np.searchsorted(ends, at, "right")], at - (ends - rows["n_places"])[row])
    mine, theirs = start(followers.places), start(followers.leaders)
    other = followers.places[(mine[0] != theirs[0]) | (mine[1] != theirs[1])]
    return _by_row(rows, np.unique(np.concatenate([places, followers.of(places)[0], other])))


def block_hits(keyed: DataFrame, deal: exchange.Deal, block: int = BLOCK) -> DataFrame:
    """For each row with any: where its rolling runs of ``block`` words equal some document's block elsewhere."""

    def payload(_, items: exchange.Items, some: np.ndarray) -> list[bytes]:
        """Hashes with the leaders' places; which come again in this parcel, and which are some block."""
        leaders = items.leaders[some]
        bits = np.packbits(items.sizes[some] > 1).tobytes(), np.packbits(items.any_flag[some]).tobytes()
        return [items.hashes[leaders].astype(np.uint32).tobytes(), exchange.pack_places(items.places[leaders]), *bits]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel = exchange.Parcel(deal)
        for batch in batches:
            for chunk in tokens.chunks(batch.column("text")):
                starts, ends, first = chunk.words()
                runs, at = tokens.windows(chunk.running_hash().of(starts, ends), first, block)
                row = np.searchsorted(first, at, "right") - 1
                parcel.add(exchange.key_columns(batch, chunk), np.diff(first), at, runs, (at - first[row]) % block == 0)
                if parcel.full:
                    yield from parcel.records(payload)
        yield from parcel.records(payload)

    def answer(records: list[list[bytes]]) -> list[list[bytes] | None]:
        probes = [np.frombuffer(r[0], np.uint32) for r in records]
        bits = lambda k: [np.unpackbits(np.frombuffer(r[k], np.uint8), count=len(p)).astype(bool) for r, p in zip(records, probes, strict=True)]
        again, aligned = bits(2), bits(3)
        index = np.unique(np.concatenate([p[x] for p, x in zip(probes, aligned, strict=True)]))
        # Every block is a rolling run too: one that comes once meets only itself.
        ordered = np.sort(np.concatenate([*probes, *(p[x] for p, x in zip(probes, again, strict=True))]))
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        anchors = np.intersect1d(index, shared, assume_unique=True)
        out: list[list[bytes] | None] = []
        for r, p in zip(records, probes, strict=True):
            at = np.minimum(np.searchsorted(anchors, p), max(len(anchors) - 1, 0))
            hit = anchors[at] == p if len(anchors) else np.zeros(len(p), bool)
            out.append([exchange.pack_places(exchange.unpack_places(r[1])[hit])] if hit.any() else None)
        return out

    sent = keyed.select("text", "id", "tie", "tie2").mapInArrow(send, exchange.RECORD_SCHEMA)
    return exchange.settled(exchange.answered(sent, answer), exchange.KEYS, _settle_places, _MARKS)


def repeated_windows(keyed: DataFrame, hits: DataFrame, deal: exchange.Deal, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """For each row with any: where its windows start that also start earlier. Only windows around hits are looked at."""
    names = ["id", "tie", "tie2"]

    def alike(rows: exchange.Rows, places: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of one text are alike; the one that starts first leads."""
        ends = np.cumsum(rows["n_places"])
        row = np.searchsorted(ends, places, "right")
        order = np.lexsort((places - (ends - rows["n_places"])[row], rows["id"][row], checks, hashes))
        h, c = hashes[order], checks[order]
        starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))[: len(order)])
        return order, starts, order[starts]

    def payload(rows: exchange.Rows, items: exchange.Items, some: np.ndarray) -> list[bytes]:
        leaders = items.leaders[some]
        places, ends = items.places[leaders], np.cumsum(rows["n_places"])
        row = np.searchsorted(ends, places, "right")
        used, index = np.unique(row, return_inverse=True)
        local = (places - (ends - rows["n_places"])[row]).astype(np.uint32)
        kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
        return [
            items.hashes[leaders].tobytes(), exchange.pack_places(places), index.astype(kind).tobytes(), local.tobytes(),
            rows["id"][used].tobytes(), items.flags[leaders].tobytes(),
        ]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel = exchange.Parcel(deal)
        for batch in batches:
            packed = batch.column("places")
            for chunk in tokens.chunks(batch.column("text")):
                starts, ends, first = chunk.words()
                words = chunk.running_hash().of(starts, ends)
                runs, at = tokens.windows(words, first, window)
                near = np.zeros(len(starts) + 1, np.int64)
                for k in range(chunk.rows):
                    near[first[k] + np.frombuffer(packed[chunk.first_row + k].as_py(), np.int32) + 1] = 1
                near = np.cumsum(near)
                extended = near[at + window - block + 1] > near[at]
                checks = tokens.runs_at(words, at[extended], window, _CHECK).astype(np.uint32)
                parcel.add(exchange.key_columns(batch, chunk), np.diff(first), at[extended], runs[extended], checks)
                if parcel.full:
                    yield from parcel.records(payload, alike)
        yield from parcel.records(payload, alike)

    def answer(records: list[list[bytes]]) -> list[list[bytes] | None]:
        hashes = np.concatenate([np.frombuffer(r[0], np.uint64) for r in records])
        kind = lambda r: np.uint16 if len(r[4]) // 8 <= 1 << 16 else np.uint32
        ids = np.concatenate([np.frombuffer(r[4], np.int64)[np.frombuffer(r[2], kind(r))] for r in records])
        local = np.concatenate([np.frombuffer(r[3], np.uint32) for r in records])
        checks = np.concatenate([np.frombuffer(r[5], np.uint32) for r in records])
        order = np.lexsort((local, ids, checks, hashes))
        h, c, i, p = hashes[order], checks[order], ids[order], local[order]
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.zeros(len(h), bool)
        later[order] = (i != i[first]) | (p != p[first])
        out: list[list[bytes] | None] = []
        at = 0
        for r in records:
            mine = later[at : at + len(r[0]) // 8]
            at += len(mine)
            out.append([exchange.pack_places(exchange.unpack_places(r[1])[mine])] if mine.any() else None)
        return out

    sent = exchange.likely(keyed, hits).join(hits, names).select("text", *names, "places").mapInArrow(send, exchange.RECORD_SCHEMA)
    return exchange.settled(exchange.answered(sent, answer), exchange.KEYS, _settle_repeats, _MARKS)


def repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Where repeats start, by row key; ``everything`` marks later copies of a whole text."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    keyed = exchange.keyed(docs)
    deal = exchange.deal(docs)
    hits = materialize(block_hits(keyed, deal, block), "block-hits")
    # All copies of a text have the same hits: its first document stands for them. The join is by
    # the whole key, so a text that many documents share does not meet itself in one task.
    firsts = hits.groupBy("tie", "tie2").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    hits = hits.join(firsts, ["id", "tie", "tie2"], "left")
    later = hits.where(F.col("is_first").isNull()).select("id", "tie", "tie2", F.lit(b"").alias("places"), F.lit(True).alias("everything"))
    own = hits.where("is_first").drop("is_first").dropDuplicates(["id", "tie", "tie2"])
    marks = repeated_windows(keyed, own, deal, window, block)
    marks = marks.groupBy("id", "tie", "tie2").agg(F.first("places").alias("places")).withColumn("everything", F.lit(False))
    return materialize(marks.unionByName(later.dropDuplicates(["id", "tie", "tie2"])), "repeats")


def dedup(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_removed, and ``kept``, the words left, joined by one space.

    Null texts have no words. Rows that share an identifier count as one document: a window that starts at the
    same place of the same document is not earlier, so repeated rows are treated alike. Null identifiers come
    after all others and count as one document. Windows are told apart by hashes of 64 and 32 bits.
    """
    marked = exchange.keyed(docs).join(repeats(docs, window, block), ["id", "tie", "tie2"], "left").select("doc_id", "text", "places", "everything")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, places, everything in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                gone = 0
                if everything and len(words) >= window:
                    gone, left = len(words), []
                elif places:
                    hidden = tokens.covered(len(words), np.frombuffer(places, np.int32), window)
                    gone, left = int(hidden.sum()), list(compress(words, ~hidden))
                else:
                    left = words
                total.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
