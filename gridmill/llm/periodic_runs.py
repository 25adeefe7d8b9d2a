"""Periodic runs of words, by Karp-Miller-Rosenberg naming.

A run is a stretch of at least ``MIN_LENGTH`` words and ``MIN_TURNS`` times its
smallest period that cannot be extended on either side.

1. All stretches of ``2^k`` words of a document get names, level by level: two have one name if
   and only if they are equal. A name of level ``k + 1`` is a pair of names of level ``k``, numbered by sorting
   pairs; what comes once has no name, and leaves the next levels with little to sort.
2. How far the words from two places on (or before them) are equal is found by walking down the levels.
3. For each period ``p`` a run matches itself ``p`` words on along its whole length but the last ``p`` words, so along
   ``max(MIN_LENGTH, MIN_TURNS * p) - p`` places at least. One place of every so many (the grid) lies in it: places of the grid that
   match are extended both ways. A document of ``n`` words has some ``n * (1 + ln(n) / 2)`` such places.
4. Of stretches found under several periods the least period holds; the others are its multiples.

Documents are independent: one pass without a shuffle. Neighbouring documents of about a megabyte are treated at once,
and candidates come in portions, so memory is about 60 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.llm import tokens
from gridmill.llm.frames import fresh
from gridmill.shipping import ship

MIN_LENGTH = 24
MIN_TURNS = 3
#: Candidates examined at once, about.
PORTION = 1 << 20
NONE = np.int32(-1)

_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of ``n`` places (and one after them) by their keys: ``NONE`` where a key comes once or a place has none."""
    out = np.full(n + 1, NONE)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
    again = np.append(ordered[1:] == ordered[:-1], False)[: len(ordered)] | ~new
    out[at[order[again]]] = (np.cumsum(new & again) - 1)[again]
    return out


def name_levels(symbols: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of ``2^k`` symbols that begin at each place; documents begin at ``first`` and share no name."""
    n = len(symbols)
    row = tokens.row_of(first)
    levels = [_named(row * (symbols.max(initial=0) + 1) + symbols, np.arange(n), n)]
    while True:
        name, width = levels[-1], 1 << (len(levels) - 1)
        at = np.flatnonzero(name[: max(n - width, 0)] >= 0)
        at = at[name[at + width] >= 0]
        if not len(at):
            return levels
        following = _named(name[at].astype(np.int64) * (int(name.max()) + 1) + name[at + width], at, n)
        if not (following >= 0).any():
            return levels
        levels.append(following)


def extent(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, backward: bool = False) -> np.ndarray:
    """How many symbols from ``a`` and from ``b`` on (or before them) are equal; each level is asked once, the longest first."""
    n = len(levels[0]) - 1
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        x, y = (a - length - width, b - length - width) if backward else (a + length, b + length)
        x, y = np.where(x < 0, n, np.minimum(x, n)), np.where(y < 0, n, np.minimum(y, n))
        name = levels[k]
        length[(name[x] == name[y]) & (name[x] >= 0)] += width
    return length


def _grid(first: np.ndarray, min_length: int, min_turns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the grid and their periods, in portions."""
    n = np.diff(first)
    longest = np.where(n >= min_length, n // min_turns, 0)
    row = np.repeat(np.arange(len(n)), longest)
    period = np.arange(len(row)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    step = np.maximum(min_length, min_turns * period) - period
    count = -(-(n[row] - period) // step)
    upto = np.cumsum(count)
    low = 0
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PORTION, "right")))
        some = slice(low, high)
        which = np.repeat(np.arange(low, high), count[some])
        turn = np.arange(len(which)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
        yield first[row[which]] + turn * step[which], period[which]
        low = high


def runs(symbols: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, min_turns: int = MIN_TURNS) -> tuple[np.ndarray, ...]:
    """Row, start within it, length and period of every run, by row, start and period; ``first`` has one more entry than rows."""
    levels = name_levels(symbols, first)
    found = []
    for at, period in _grid(first, min_length, min_turns):
        name = levels[0]
        same = (name[at] == name[at + period]) & (name[at] >= 0)
        at, period = at[same], period[same]
        before = extent(levels, at, at + period, backward=True)
        length = before + extent(levels, at, at + period) + period
        enough = length >= np.maximum(min_length, min_turns * period)
        found.append(np.stack([(at - before)[enough], length[enough], period[enough]]))
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    row = np.searchsorted(first, start, "right") - 1
    return row, start - first[row], length, period


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:n]) == 0


def _words(pieces: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each piece, their numbers (equal for equal words) one after the other, and where each piece's begin."""
    # Splitting bytes without a separator cuts at space and \t\n\v\f\r, and nothing else.
    words = [p.split() for p in pieces]
    first = np.cumsum([0, *map(len, words)])
    if not first[-1]:
        return words, np.zeros(0, np.int64), first
    lengths = np.fromiter((len(w) + 1 for own in words for w in own), np.int64, int(first[-1]))
    data = b" ".join(b" ".join(own) for own in words if own) + b" "
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    array = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
    return words, array.dictionary_encode().indices.to_numpy().astype(np.int64), first


def collapse(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_turns: int = MIN_TURNS) -> DataFrame:
    """All columns of ``docs``, then ``runs``, ``strongest`` and ``collapsed``.

    ``runs`` lists ``(start, length, period)`` by start, then period, in words from 0; ``strongest`` is the one of them with the
    greatest length for its period (of equals the first by start, then period), null without runs. ``collapsed`` has the words that
    stay, joined by spaces, when every run keeps its first period only. An empty text, or one without words, has no runs and
    collapses to an empty one; a null text stays null. Rows are independent, so repeated rows and null identifiers are like others.
    The three names get underscores in front where ``docs`` has columns called so.
    """
    if min_turns < 2 or min_length <= min_turns:
        raise ValueError("a run has at least two turns, and more words than turns")
    ship(docs.sparkSession)
    names = [fresh(n, docs.columns) for n in ("runs", "strongest", "collapsed")]
    docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    at, columns = docs.columns.index(text), [*docs.columns, *names]
    run_type = pa.struct([pa.field(f.name, pa.int64(), False) for f in _RUN.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for chunk in tokens.chunks(texts):
                words, symbols, first = _words(chunk.pieces())
                row, start, length, period = runs(symbols, first, min_length, min_turns)
                edges = np.searchsorted(row, np.arange(chunk.rows + 1))
                # Two different ratios of numbers below 2^26 differ as doubles, and equal ones do not.
                order = np.lexsort((period, start, -(length / np.maximum(period, 1)), row))
                collapsed, strongest = [], []
                for k, own in enumerate(words):
                    some = slice(edges[k], edges[k + 1])
                    if edges[k] < edges[k + 1]:
                        keep = kept_words(len(own), start[some], length[some], period[some])
                        own = [own[i] for i in np.flatnonzero(keep).tolist()]
                        best = order[edges[k]]
                        strongest.append({"start": start[best], "length": length[best], "period": period[best]})
                    else:
                        strongest.append(None)
                    collapsed.append(b" ".join(own).decode())
                listed = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(run_type))
                some = batch.slice(chunk.first_row, chunk.rows)
                made = pa.array(collapsed, pa.string(), mask=np.asarray(some.column(at).is_null())) if collapsed else pa.array([], pa.string())
                added = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), listed), pa.array(strongest, run_type), made]
                yield pa.RecordBatch.from_arrays([*some.columns, *added], names=columns)

    schema = T.StructType([*docs.schema.fields])
    for name, kind in zip(names, (T.ArrayType(_RUN, False), _RUN, T.StringType()), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def runs_text(runs: Column) -> Column:
    """A line ``start,length,period`` for each run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.array_join(lines, "")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, every tenth document (by a hash of its identifier) made periodic from some word on.

    With ``h`` the CRC-32 of the identifier, ``g = floor(h / 10)``, ``n`` words, ``a = g % n`` and ``p = 1 + floor((n - a) / (3 + g % 8))``, each
    word from ``a`` on becomes word ``a + (i - a) % p`` where ``h % 10 = 0``. A null identifier has no hash, and its text stays; a null text is empty.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.coalesce(F.crc32(doc_id.cast("string")), F.lit(1))
    words = F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.floor(h / 10).alias("g"), words.alias("w"))
    n, g = F.size("w"), F.col("g")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")
    return rows.select("doc_id", F.when(F.col("w").isNotNull() & (n > 0), planted).otherwise(F.col("text")).alias("text"))
