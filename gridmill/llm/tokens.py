"""Words and hashes of many texts at once, straight from Arrow's byte buffers.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``, the
pattern ``[^\\x20\\x09-\\x0D]+``. A polynomial hash over 64 bits is kept as a
running sum, so the hash of any byte range costs two lookups; a final mix
spreads it. Memory is about 60 bytes a byte of the texts in one chunk: a chunk
holds about a megabyte, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all positions (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data | 0x20, data)


@dataclass
class Chunk:
    """Some neighbouring rows: their bytes, and where each row's begin (one more entry than rows)."""

    first_row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def running_hash(self) -> RunningHash:
        return RunningHash(self.data)

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and first index by row of the maximal runs where ``inside`` holds, cut at row ends."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.offsets), np.int64)
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        edges = self.offsets[1:-1]
        before[edges[edges < len(inside)]] = False
        after[edges[edges > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~SEPARATOR[self.data])

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row have their flag set."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def pieces(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)]


class RunningHash:
    def __init__(self, data: np.ndarray) -> None:
        powers, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Walk a column of strings; null counts as the empty text. Every row is in exactly one chunk."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield Chunk(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the first index by row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` items within a row, and the index of each run's first item."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.diff(first)
    ends = np.repeat(first[1:], counts)
    at = np.flatnonzero(np.arange(n) + width <= ends)
    return runs_at(hashes, at, width), at


def runs_at(hashes: np.ndarray, at: np.ndarray, width: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """Hashes of the runs of ``width`` items that begin at ``at``; another multiplier gives a hash independent of the first."""
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = out * np.uint64(multiplier) + hashes[at + k]
    return mix(out)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` items lie in a run of ``width`` items that begins at one of ``starts``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:n]) > 0
