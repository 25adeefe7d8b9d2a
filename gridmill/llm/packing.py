"""Packing token sequences: best-fit decreasing over windows of a fixed length.

Texts become token identifiers, then an end identifier. Overlong documents are
first cut into full windows; the remainders, longest first, each go to the open
window with the least room that still holds them. A segment tree over remaining
capacities finds that window. Pieces are dealt at random into shards of bounded
size, each packed on its own, so no task sees more than a shard.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.frames import id_and_text
from gridmill.store import materialize

WINDOW = 1024
END_ID = 0
#: Pieces in a shard, about.
SHARD_PIECES = 20_000
_SHARD_BITS = 24


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str | None):
    """Text to identifiers as the tokenizer file gives them.

    Where the same vocabulary lies there as ranks, those encode several times
    faster; texts that hold a special token's string go to the file's own tokenizer.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(json_path)
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    slow = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranks_path is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(f"ranks:{ranks_path}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow(text) if any(t in text for t in special) else np.array(fast.encode_ordinary(text), np.uint32)


def default_tokenizer() -> tuple[str, str | None]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenize(text: str | None, tokenizer: tuple[str, str | None]) -> np.ndarray:
    """Identifiers with the end identifier; a null text has only that."""
    ids = _encoder(*tokenizer)(text) if text else np.zeros(0, np.uint32)
    return np.append(ids, np.uint32(END_ID))


def cut(docs: DataFrame, window: int = WINDOW, tokenizer: tuple[str, str | None] | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` identifiers: full windows, then the remainder."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, length, crc, total, ids = [], [], [], [], [], []
            for d, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                all_ids = tokenize(value.as_py(), tokenizer)
                for a in range(0, len(all_ids), window):
                    piece = all_ids[a : a + window]
                    doc.append(d)
                    start.append(a)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.astype("<u4").tobytes()))
                    total.append(len(all_ids))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return id_and_text(docs).mapInArrow(run, schema + ", ids array<int>" * with_ids)


class RoomTree:
    """How many open windows have each remaining capacity; finds the least that is enough."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        k = room + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and window of the tightest open window with at least ``need`` left."""
        k = need + self.size
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        found = self.open[room].pop()
        while k:
            self.count[k] -= 1
            k >>= 1
        return room, found


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces come longest first, equal ones as listed."""
    order = np.argsort(-lengths, kind="stable")
    tree, where, offset, opened = RoomTree(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        got = tree.take(n)
        room, at = got if got else (window, opened)
        opened += got is None
        where[i], offset[i] = at, window - room
        if room > n:
            tree.add(room - n, at)
    return where, offset


def pack(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; within a sequence offsets have no gaps from 0.

    Full pieces are sequences of their own. The shard of a piece follows from its place in the written
    table, so that repeated rows are dealt evenly too, and a task that is run again deals alike.
    """
    pieces = materialize(pieces, "pieces")
    shards = max(1, ceil(pieces.count() / shard_pieces))
    columns = list(pieces.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = best_fit_decreasing(group["length"].to_numpy(), window)
        return group[columns].assign(sequence_id=(int(key[0]) << _SHARD_BITS) + where, offset=offset)

    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, window: int = WINDOW, tokenizer: tuple[str, str | None] | None = None) -> DataFrame:
    """Every identifier of every row of ``docs`` in exactly one piece of one sequence.

    A null or empty text is one piece that holds the end identifier alone;
    repeated rows are packed once each; a null doc_id stays null.
    """
    return pack(cut(docs, window, tokenizer), window)
