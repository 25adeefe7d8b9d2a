"""Line deduplication with a log-template tree.

A line's place in the tree follows from its number of tokens and its first
``DEPTH`` tokens, tokens with a digit standing for any; so much is fixed. (A line
whose every token has a digit keeps them as they are: nothing else could tell it.)
At a leaf, lines that agree with a template in at least ``LIKE`` of their tokens
join it, and tokens that differ become variable; so lines of one to three words join
equal ones only. A template whose lines stand in ``MIN_DOCS`` or more documents
recurs: its lines are dropped from all documents but the first (the smallest
identifier), so that one copy of what was repeated stays. Lines without a word stay.

Leaves are dealt into buckets by their hash. Equal lines travel once from each
parcel of text, with at most ``MIN_DOCS`` of their documents' identifiers, which is
all that the count of documents needs to be exact.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.llm import exchange, tokens
from gridmill.llm.frames import fresh
from gridmill.store import materialize

DEPTH = 3
LIKE = 0.75
MIN_DOCS = 5

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: The token that stands for any.
_ANY = np.uint32(0)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices of all items of ranges, range after range."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Lines:
    """Tokens of a parcel's lines, side by side."""

    def __init__(self) -> None:
        self.tokens: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.n = self.n_tokens = 0

    def add(self, toks: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        self.tokens.append(toks)
        self.counts.append(counts)
        self.hashes.append(hashes)
        self.n += len(counts)
        self.n_tokens += len(toks)
        return np.arange(self.n - len(counts), self.n)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if len(self.tokens) > 1:
            self.tokens, self.counts, self.hashes = [np.concatenate(self.tokens)], [np.concatenate(self.counts)], [np.concatenate(self.hashes)]
        if not self.tokens:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        counts = self.counts[0]
        return self.tokens[0], np.cumsum(counts) - counts, counts, self.hashes[0]


def lines_of(chunk: tokens.Chunk) -> tuple[np.ndarray, ...]:
    """Of lines with a word: the place among all lines of the chunk, leaf, hash, tokens and their number; lines by row."""
    data = chunk.data
    starts, ends, _ = chunk.words()
    hashes = chunk.running_hash().of(starts, ends)
    digits = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_DIGIT[data], out=digits[1:])
    varies = digits[ends] > digits[starts]
    newline = data == 10
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(newline, out=before[1:])
    n_lines = np.diff(before[chunk.offsets]) + 1
    row_first = np.cumsum(n_lines) - n_lines
    row = np.searchsorted(chunk.offsets, starts, "right") - 1
    place = before[starts] - before[chunk.offsets[row]] + row_first[row]
    new = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(place)))
    some_stay = np.add.reduceat(~varies, first) > 0 if len(first) else np.zeros(0, bool)
    toks = np.where(varies & np.repeat(some_stay, counts), np.uint64(0), hashes | np.uint64(1))
    leaf = tokens.mix(counts.astype(np.uint64))
    for k in range(DEPTH):
        deep = counts > k
        leaf[deep] = tokens.mix(leaf[deep] ^ (toks[first[deep] + k] * np.uint64(2 * k + 3)))
    every = _spread(first, counts)
    line = np.zeros(len(first), np.uint64)
    if len(first):
        step = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
        line = tokens.mix(np.add.reduceat(tokens.mix(toks[every] + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.cumsum(counts) - counts))
    return place[first], leaf, line, (toks[every] >> np.uint64(32)).astype(np.uint32), counts, n_lines


def _position_groups(toks: np.ndarray, groups: int) -> list[np.ndarray]:
    """Positions dealt into groups that tell lines apart about equally well: the most telling positions first, each to the group that has least."""
    telling = []
    for column in toks.T:
        _, counts = np.unique(column, return_counts=True)
        shares = counts / len(toks)
        telling.append(float(-np.log((shares * shares).sum())))
    held, total = [[] for _ in range(groups)], [0.0] * groups
    for p in sorted(range(toks.shape[1]), key=lambda p: (-telling[p], p)):
        g = min(range(groups), key=lambda g: (total[g], len(held[g])))
        held[g].append(p)
        total[g] += telling[p]
    return [np.array(h) for h in held]


def _group_key(toks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """A number for the tokens at some positions of each line."""
    steps = (positions.astype(np.uint64) + np.uint64(1)) << np.uint64(33)
    return tokens.mix(toks[:, positions].astype(np.uint64) + steps).sum(axis=1, dtype=np.uint64)


def templates(toks: np.ndarray, like: float = LIKE, lead: int = DEPTH) -> np.ndarray:
    """The template of each line of one leaf, lines by rows; they come in the order given (that of their first documents).

    A line joins the template it agrees with most (of equals the oldest), if that is enough. If ``most`` tokens may differ and the positions are in
    ``most + 1`` groups, a template that is enough agrees in one group throughout; so templates are listed by the tokens of each group, and only those
    are looked at that share a group with the line. The first ``lead`` tokens are the same throughout a leaf, and are in no group.
    """
    n = toks.shape[1]
    lead = min(lead, n)
    need = int(np.ceil(like * n - 1e-9))
    most = n - need
    if n - lead <= most:  # all lines of the leaf agree enough
        return np.zeros(len(toks), np.int64)
    groups = [g + lead for g in _position_groups(toks[:, lead:], most + 1)]
    group_of = np.zeros(n, np.int64)
    for k, g in enumerate(groups):
        group_of[g] = k
    keys = np.stack([_group_key(toks, g) for g in groups], axis=1).tolist()
    known, ones = np.zeros((16, n), np.uint32), np.ones(n, np.float32)
    used = 0
    listed: list[dict[int, array]] = [{} for _ in groups]
    out = np.zeros(len(toks), np.int64)
    for k, line in enumerate(toks):
        found = [np.frombuffer(x, np.int32) for g, key in zip(listed, keys[k], strict=True) if (x := g.get(key))]
        if found:
            candidates = np.concatenate(found)
            found = None
            agree = (known[candidates] == line) @ ones
            best = agree.max()
            if best >= need:
                t = out[k] = candidates[agree == best].min()
                changed = np.flatnonzero((known[t] != line) & (known[t] != _ANY))
                if len(changed):
                    known[t, changed] = _ANY
                    for g in np.unique(group_of[changed]).tolist():
                        listed[g].setdefault(int(_group_key(known[t : t + 1], groups[g])[0]), array("i")).append(int(t))
                continue
        if used == len(known):
            known = np.concatenate([known, np.zeros_like(known)])
        known[used] = line
        for g, key in zip(listed, keys[k], strict=True):
            g.setdefault(key, array("i")).append(used)
        out[k] = used
        used += 1
    return out


def _leaf_verdicts(line: np.ndarray, toks: list[np.ndarray], ids: list[np.ndarray], min_docs: int, like: float) -> tuple[np.ndarray, np.ndarray]:
    """For entries of one leaf: whether their template recurs, and its first document."""
    distinct, first, which = np.unique(line, return_index=True, return_inverse=True)
    template = np.zeros(len(line), np.int64)
    if len(distinct) > 1:
        earliest = np.full(len(distinct), exchange.NO_ID)
        np.minimum.at(earliest, which, np.array([x[0] for x in ids]))
        order = np.lexsort((distinct, earliest))
        of_line = np.empty(len(distinct), np.int64)
        of_line[order] = templates(np.stack([toks[first[k]] for k in order]), like)
        template = of_line[which]
    recurs, keeper = np.zeros(len(line), bool), np.zeros(len(line), np.int64)
    for t in np.unique(template):
        mine = np.flatnonzero(template == t)
        docs = np.unique(np.concatenate([ids[k] for k in mine]))
        if len(docs) >= min_docs:
            recurs[mine], keeper[mine] = True, docs[0]
    return recurs, keeper


def recurring_lines(keyed: DataFrame, deal: exchange.Deal, min_docs: int = MIN_DOCS, like: float = LIKE) -> DataFrame:
    """For each row with any: the numbers of its lines (from 0) whose template recurs and first stands in another document."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel, store = exchange.Parcel(deal), Lines()

        def alike(rows: exchange.Rows, places: np.ndarray, leaves: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Equal lines are alike; within a group they come by document."""
            hashes = store.joined()[3][index]
            ids = rows["id"][np.searchsorted(np.cumsum(rows["n_places"]), places, "right")]
            order = np.lexsort((ids, hashes))
            starts = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1])[: len(order)])
            return order, starts, order[starts]

        def payload(rows: exchange.Rows, items: exchange.Items, some: np.ndarray) -> list[bytes]:
            """Distinct lines, each with its least identifiers, as many as a verdict needs."""
            toks, starts, counts, hashes = store.joined()
            leaders = items.leaders[some]
            chosen = items.flags[leaders]
            every = items.order[_spread(items.starts[some], items.sizes[some])]
            group = np.repeat(np.arange(len(some)), items.sizes[some])
            ids = rows["id"][np.searchsorted(np.cumsum(rows["n_places"]), items.places[every], "right")]
            once = np.append(True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1]))
            group, ids = group[once], ids[once]
            rank = np.arange(len(group)) - np.searchsorted(group, group)
            group, ids = group[rank < min_docs], ids[rank < min_docs]
            return [
                items.hashes[leaders].tobytes(), hashes[chosen].tobytes(), counts[chosen].astype(np.uint32).tobytes(), toks[_spread(starts[chosen], counts[chosen])].tobytes(),
                np.bincount(group, minlength=len(some)).astype(np.uint32).tobytes(), ids.tobytes(), items.places[leaders].astype(np.uint32).tobytes(),
            ]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal store
            yield from parcel.records(payload, alike)
            store = Lines()

        for batch in batches:
            for chunk in tokens.chunks(batch.column("text")):
                places, leaves, hashes, toks, counts, n_lines = lines_of(chunk)
                parcel.add(exchange.key_columns(batch, chunk), n_lines, places, leaves, store.add(toks, counts, hashes))
                if parcel.full or store.n_tokens >= deal.parcel_items:
                    yield from flush()
        yield from flush()

    def answer(records: list[list[bytes]]) -> list[list[bytes] | None]:
        read = lambda k, kind: [np.frombuffer(r[k], kind) for r in records]
        sizes = [len(r[0]) // 8 for r in records]
        leaf, line = np.concatenate(read(0, np.uint64)), np.concatenate(read(1, np.uint64))
        counts, toks = np.concatenate(read(2, np.uint32)).astype(np.int64), np.concatenate(read(3, np.uint32))
        n_ids, ids = np.concatenate(read(4, np.uint32)).astype(np.int64), np.concatenate(read(5, np.int64))
        tok_at, id_at = np.cumsum(counts) - counts, np.cumsum(n_ids) - n_ids
        recurs, keeper = np.zeros(len(leaf), bool), np.zeros(len(leaf), np.int64)
        order = np.lexsort((line, leaf))
        edges = np.flatnonzero(np.append(True, leaf[order][1:] != leaf[order][:-1])) if len(order) else np.zeros(0, np.int64)
        documents = np.add.reduceat(n_ids[order], edges) if len(edges) else edges
        for k in np.flatnonzero(documents >= min_docs):
            some = order[edges[k] : edges[k + 1] if k + 1 < len(edges) else len(order)]
            recurs[some], keeper[some] = _leaf_verdicts(
                line[some], [toks[tok_at[e] : tok_at[e] + counts[e]] for e in some], [ids[id_at[e] : id_at[e] + n_ids[e]] for e in some], min_docs, like
            )
        out: list[list[bytes] | None] = []
        at = 0
        for r, size in zip(records, sizes, strict=True):
            hit = recurs[at : at + size]
            out.append([np.frombuffer(r[6], np.uint32)[hit].tobytes(), keeper[at : at + size][hit].tobytes()] if hit.any() else None)
            at += size
        return out

    def settle(rows: exchange.Rows, found: list[list[bytes]], followers: exchange.Followers) -> pa.Table:
        ends = np.cumsum(rows["n_places"])
        places = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x[0], np.uint32) for x in found)])
        keeper = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x[1], np.int64) for x in found)])
        more, after = followers.of(places)
        places, keeper = np.concatenate([places, more]), np.concatenate([keeper, keeper[after]])
        row = np.searchsorted(ends, places, "right")
        drop = rows["id"][row] != keeper
        row, places = row[drop], places[drop]
        order = np.argsort(places, kind="stable")
        row, places = row[order], places[order]
        hit, first = np.unique(row, return_index=True)
        local = (places - (ends - rows["n_places"])[row]).astype(np.int32)
        parts = [x.tobytes() for x in np.split(local, first[1:])] if len(hit) else []
        columns = [pa.array(rows[k][hit], pa.int64()) for k in exchange.KEYS]
        return pa.Table.from_arrays([*columns, pa.array(parts, pa.binary())], names=["id", "tie", "tie2", "lines"])

    sent = keyed.select("text", "id", "tie", "tie2").mapInArrow(send, exchange.RECORD_SCHEMA)
    return exchange.settled(exchange.answered(sent, answer), exchange.KEYS, settle, "id long, tie long, tie2 long, lines binary")


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, like: float = LIKE) -> DataFrame:
    """All columns of ``docs`` with recurring lines gone from ``text``, then ``n_lines`` and ``n_dropped``.

    What is left is joined by newlines again. A null text stays null and has no lines; an empty text has one.
    Rows that share an identifier count as one document; null identifiers count as one, after all others.
    The two names get underscores in front where ``docs`` has columns called so.
    """
    names = [fresh(n, docs.columns) for n in ("n_lines", "n_dropped")]
    marks = recurring_lines(exchange.keyed(docs), exchange.deal(docs), min_docs, like)
    marks = materialize(marks.groupBy("id", "tie", "tie2").agg(F.first("lines").alias("lines")), "recurring-lines")
    keys = {k: fresh(f"key_{k}", docs.columns) for k in ("id", "tie", "tie2", "lines")}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({
        keys["id"]: F.coalesce(F.col("doc_id").cast("long"), F.lit(exchange.NO_ID)),
        keys["tie"]: F.xxhash64(text), keys["tie2"]: F.xxhash64(F.length(text), text),
    })
    marks = marks.withColumnsRenamed(keys)
    rows = keyed.join(marks, [keys["id"], keys["tie"], keys["tie2"]], "left").select(*[F.col(f"`{c}`") for c in docs.columns], keys["lines"])
    columns_before, at = list(docs.columns), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for text, lines in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                own = text.split("\n") if text is not None else []
                gone = np.frombuffer(lines, np.int32).tolist() if lines else []
                total.append(len(own))
                dropped.append(len(gone))
                if gone:
                    for k in reversed(gone):
                        del own[k]
                    text = "\n".join(own)
                texts.append(text)
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : -1], pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*columns_before, *names])

    schema = T.StructType(docs.withColumn("text", F.col("text").cast("string")).schema.fields)
    for n in names:
        schema = schema.add(n, T.LongType())
    return rows.mapInArrow(run, schema)


def without_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, like: float = LIKE) -> DataFrame:
    """``docs`` with recurring lines gone, in their own columns; documents that lose their last word go.

    ``n_chars``, where there is such a column, follows the text.
    """
    rows = drop_lines(docs, min_docs, like)
    dropped = F.col(f"`{rows.columns[-1]}`") > 0
    rows = rows.where(~dropped | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(dropped, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
