"""N-gram Jaccard join with a token-group matrix.

Documents are sets of 3-word shingles; two link when their intersection is at
least ``PERCENT`` percent of their union. The result is exact:

1. Every shingle is counted over all documents. A document with fewer than
   ``PERCENT`` percent of its shingles found elsewhere links with nothing.
2. Equal sets become one node. Counted among nodes only, shingles are put in one
   order, rarest first; sets that link share one of their first few (the prefix).
3. Similar nodes form groups: those with the same most frequent shingle, in parts
   of about ``GROUP`` that keep nodes with the same rarest shingle together. A group's nodes are compared with each
   other and with the first part of their kind.
4. Every node outside the largest component that meets at a prefix shingle is a query against the
   groups met there of other components and of fitting sizes; both ends of a link between components cannot
   lie in the largest one. The token-group matrix stores each group's token union. A query's overlap with
   the union bounds its overlap with every member, so only groups where that reaches what a link
   needs are opened, and no link is missed.
5. Components of all links found are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import exchange, tokens
from gridmill.llm.frames import fresh
from gridmill.operators.graph import components
from gridmill.store import materialize

SHINGLE = 3
PERCENT = 90
#: Nodes of a group's part, and queries that open one at once, about.
GROUP = 128
QUERIES = 128
_COLUMNS = 4_096

_U64 = np.uint64


def shingle_sets(chunk: tokens.Chunk, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, where each starts first, and words by row. Fewer words than ``width`` are one shingle."""
    chunk = tokens.Chunk(chunk.first_row, tokens.lower_ascii(chunk.data), chunk.offsets)
    starts, ends, first = chunk.words()
    words = chunk.running_hash().of(starts, ends)
    counts = np.diff(first)
    hashes, at = [], []
    for w in range(1, width + 1):
        runs, places = tokens.windows(words, first, w)
        if w < width:
            row = np.searchsorted(first, places, "right") - 1
            runs, places = runs[counts[row] == w], places[counts[row] == w]
        hashes.append(runs)
        at.append(places)
    runs, places = np.concatenate(hashes), np.concatenate(at)
    row = np.searchsorted(first, places, "right") - 1
    order = np.argsort(places, kind="stable")
    runs, places, row = runs[order], places[order], row[order]
    once = np.sort(np.unique(tokens.mix(runs ^ tokens.mix(row.astype(_U64) + _U64(1))), return_index=True)[1])
    return runs[once], places[once], counts


def _row_sums(values: np.ndarray, row_ends: np.ndarray) -> np.ndarray:
    """Sums over 64 bits of the values up to each row's end, by row."""
    total = np.zeros(len(values) + 1, _U64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[row_ends], prepend=_U64(0))


def counted_sets(keyed: DataFrame, deal: exchange.Deal, width: int = SHINGLE) -> DataFrame:
    """For each row: its set's size and two hashes, and how many of its shingles other rows have too (or seem to)."""
    kinds = {**exchange.KEYS, "n": np.int64, "node": np.uint64, "check": np.uint64}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel = exchange.Parcel(deal)

        def payload(_, items: exchange.Items, some: np.ndarray) -> list[bytes]:
            leaders = items.leaders[some]
            return [items.hashes[leaders].astype(np.uint32).tobytes(), exchange.pack_places(items.places[leaders]), np.packbits(items.sizes[some] > 1).tobytes()]

        for batch in batches:
            for chunk in tokens.chunks(batch.column("text")):
                runs, at, counts = shingle_sets(chunk, width)
                ends = np.searchsorted(at, np.cumsum(counts))
                rows = exchange.key_columns(batch, chunk)
                rows |= {"n": np.diff(ends, prepend=0), "node": _row_sums(tokens.mix(runs), ends), "check": _row_sums(tokens.mix(~runs), ends)}
                parcel.add(rows, counts, at, runs, np.zeros(len(at), bool))
                if parcel.full:
                    yield from parcel.records(payload)
        yield from parcel.records(payload)

    def answer(records: list[list[bytes]]) -> list[list[bytes] | None]:
        items = [np.frombuffer(r[0], np.uint32) for r in records]
        # What comes again within a parcel counts twice: that is all a verdict needs.
        again = [x[np.unpackbits(np.frombuffer(r[2], np.uint8), count=len(x)).astype(bool)] for r, x in zip(records, items, strict=True)]
        ordered = np.sort(np.concatenate(items + again))
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            return [None] * len(records)
        hits = [shared[np.minimum(np.searchsorted(shared, x), len(shared) - 1)] == x for x in items]
        return [[exchange.pack_places(exchange.unpack_places(r[1])[h])] if h.any() else None for r, h in zip(records, hits, strict=True)]

    def settle(rows: exchange.Rows, found: list[list[bytes]], followers: exchange.Followers) -> pa.Table:
        ends = np.cumsum(rows["n_places"])
        shared = np.zeros(len(ends), np.int64)
        for places in (followers.places, *(exchange.unpack_places(x[0]) for x in found)):
            shared += np.bincount(np.searchsorted(ends, places, "right"), minlength=len(ends))
        columns = {k: rows[k].view(np.int64) for k in kinds} | {"shared": shared}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    sent = keyed.select("text", "id", "tie", "tie2").mapInArrow(send, exchange.RECORD_SCHEMA)
    schema = "id long, tie long, tie2 long, n long, node long, check long, shared long"
    return exchange.settled(exchange.answered(sent, answer), kinds, settle, schema)


def node_sets(keyed: DataFrame, nodes: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The shingles of each node, from the text of one document that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for chunk in tokens.chunks(batch.column("text")):
                runs, at, counts = shingle_sets(chunk, width)
                sets += [np.sort(x).tobytes() for x in np.split(runs, np.searchsorted(at, np.cumsum(counts)[:-1]))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(sets, pa.binary())], names=["node", "n", "shingles"])

    rows = exchange.likely(keyed, nodes).join(nodes, ["id", "tie", "tie2"]).dropDuplicates(["node"]).select("text", "node", "n")
    return rows.mapInArrow(run, "node long, n long, shingles binary")


def prefixes(sets: DataFrame, deal: exchange.Deal, percent: int = PERCENT) -> DataFrame:
    """For each node that may still link: its most frequent shingle (``key``) and its prefix, with counts among nodes."""
    kinds = {"node": np.int64, "n": np.int64}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel = exchange.Parcel(deal)

        def payload(_, items: exchange.Items, some: np.ndarray) -> list[bytes]:
            leaders = items.leaders[some]
            return [items.hashes[leaders].tobytes(), exchange.pack_places(items.places[leaders]), items.sizes[some].astype(np.uint32).tobytes()]

        for batch in batches:
            n = batch.column("n").to_numpy()
            for k in range(batch.num_rows):
                items = np.frombuffer(batch.column("shingles")[k].as_py(), _U64)
                rows = {"node": batch.column("node").to_numpy()[k : k + 1], "n": n[k : k + 1]}
                parcel.add(rows, n[k : k + 1], np.arange(len(items)), items, np.zeros(len(items), bool))
                if parcel.full:
                    yield from parcel.records(payload)
        yield from parcel.records(payload)

    def answer(records: list[list[bytes]]) -> list[list[bytes] | None]:
        items = [np.frombuffer(r[0], _U64) for r in records]
        values, which = np.unique(np.concatenate(items), return_inverse=True)
        counts = np.bincount(which, np.concatenate([np.frombuffer(r[2], np.uint32) for r in records]), len(values)).astype(np.int64)
        out: list[list[bytes] | None] = []
        for r, x in zip(records, items, strict=True):
            c = counts[np.searchsorted(values, x)]
            more = c > 1
            out.append([exchange.pack_places(exchange.unpack_places(r[1])[more]), x[more].tobytes(), c[more].astype(np.uint32).tobytes()] if more.any() else None)
        return out

    def settle(rows: exchange.Rows, found: list[list[bytes]], followers: exchange.Followers) -> pa.Table:
        ends = np.cumsum(rows["n_places"])
        join = lambda k, kind: np.concatenate([np.frombuffer(x[k], kind) for x in found]) if found else np.zeros(0, kind)
        places = np.concatenate([exchange.unpack_places(x[0]) for x in found]) if found else np.zeros(0, np.int64)
        items, counts = join(1, _U64), join(2, np.uint32)
        more, after = followers.of(places)
        places, items, counts = np.concatenate([places, more]), np.concatenate([items, items[after]]), np.concatenate([counts, counts[after]])
        row = np.searchsorted(ends, places, "right")
        order = np.lexsort((items, counts, row))
        items, row = items[order].view(np.int64), row[order]
        edges = np.searchsorted(row, np.arange(len(ends) + 1))
        n = rows["n"]
        shared = np.diff(edges)
        need = -(-percent * n // 100)
        may = np.flatnonzero((shared >= need) & (n > 0))
        prefix = [items[edges[k] : edges[k] + shared[k] - need[k] + 1] for k in may]
        columns = [pa.array(rows["node"][may], pa.int64()), pa.array(n[may], pa.int64()), pa.array(items[edges[may + 1] - 1] if len(may) else [], pa.int64())]
        return pa.Table.from_arrays([*columns, pa.array(prefix, pa.list_(pa.int64()))], names=["node", "n", "key", "prefix"])

    sent = sets.mapInArrow(send, exchange.RECORD_SCHEMA)
    return exchange.settled(exchange.answered(sent, answer), kinds, settle, "node long, n long, key long, prefix array<long>")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``, by products of 0-1 matrices."""
    out = np.zeros((len(a), len(b)))
    if not a or not b:
        return out
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    spread = []
    for sets in (a, b):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        items = np.concatenate(sets)
        at = np.searchsorted(common, items)
        here = (at < len(common)) & (common[np.minimum(at, max(len(common) - 1, 0))] == items) if len(common) else np.zeros(len(items), bool)
        order = np.argsort(at[here], kind="stable")
        spread.append((row[here][order], at[here][order]))
    for low in range(0, len(common), _COLUMNS):
        width = min(_COLUMNS, len(common) - low)
        parts = []
        for (row, at), size in zip(spread, (len(a), len(b)), strict=True):
            x, y = np.searchsorted(at, (low, low + width))
            m = np.zeros((size, width), np.float32)
            m[row[x:y], at[x:y] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    both = overlaps(a, b).astype(np.int64)
    union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
    return (both > 0) & (100 * both >= percent * union)


def _forest(nodes: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of a symmetric link matrix with the least node of its component, where that is another."""
    label = np.arange(len(nodes))
    order = np.argsort(nodes, kind="stable")
    links = links[np.ix_(order, order)] | np.eye(len(nodes), dtype=bool)
    while True:
        new = np.where(links, label[None, :], len(nodes)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    nodes = nodes[order]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def opened(rows: DataFrame, by: list[str], percent: int = PERCENT) -> DataFrame:
    """Links (as forests) found by comparing, within each group, its members with each other and its queries with its members.

    ``role`` is 0 for members that were compared before, 1 for members, 2 for queries.
    """

    def run(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        node = table["node"].to_numpy()
        sets = [np.frombuffer(x, _U64) for x in table["shingles"].to_pylist()]
        members, queries = np.flatnonzero(role < 2), np.flatnonzero(role == 2)
        links = np.zeros((len(node), len(node)), bool)
        if len(queries):
            found = linked([sets[k] for k in queries], [sets[k] for k in members], percent)
            links[np.ix_(queries, members)] = found
        fresh = np.flatnonzero(role == 1)
        if len(fresh):
            links[np.ix_(fresh, members)] = linked([sets[k] for k in fresh], [sets[k] for k in members], percent)
        a, b = _forest(node, links | links.T)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy(*by).applyInArrow(run, "a long, b long")


def needed(n: np.ndarray, least_n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of a set of ``n`` with one of ``least_n`` or more that it links with."""
    other = np.maximum(least_n, -(-percent * n // 100))
    return -(-percent * (n + other) // (100 + percent))


def token_groups(nodes: DataFrame) -> DataFrame:
    """The token-group matrix by rows: each group's token union, and its smallest set's size."""

    def run(table: pa.Table) -> pa.Table:
        union = np.unique(np.concatenate([np.frombuffer(x, _U64) for x in table["shingles"].to_pylist()]))
        least = min(len(x) // 8 for x in table["shingles"].to_pylist())
        first = table.slice(0, 1)
        return pa.table({"key": first["key"], "part": first["part"], "least_n": pa.array([least], pa.int64()), "shingles": pa.array([union.tobytes()], pa.binary())})

    return nodes.select("key", "part", "shingles").groupBy("key", "part").applyInArrow(run, "key long, part int, least_n long, shingles binary")


def qualifying(asked: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of ``asked (node, shingles, key, part, load)`` those whose overlap with the group's union may be a link's."""

    def run(table: pa.Table) -> pa.Table:
        is_group = table["least_n"].is_valid().to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x, _U64) for x in table["shingles"].to_pylist()]
        (g,) = np.flatnonzero(is_group)
        queries = np.flatnonzero(~is_group)
        union, least = sets[g], table["least_n"][int(g)].as_py()
        both = np.array([np.isin(sets[q], union, assume_unique=True, kind="sort").sum() for q in queries], np.int64)
        n = np.array([len(sets[q]) for q in queries], np.int64)
        return table.select(["node", "key", "part", "load"]).take(pa.array(queries[both >= needed(n, np.int64(least), percent)], pa.int64()))

    columns = ["node", "shingles", "key", "part", "load", "least_n"]
    rows = asked.withColumn("least_n", F.lit(None).cast("long")).select(*columns).unionByName(groups.withColumn("node", F.lit(0).cast("long")).select(*columns))
    return rows.groupBy("key", "part", "load").applyInArrow(run, "node long, key long, part int, load int")


def parted(marked: DataFrame) -> DataFrame:
    """Adds ``parts`` of a node's most frequent shingle ``key``, some ``GROUP`` nodes each, and the node's ``part``.

    Nodes with the same rarest shingle are in one part, so a shingle meets few groups and a group's token union stays small; those of a
    rarest shingle that more than ``GROUP`` nodes share are dealt over as many parts as they fill.
    """
    counts = marked.withColumn("rarest", F.col("prefix")[0]).groupBy("key", "rarest").agg(F.count("*").alias("alike"))
    counts = materialize(counts, "rarest-shingles")
    parts = counts.groupBy("key").agg(F.ceil(F.sum("alike") / GROUP).cast("int").alias("parts"))
    hot = counts.where(F.col("alike") > GROUP).select("key", "rarest", F.ceil(F.col("alike") / GROUP).alias("over"))
    rows = marked.join(parts, "key").withColumn("rarest", F.col("prefix")[0]).join(hot, ["key", "rarest"], "left")
    step = F.pmod(F.xxhash64("node"), F.coalesce("over", F.lit(1)))
    return rows.withColumn("part", F.pmod(F.pmod(F.xxhash64("rarest"), "parts") + step, "parts").cast("int")).drop("rarest", "over")


def node_links(sets: DataFrame, deal: exchange.Deal, percent: int = PERCENT) -> DataFrame:
    """``(node, root)`` for all nodes that link with another."""
    marked = materialize(prefixes(sets, deal, percent), "prefixes")
    nodes = materialize(parted(marked).join(sets.select("node", "shingles"), "node"), "groups")
    marked = nodes.drop("shingles")
    own = nodes.select("node", "shingles", "key", "part", F.lit(1).alias("role"))
    hubs = nodes.where((F.col("part") == 0) & (F.col("parts") > 1))
    hubs = hubs.select("node", "shingles", "key", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    first_links = materialize(opened(own.unionByName(hubs), ["key", "part"], percent), "group-links")
    roots = components(first_links)
    # Prefix shingles that meet more than one component ask for groups.
    known = marked.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    entries = materialize(known.select("node", "n", "key", "part", "root", F.explode("prefix").alias("shingle")), "prefix-shingles")
    held = entries.groupBy("shingle", "root").agg(F.count("*").alias("held"))
    largest = held.groupBy("shingle").agg(F.max(F.struct("held", "root")).alias("most"), F.count("*").alias("roots"))
    largest = largest.where(F.col("roots") > 1).select("shingle", F.col("most.root").alias("largest"))
    # The join's output is written, so that a shingle of very many nodes can be split over tasks.
    queries = entries.join(largest, "shingle").where(F.col("root") != F.col("largest"))
    queries = materialize(queries.select("node", "n", "root", "shingle"), "outside-largest")
    places = entries.groupBy("shingle", "key", "part").agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    fits = (100 * F.col("most_n") >= percent * F.col("n")) & (percent * F.col("least_n") <= 100 * F.col("n"))
    other = (F.col("low") != F.col("root")) | (F.col("high") != F.col("root"))
    asks = materialize(queries.join(places, "shingle").where(fits & other).select("node", "key", "part").distinct(), "queries")
    dealt = lambda rows: rows.groupBy("key", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("loads"))
    every_load = F.explode(F.sequence(F.lit(0), F.col("loads") - 1)).alias("load")
    loads = materialize(dealt(asks), "loads")
    asked = asks.join(loads, ["key", "part"]).withColumn("load", F.pmod(F.xxhash64("node"), "loads").cast("int")).drop("loads")
    asked = asked.join(nodes.select("node", "shingles"), "node")
    groups = token_groups(nodes.join(loads, ["key", "part"], "left_semi")).join(loads, ["key", "part"]).select("key", "part", "least_n", "shingles", every_load)
    # What qualifies opens its group; so many queries at once, dealt anew.
    passed = materialize(qualifying(asked, groups, percent).drop("load"), "qualifying")
    loads = materialize(dealt(passed), "loads")
    asked = passed.join(loads, ["key", "part"]).withColumn("load", F.pmod(F.xxhash64("node"), "loads").cast("int"))
    asked = asked.join(nodes.select("node", "shingles"), "node").select("node", "shingles", "key", "part", "load", F.lit(2).alias("role"))
    there = nodes.join(loads, ["key", "part"]).select("node", "shingles", "key", "part", every_load, F.lit(0).alias("role"))
    more = opened(asked.unionByName(there), ["key", "part", "load"], percent)
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def classes(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles, component_id, its key (id, tie, tie2) and ``class_key``, null without shingles.

    Texts that are null or have no words have no shingles and link with nothing. Rows with a null
    identifier link like others; their component_id is null only where no linked row has one. Rows
    that share an identifier are separate documents of that name. Shingles are told apart by 64-bit hashes.
    """
    keyed = exchange.keyed(docs)
    deal = exchange.deal(docs)
    rows = materialize(counted_sets(keyed, deal, width), "shingle-counts")
    may = rows.where((F.col("n") > 0) & (100 * F.col("shared") >= percent * F.col("n")))
    nodes = may.groupBy("node", "check").agg(F.min(F.struct("id", "tie", "tie2")).alias("first"), F.first("n").alias("n"))
    nodes = materialize(nodes.select("node", "n", "first.*"), "nodes")
    sets = materialize(node_sets(keyed, nodes.select("node", "n", "id", "tie", "tie2"), width), "node-sets")
    roots = node_links(sets, deal, percent)
    names = nodes.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = names.groupBy("root").agg(F.min("id").alias("component"))
    names = materialize(names.join(least, "root").select("node", "root", "component"), "components")
    rows = rows.join(names, "node", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")))
    back = lambda c: F.when(F.col(c) != exchange.NO_ID, F.col(c))
    class_key = F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("class_key")
    return rows.select(
        back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"), "id", "tie", "tie2", class_key
    )


def one_of_each(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when of each class only the document with the smallest identifier does.

    Of repeated rows one stays. Rows without words are in no class and all stay. Columns are those of ``docs``.
    """
    first = classes(docs, width, percent).where(F.col("class_key").isNotNull())
    first = first.groupBy("class_key").agg(F.min(F.struct("id", "tie", "tie2")).alias("first")).select("first.*")
    keys = {k: fresh(f"key_{k}", docs.columns) for k in ("id", "tie", "tie2")}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumns({
        keys["id"]: F.coalesce(F.col("doc_id").cast("long"), F.lit(exchange.NO_ID)),
        keys["tie"]: F.xxhash64(text), keys["tie2"]: F.xxhash64(F.length(text), text),
    })
    kept = keyed.join(first.withColumnsRenamed(keys), list(keys.values())).dropDuplicates(list(keys.values()))
    return kept.drop(*keys.values()).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(~worded))
