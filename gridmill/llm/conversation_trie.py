"""Prefix trie of conversations: succinct level-order tries (LOUDS) by prefix shard, heavy upper levels merged separately.

1. Turns are sorted by ranges of (conversation, turn), so a conversation of any length lies in several tasks; what a range
   knows of a conversation (its number of turns, the sum of their hashes) is one small row, and running sums over these place every turn.
2. A prefix of ``d`` turns is known by ``d`` and 128 bits, the exclusive sum of hashes of its turns with their places.
3. A prefix whose members have more than ``limit`` turns from it on, together, is heavy; the members of such a node are counted by plain
   aggregation. Below the heavy nodes every subtree is small: such subtrees are dealt into buckets, and a bucket's forest becomes
   one LOUDS bit vector with arrays of labels in level order.
4. In a bucket subtree sums are taken level by level from the deepest, each added to its parent. The sums of the subtrees that hang
   on heavy nodes are added to these, and go up among heavy nodes by doubling steps: 1, 2, 4, ... levels at a time.
5. The identifiers that end at a heavy node are sorted by ranges, joined where they lie, and hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.mixing import word_count
from gridmill.shipping import ship
from gridmill.store import materialize

#: Turns below a light node at most, at least; the limit grows with the root of all turns, so heavy nodes stay few.
LIMIT = 512
#: Turns in a bucket, about.
BUCKET_TURNS = 1 << 17
#: So many heavy nodes (64 bytes each) are broadcast; more are joined.
MOST_BROADCAST = 200_000
_EMPTY = hashlib.sha256(b"").digest()
_NODE = ["depth", "k1", "k2"]
_PIECE = 33  # bits of monotonically_increasing_id() within a partition


@dataclass(frozen=True)
class Louds:
    """A forest in level order. Node 0 is a root above its trees; a node's bit group has a 1 for each child, then a 0."""

    bits: np.ndarray
    #: The number of the first node of each level, and one more entry.
    levels: np.ndarray

    @classmethod
    def of(cls, degrees: np.ndarray, levels: np.ndarray) -> Louds:
        bits = np.ones(int(degrees.sum()) + len(degrees), bool)
        bits[np.cumsum(degrees) + np.arange(len(degrees))] = False
        return cls(bits, levels)

    def parents(self) -> np.ndarray:
        """The parent of each node but node 0: the k-th 1 stands in its group, and groups are counted by the 0s before it."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros, prepend=-1) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, by adding each level to the one above, from the deepest on."""
        total, parents = values.copy(), self.parents()
        for low, high in zip(self.levels[-2:0:-1].tolist(), self.levels[:1:-1].tolist(), strict=True):
            np.add.at(total, parents[low - 1 : high - 1], total[low:high])
        return total


def level_order(node: list[np.ndarray], parent: list[np.ndarray], level: np.ndarray) -> tuple[np.ndarray, Louds]:
    """Distinct nodes' order by level and parent, and their forest; nodes of level 0 have no parent among them.

    ``node`` and ``parent`` are keys of several columns.
    """
    n = len(level)
    both = [np.concatenate(x) for x in zip(node, parent, strict=True)]
    by_key = np.lexsort(both)
    ordered = [x[by_key] for x in both]
    new = np.append(True, np.any([x[1:] != x[:-1] for x in ordered], axis=0))[: 2 * n]
    number = np.empty(2 * n, np.int64)
    number[by_key] = np.cumsum(new) - 1
    at = np.full(2 * n, -1)
    at[number[:n]] = np.arange(n)
    parent_at = np.where(level > 0, at[number[n:]], -1)
    by_level = np.argsort(level, kind="stable")
    edges = np.searchsorted(level[by_level], np.arange(int(level.max(initial=-1)) + 2))
    place = np.zeros(n + 1, np.int64)  # the last entry is the root's, found by -1
    order = np.empty(n, np.int64)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = by_level[low:high]
        mine = mine[np.argsort(place[parent_at[mine]], kind="stable")]
        order[low:high] = mine
        place[mine] = np.arange(low + 1, high + 1)
    degrees = np.bincount(place[parent_at], minlength=n + 1)
    return order, Louds.of(degrees, np.concatenate([[0], edges + 1]))


def crc(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string"))


def rebuilt(turns: DataFrame, heads: int = 4, share: int = 20) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations whose beginnings are replaced, and the conversations ``(conv_id, len)``.

    Conversation c begins with the first ``crc32(c) % heads`` turns of conversation ``c - c % share`` (all if fewer), and goes on with its
    own turns after as many of its own. Rows: conv_id, piece, depth (from 1), hashes ``a`` and ``b`` of role and text, words, and the rebuilt
    conversation's ``len``. ``piece`` orders parts of a conversation. With ``heads`` 1 conversations stay as they are.
    """
    ship(turns.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spread"),
    )
    keys = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("spread")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit(1), "text", "role").alias("b"), word_count(F.col("text")).alias("words"),
    )
    rows = materialize(rows.withColumn("piece", F.shiftright("at", _PIECE).cast("int")), "turns")
    pieces = rows.groupBy("conv_id", "piece").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "own": F.sum("n").over(Window.partitionBy("conv_id"))})
    pieces = materialize(pieces, "pieces-of-conversations")
    convs = pieces.where("before = 0").select("conv_id", "own", (crc(F.col("conv_id")) % heads).alias("cut"), (F.col("conv_id") - F.col("conv_id") % share).alias("base"))
    bases = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("cut", F.coalesce("base_own", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "cut", "head", (F.col("head") + F.greatest(F.col("own") - F.col("cut"), F.lit(0))).alias("len")), "conversations")
    placed = rows.join(pieces.select("conv_id", "piece", "start", "before").join(convs, "conv_id"), ["conv_id", "piece"])
    placed = placed.withColumn("i", F.col("at") - F.col("start") + F.col("before") + 1)
    columns = ["conv_id", "piece", "depth", "a", "b", "words", "len"]
    own = placed.where(F.col("i") > F.col("cut")).withColumn("depth", F.col("head") + F.col("i") - F.col("cut")).select(*columns)
    first = placed.where((F.col("conv_id") == F.col("base")) & (F.col("i") < heads)).select("base", "i", "a", "b", "words")
    lent = convs.where("head > 0").select("conv_id", "base", "head", "len").join(first, "base").where(F.col("i") <= F.col("head"))
    lent = lent.select("conv_id", F.lit(-1).alias("piece"), F.col("i").alias("depth"), "a", "b", "words", "len")
    return own.unionByName(lent), convs.select("conv_id", "len")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and each of its prefixes, the empty one included: conv_id, depth, len, words of the last turn, key and parent's key."""
    rows = turns.withColumns({"x1": F.xxhash64("a", "b", "depth"), "x2": F.xxhash64("depth", "b", "a")})
    sums = rows.groupBy("conv_id", "piece").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.bit_xor(c).over(earlier), F.lit(0).cast("long"))
    sums = sums.select("conv_id", "piece", before("s1").alias("s1"), before("s2").alias("s2"))
    within = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, ["conv_id", "piece"])
    for k in "12":
        rows = rows.withColumn(f"k{k}", F.bit_xor(f"x{k}").over(within).bitwiseXOR(F.col(f"s{k}")))
    columns = ["conv_id", "depth", "len", "words", "k1", "k2", "p1", "p2"]
    rows = rows.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("x1")), "p2": F.col("k2").bitwiseXOR(F.col("x2"))}).select(*columns)
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), "len", zero.alias("words"), *[zero.alias(c) for c in columns[4:]])
    return rows.unionByName(root)


_SHARD = ["bits", "levels", "conv_id", "depth", "n_convs", "words", "p1", "p2", "ends"]


def _pack(table: pa.Table) -> pa.Table:
    """One LOUDS forest of all subtrees of a bucket, with labels in level order."""
    col = {c: table[c].to_numpy() for c in ("conv_id", "depth", "level", "words", "k1", "k2", "p1", "p2", "last")}
    order = np.lexsort((col["conv_id"], col["k2"], col["k1"], col["depth"]))
    col = {c: v[order] for c, v in col.items()}
    new = np.append(True, np.any([col[c][1:] != col[c][:-1] for c in _NODE], axis=0))[: len(order)]
    start = np.flatnonzero(new)
    node = {c: v[start] for c, v in col.items()}
    n_convs = np.diff(np.append(start, len(order)))
    bfs, louds = level_order([node[c] for c in _NODE], [node["depth"] - 1, node["p1"], node["p2"]], node["level"])
    ends = [_EMPTY] * len(start)
    at = np.flatnonzero(col["last"])
    which = np.cumsum(new)[at] - 1
    for group in np.split(np.arange(len(at)), np.flatnonzero(which[1:] != which[:-1]) + 1) if len(at) else []:
        ends[which[group[0]]] = hashlib.sha256(",".join(map(str, col["conv_id"][at[group]].tolist())).encode()).digest()
    out = [
        np.packbits(louds.bits), louds.levels, node["conv_id"][bfs], node["depth"][bfs], n_convs[bfs], node["words"][bfs], node["p1"][bfs], node["p2"][bfs],
        np.frombuffer(b"".join(ends[k] for k in bfs), np.uint8),
    ]
    return pa.table({"nodes": pa.array([len(bfs)], pa.int32())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(_SHARD, out, strict=True)})


def unpack(record: dict) -> tuple[Louds, dict[str, np.ndarray]]:
    """A shard's forest and its labels by node, from node 1 on."""
    n = record["nodes"]
    bits = np.unpackbits(np.frombuffer(record["bits"], np.uint8), count=2 * n + 1).astype(bool)
    labels = {c: np.frombuffer(record[c], np.int64) for c in _SHARD[2:-1]}
    return Louds(bits, np.frombuffer(record["levels"], np.int64)), labels


def _unfolded(shards: DataFrame) -> DataFrame:
    """A row for each node of each shard, with its sums; ``parent`` is null where the parent is heavy, whose key is ``p1, p2``."""
    schema = "conv_id long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, p1 long, p2 long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                louds, label = unpack(record)
                parents, degrees = louds.parents(), louds.degrees()[1:]
                with_root = lambda x: np.concatenate([np.zeros(1, np.int64), x])
                leaves = louds.rolled_up(with_root((degrees == 0).astype(np.int64)))[1:]
                saved = louds.rolled_up(with_root((label["n_convs"] - 1) * label["words"]))[1:]
                above = with_root(label["conv_id"])[parents]
                digests = [record["ends"][k : k + 32].hex() for k in range(0, 32 * record["nodes"], 32)]
                columns = [label["conv_id"], label["depth"], None, label["n_convs"], degrees, leaves, saved, None, label["p1"], label["p2"]]
                arrays = [pa.array(c, pa.int64()) if c is not None else None for c in columns]
                arrays[2], arrays[7] = pa.array(above, pa.int64(), mask=parents == 0), pa.array(digests, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return shards.mapInArrow(run, schema)


def _digests(ended: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` of rows ``(depth, k1, k2, conv_id)``: identifiers in order, comma-joined, hashed as they pass."""

    def edges(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        keys = [np.asarray(batch.column(k)) for k in range(3)]
        return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))[: batch.num_rows]), keys

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, keys = edges(batch)
            ids = np.asarray(batch.column(3))
            texts = [",".join(map(str, x.tolist())) for x in np.split(ids, start[1:])] if len(start) else []
            yield pa.RecordBatch.from_arrays([*[pa.array(k[start]) for k in keys], pa.array(ids[start]), pa.array(texts, pa.string())], names=[*_NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        emit = lambda key, state: pa.RecordBatch.from_pylist([dict(zip(_NODE, key, strict=True), ends_sha256=state.hexdigest())], schema=out)
        for batch in batches:
            for d, k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (d, k1, k2) != now:
                    if now is not None:
                        yield emit(now, state)
                    now, state = (d, k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if now is not None:
            yield emit(now, state)

    out = pa.schema([*[(c, pa.int64()) for c in _NODE], ("ends_sha256", pa.string())])
    key = "depth long, k1 long, k2 long"
    joined = ended.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInArrow(join, f"{key}, first long, ids string")
    joined = joined.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").select(*_NODE, "ids")
    return joined.mapInArrow(digest, f"{key}, ends_sha256 string")


def _risen(heavy: DataFrame, deepest: int) -> DataFrame:
    """``(depth, k1, k2, p1, p2, n_leaves, saved_tokens)`` with sums over all heavy nodes below, by steps of 1, 2, 4, ... levels."""
    now, step = heavy.withColumns({"a1": F.col("p1"), "a2": F.col("p2")}), 1
    while step <= deepest:
        up = now.where(F.col("depth") >= step).groupBy((F.col("depth") - step).alias("depth"), F.col("a1").alias("k1"), F.col("a2").alias("k2"))
        up = up.agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        above = now.select((F.col("depth") + step).alias("depth"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
        now = now.join(up, _NODE, "left").join(above, ["depth", "a1", "a2"], "left")
        now = now.select(*_NODE, "p1", "p2", more("n_leaves", "more_leaves"), more("saved_tokens", "more_saved"), F.col("b1").alias("a1"), F.col("b2").alias("a2"))
        now = materialize(now, "heavy-sums")
        step *= 2
    return now.drop("a1", "a2")


@dataclass(frozen=True)
class Trie:
    """A trie of prefixes: heavy nodes as rows, all others in packed shards (LOUDS bits and labels), and the prefixes it was made of."""

    heavy: DataFrame
    shards: DataFrame
    paths: DataFrame

    def nodes(self) -> DataFrame:
        """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
        n_heavy, deepest = self.heavy.agg(F.count("*"), F.max("depth")).first()
        light = _unfolded(self.shards)
        columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        if not n_heavy:
            return light.withColumnRenamed("parent", "parent_conv_id").select(*columns)
        light = materialize(light, "light-nodes")
        small = lambda df: F.broadcast(df) if n_heavy <= MOST_BROADCAST else df
        above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
        hung = light.where("parent is null and depth > 0").groupBy(*above).agg(
            F.count("*").alias("tops"), F.sum("n_leaves").alias("top_leaves"), F.sum("saved_tokens").alias("top_saved")
        )
        kids = self.heavy.where("depth > 0").groupBy(*above).agg(F.count("*").alias("kids"))
        none = lambda c: F.coalesce(c, F.lit(0))
        own = self.heavy.join(hung, _NODE, "left").join(kids, _NODE, "left").withColumn("n_children", none("tops") + none("kids"))
        own = own.withColumns({
            "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(none("top_leaves")),
            "saved_tokens": (F.col("n_convs") - 1) * F.col("words") + none("top_saved"),
        })
        own = materialize(own.select(*_NODE, "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "heavy-nodes")
        sums = _risen(own.select(*_NODE, "p1", "p2", "n_leaves", "saved_tokens"), deepest)
        ended = self.paths.where(F.col("depth") == F.col("len")).select(*_NODE, "conv_id").join(small(self.heavy.select(*_NODE)), _NODE, "left_semi")
        names = own.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
        upper = own.drop("n_leaves", "saved_tokens").join(sums.drop("p1", "p2"), _NODE).join(_digests(ended), _NODE, "left")
        upper = upper.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY.hex()))).withColumn("parent", F.lit(None).cast("long"))
        both = light.unionByName(upper.select(*light.columns)).join(small(names), ["depth", "p1", "p2"], "left")
        return both.withColumn("parent_conv_id", F.coalesce("parent", "above")).select(*columns)


def build(turns: DataFrame, heads: int = 4, share: int = 20, limit: int | None = None) -> Trie:
    """The trie of the rebuilt conversations (see :func:`rebuilt`) of ``turns (conv_id, turn, role, text)``.

    Turns are ordered by number (null first), then role and text; null roles and texts are empty; equal rows are turns
    of their own. Rows with a null conv_id take no part. An empty table has no nodes, not even a root. Other columns play no part.
    """
    rows, convs = rebuilt(turns, heads, share)
    paths = materialize(prefixes(rows, convs), "prefixes")
    total = paths.count()
    limit = limit or max(LIMIT, isqrt(total))
    counted = paths.groupBy(*_NODE).agg(
        F.sum(F.col("len") - F.col("depth") + 1).alias("weight"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    heavy = materialize(counted.where(F.col("weight") > limit).drop("weight"), "heavy-prefixes")
    keys = heavy.select(*_NODE)
    light = paths.join(F.broadcast(keys) if heavy.count() <= MOST_BROADCAST else keys, _NODE, "left_anti")
    # A conversation's light prefixes are few, and the shortest is the top of a small subtree.
    light = light.withColumn("top", F.min(F.struct(*_NODE)).over(Window.partitionBy("conv_id")))
    buckets = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(total / BUCKET_TURNS))
    light = light.select(
        "conv_id", "depth", "words", "k1", "k2", "p1", "p2", (F.col("depth") == F.col("len")).alias("last"),
        (F.col("depth") - F.col("top.depth")).alias("level"), F.pmod(F.xxhash64("top"), F.lit(buckets)).alias("bucket"),
    )
    schema = "nodes int, " + ", ".join(f"{c} binary" for c in _SHARD)
    return Trie(heavy, materialize(light.groupBy("bucket").applyInArrow(_pack, schema), "trie-shards"), paths)
