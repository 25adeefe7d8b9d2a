"""Connected components of links, by alternating large and small stars.

Each round joins every node to the least node it knows of; rounds are few (about
the logarithm of the number of nodes). Links are kept as a written table between
rounds; nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.store import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of it and its neighbours."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return near.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).distinct()


def _few(edges: DataFrame, found: list) -> DataFrame:
    """The same for edges at hand, by union-find."""
    root: dict = {}

    def find(k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in found:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
    return edges.sparkSession.createDataFrame([(k, find(k)) for k in list(root) if find(k) != k], schema)


def components(edges: DataFrame, rounds: int = 64, few: int = 0) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)`` that is not the least of its component; root is that one.

    Up to ``few`` edges, counted once they are written, are settled on the driver, which saves rounds; more never come there.
    """
    now = materialize(_clean(edges.select("a", "b")), "links")
    if few and now.count() <= few:
        return _few(now, now.collect())
    before = None
    for _ in range(rounds):
        last, now = now, materialize(_clean(_small_star(_clean(_large_star(now)))), "links")
        release(last)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components did not settle")
