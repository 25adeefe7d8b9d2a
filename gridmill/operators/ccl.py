"""Connected components of masks, 4-connected; a component's label is its least pixel index + 1.

Images are cut into tiles. Each tile is labelled on its own in one pass over
runs of pixels; components that touch across tile borders are then joined by their border
pixels alone. Images no larger than a tile need no second step. A tile bounds
what one task holds, whatever the image's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.operators.graph import components
from gridmill.shipping import ship
from gridmill.store import materialize

TILE = 512
#: So many pairs of components at tile borders are joined on the driver; more by the distributed operator.
FEW_EDGES = 20_000


def runs_to_roots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pixels sorted by (y, x): the position of the first pixel of each pixel's component."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    new = np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1))
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    # Pixels right below others: their runs belong together.
    key = y.astype(np.int64) * (int(x.max()) + 2) + x
    above = np.searchsorted(key, key - (int(x.max()) + 2))
    touch = (above < n) & (key[np.minimum(above, n - 1)] == key - (int(x.max()) + 2))
    pairs = np.unique(np.stack([run[touch], run[above[touch]]], axis=1), axis=0) if touch.any() else np.zeros((0, 2), np.int64)
    root = np.arange(len(first))
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        while (root[root] != root).any():
            root = root[root]
        pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
    return first[root][run]


def _label_tile(table: pa.Table) -> pa.Table:
    """The rows as they came, with the index of the first pixel of each one's component within the tile."""
    x, y, i = (table[c].to_numpy() for c in ("x", "y", "i"))
    order = np.lexsort((x, y))
    local = np.empty(len(i), np.int64)
    local[order] = i[order][runs_to_roots(x[order], y[order])]
    return table.append_column("local", pa.array(local, pa.int64()))


def label_components(mask: DataFrame, width: int, height: int, tile: int = TILE, by: list[str] | None = None) -> DataFrame:
    """Adds ``label`` to the pixels ``(image_id, [cls], x, y, i, …)`` of a mask.

    ``by`` are the columns within which components lie, ``image_id`` alone unless given. An object that is only the last
    pixel has label ``width * height`` like any other.
    """
    ship(mask.sparkSession)
    by = by or ["image_id"]
    tiled = mask.withColumns({"_tx": F.floor(F.col("x") / tile).cast("int"), "_ty": F.floor(F.col("y") / tile).cast("int")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiled.schema.fields) + ", local long"
    # In a tile the least index is the component's first pixel by (y, x), as indices are row-major.
    labelled = tiled.groupBy(*by, "_tx", "_ty").applyInArrow(_label_tile, schema)
    if width <= tile and height <= tile:
        return labelled.withColumn("label", F.col("local") + 1).drop("_tx", "_ty", "local")
    labelled = materialize(labelled, "tiles")
    node = F.struct(*by, "local")
    at_edge = lambda c, side: (F.col(c) % tile == (tile - 1 if side else 0))
    edges = None
    for axis, other in (("x", "y"), ("y", "x")):
        ends = labelled.where(at_edge(axis, True)).select(*by, (F.col(axis) + 1).alias(axis), other, F.col("local").alias("a"))
        starts = labelled.where(at_edge(axis, False)).select(*by, axis, other, F.col("local").alias("b"))
        pairs = ends.join(starts, [*by, axis, other]).select(F.struct(*by, F.col("a").alias("local")).alias("a"), F.struct(*by, F.col("b").alias("local")).alias("b")).distinct()
        edges = pairs if edges is None else edges.unionByName(pairs)
    # Within one image the tile whose component has the least index names it, and structs compare by image first.
    roots = components(edges, few=FEW_EDGES)
    joined = labelled.withColumn("node", node).join(roots, "node", "left")
    return joined.withColumn("label", F.coalesce(F.col("root.local"), F.col("local")) + 1).drop("_tx", "_ty", "local", "node", "root")


def neighbor_edges(mask: DataFrame) -> DataFrame:
    """Pairs of right and lower neighbours in a mask, by an equality join on shifted places."""
    shifts = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    ahead = mask.withColumn("s", F.explode(shifts)).select("image_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("i").alias("a"))
    return ahead.join(mask.select("image_id", "x", "y", F.col("i").alias("b")), ["image_id", "x", "y"]).select("image_id", "a", "b")


def label_map(pixels: DataFrame, labelled: DataFrame) -> DataFrame:
    """The label of every pixel, 0 for background."""
    return pixels.select("image_id", "i").join(labelled.select("image_id", "i", "label"), ["image_id", "i"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def member(probability: Column, threshold: float = 0.5) -> Column:
    return probability >= threshold


