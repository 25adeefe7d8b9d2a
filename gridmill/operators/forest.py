"""Bagged Gini trees: training, the node table, and inference as one expression.

A forest is a table ``(tree, node, feature, threshold, left, right, cls)``: feature is
-1 at a leaf, nodes are numbered within their tree from the root 0 in the order they are
visited (left first). All ties go to the lowest feature, threshold or class.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.constants import MAX_DEPTH, NUM_CLASSES, NUM_TREES
from gridmill.shipping import ship
from gridmill.store import materialize, release

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, cls int"
#: Above this many nodes expressions give way to an Arrow function: the JVM bounds a method's size.
MOST_EXPRESSION_NODES = 4_000
#: Above this many samples all executors grow the trees together, level by level; up to it a task grows a tree. Both give the same forest.
MOST_TASK_SAMPLES = 500_000
#: Ranges of values that a feature is cut into where executors search for splits together.
VALUE_RANGES = 64


@dataclass(frozen=True)
class ForestConfig:
    trees: int = NUM_TREES
    depth: int = MAX_DEPTH
    min_split: int = 2
    classes: int = NUM_CLASSES

    @classmethod
    def of(cls, trees: int | None = None, depth: int | None = None, min_split: int | None = None, classes: int | None = None) -> ForestConfig:
        """A forest on its own, apart from the application's: what is missing or 0 is 10 trees of depth 10, two rows to split, two classes."""
        return cls(trees or 10, depth or 10, min_split or 2, classes or 2)


# --- bootstrap -----------------------------------------------------------------------------------


def draw(tree: Column, k: Column, n: Column | int) -> Column:
    """The k-th drawn row of a tree: two steps of a linear congruence over 2^31, portable to any SQL."""
    step = lambda s: (s * 1103515245 + 12345) % 2147483648
    seed = (tree.cast("long") * 7919 + k.cast("long") * 104729 + 1) % 2147483648
    return F.floor(step(step(seed)) / 65536) % n


def bootstrap(samples: DataFrame, trees: int, n: int | None = None) -> DataFrame:
    """``(tree, k, row)`` over the ``n`` rows numbered ``row`` from 0; a single tree takes all rows in order."""
    n = samples.count() if n is None else n
    rows = samples.sparkSession.range(n).withColumnRenamed("id", "k").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = F.col("k") if trees == 1 else draw(F.col("tree"), F.col("k"), n)
    return rows.select("tree", "k", drawn.cast("long").alias("row"))


# --- impurity as aggregates ---------------------------------------------------------------------


def class_shares(rows: DataFrame, by: str | list[str], cls: str = "cls", weight: Column | None = None) -> DataFrame:
    """Of each group: size, Gini impurity, purity and majority class. A row counts ``weight`` times, once unless given."""
    by = [by] if isinstance(by, str) else by
    counts = rows.groupBy(*by, cls).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    return counts.groupBy(*by).agg(
        F.sum("n").alias("size"),
        (1 - F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("gini"),
        (F.count("*") == 1).alias("pure"),
        (-F.max(F.struct("n", (-F.col(cls)).alias("c")))["c"]).alias("majority"),
    )


def value_ranges(rows: DataFrame, features: list[str], ranges: int = VALUE_RANGES) -> list[list[float]]:
    """For each feature the values, about evenly far apart in rank, at which ranges of its values begin."""
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = rows.agg(*[F.percentile_approx(f, shares).alias(f) for f in features]).first()
    return [sorted(set(c or ())) or [-float("inf")] for c in cuts]


def in_ranges(rows: DataFrame, features: list[str], ranges: list[list[float]]) -> DataFrame:
    """Adds ``_in``: for each feature the number of the range (of :func:`value_ranges`) that its value lies in."""
    place = lambda f, starts: F.size(F.filter(F.array(*map(F.lit, starts)), lambda start: start <= F.col(f)))
    return rows.withColumn("_in", F.array(*[place(f, r) for f, r in zip(features, ranges, strict=True)]))


def best_splits(rows: DataFrame, features: list[str], classes: int, by: list[str], weight: Column | None = None, ranges: list[list[float]] | None = None) -> DataFrame:
    """For each group its best split ``(feature, threshold, impurity)``; groups with no two different values have none.

    Rows become one for each feature and value with counts by class; running sums give every midpoint's two sides.
    With ``ranges`` (of :func:`value_ranges`), or in rows that come with ``_in`` (of :func:`in_ranges`), sums run within ranges of values, and over the
    few ranges: no task then holds all values of a group's feature. A row counts ``weight`` times, once unless given.
    """
    if ranges is not None and "_in" not in rows.columns:
        rows = in_ranges(rows, features, ranges)
    weight = F.lit(1).cast("long") if weight is None else weight
    every_class = range(classes)
    within = "_in" in rows.columns
    names = ", ".join(f"{k}, `{f}`" + (f", _in[{k}]" if within else "") for k, f in enumerate(features))
    stacked = f"stack({len(features)}, {names}) as (feature, value{', range' if within else ''})"
    long = rows.select(*by, "cls", weight.alias("_weight"), F.expr(stacked))
    counts = [F.sum(F.when(F.col("cls") == c, F.col("_weight")).otherwise(0).cast("long")).alias(f"c{c}") for c in every_class]
    keys = [*by, "feature"]
    cells = long.groupBy(*keys, *(["range"] if within else []), "value").agg(*counts)
    if not within:
        line = Window.partitionBy(*keys).orderBy("value")
        following = F.lead("value").over(line)
        totals = [F.sum(f"c{c}").over(Window.partitionBy(*keys)) for c in every_class]
    else:
        parts = cells.groupBy(*keys, "range").agg(F.min("value").alias("first"), *[F.sum(f"c{c}").alias(f"s{c}") for c in every_class])
        over = Window.partitionBy(*keys).orderBy("range")
        heads = parts.select(
            *keys, "range", F.lit(0).alias("_cell"), F.lit(None).alias("value"), F.lead("first").over(over).alias("beyond"),
            *[F.coalesce(F.sum(f"s{c}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"c{c}") for c in every_class],
            *[F.sum(f"s{c}").over(Window.partitionBy(*keys)).alias(f"a{c}") for c in every_class],
        )
        # A range begins with a row that has the counts of all ranges before it, so sums run on without a join.
        cells = heads.unionByName(cells.withColumn("_cell", F.lit(1)), allowMissingColumns=True)
        line = Window.partitionBy(*keys, "range").orderBy("_cell", "value")
        head = line.rowsBetween(Window.unboundedPreceding, 0)
        following = F.coalesce(F.lead("value").over(line), F.first("beyond").over(head))
        totals = [F.first(f"a{c}").over(head) for c in every_class]
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select(
        *by, "feature", ((F.col("value") + following) / 2).alias("threshold"),
        *[F.sum(f"c{c}").over(upto).alias(f"l{c}") for c in every_class],
        *[totals[c].alias(f"t{c}") for c in every_class],
    ).where(F.col("threshold").isNotNull())
    left = sum((F.col(f"l{c}") for c in every_class), F.lit(0))
    total = sum((F.col(f"t{c}") for c in every_class), F.lit(0))
    cells = cells.withColumns({"nl": left, "nt": total}).withColumn("nr", F.col("nt") - F.col("nl"))
    square = lambda n, d: (n / d) * (n / d)
    gl = sum((square(F.col(f"l{c}"), F.col("nl")) for c in every_class), F.lit(0.0))
    gr = sum((square(F.col(f"t{c}") - F.col(f"l{c}"), F.col("nr")) for c in every_class), F.lit(0.0))
    impurity = (F.col("nl") / F.col("nt")) * (1.0 - gl) + (F.col("nr") / F.col("nt")) * (1.0 - gr)
    best = cells.withColumn("impurity", impurity).groupBy(*by).agg(F.min(F.struct("impurity", "feature", "threshold")).alias("best"))
    return best.select(*by, "best.feature", "best.threshold", "best.impurity")


# --- training -------------------------------------------------------------------------------------


def _best_split(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[int, float] | None:
    n, best, found = len(y), np.inf, None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        cuts = np.flatnonzero(v[1:] != v[:-1])
        if not len(cuts):
            continue
        upto = np.cumsum(np.eye(classes, dtype=np.int64)[y[order]], axis=0)
        left, nl = upto[cuts], cuts + 1
        right, nr = upto[-1] - left, n - nl
        gl = sum((left[:, c] / nl) * (left[:, c] / nl) for c in range(classes))
        gr = sum((right[:, c] / nr) * (right[:, c] / nr) for c in range(classes))
        impurity = (nl / n) * (1.0 - gl) + (nr / n) * (1.0 - gr)
        k = int(np.argmin(impurity))
        if impurity[k] < best:
            best, found = impurity[k], (f, (float(v[cuts[k]]) + float(v[cuts[k] + 1])) / 2)
    return found


def grow_tree(x: np.ndarray, y: np.ndarray, config: ForestConfig) -> list[tuple[int, float, int, int, int]]:
    """Nodes ``(feature, threshold, left, right, cls)``. A split that gains nothing is still taken; no rows are an error."""
    if not len(y):
        raise ValueError("a tree needs at least one labelled row")
    nodes: list[list] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, -1])
        own = y[rows]
        split = None
        if depth < config.depth and len(rows) >= config.min_split and (own != own[0]).any():
            split = _best_split(x[rows], own, config.classes)
        if split is None:
            nodes[at][4] = int(np.argmax(np.bincount(own, minlength=config.classes)))
            return at
        goes_left = x[rows, split[0]] < split[1]
        nodes[at][:2] = split
        nodes[at][2] = build(rows[goes_left], depth + 1)
        nodes[at][3] = build(rows[~goes_left], depth + 1)
        return at

    build(np.arange(len(y)), 0)
    return [tuple(n) for n in nodes]


def train(samples: DataFrame, features: list[str], config: ForestConfig = ForestConfig()) -> DataFrame:
    """The node table of a forest grown from ``(row, features…, cls)``, rows numbered from 0. Features are taken in single precision.

    Samples are painted pixels, commonly a few for each image: a task then grows a tree. More than
    ``MOST_TASK_SAMPLES`` are left where they are, see :func:`train_by_levels`.
    """
    n = samples.count()
    if n > MOST_TASK_SAMPLES:
        return train_by_levels(samples, features, config)
    ship(samples.sparkSession)
    drawn = bootstrap(samples, config.trees, n).join(samples.select("row", *features, "cls"), "row")

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k", kind="stable")
        x = rows[features].to_numpy(np.float32).astype(float)
        nodes = grow_tree(x, rows["cls"].to_numpy(np.int64), config)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "cls"])
        return out.assign(tree=int(key[0]), node=np.arange(len(out)))[["tree", "node", "feature", "threshold", "left", "right", "cls"]]

    return drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def train_by_levels(samples: DataFrame, features: list[str], config: ForestConfig = ForestConfig()) -> DataFrame:
    """The same forest as :func:`train`: all open nodes of all trees are split at once, a round for each level.

    Equal rows drawn by a tree are kept once with their number, and with the ranges of their values, which are looked up once. What comes to the driver is
    the forest itself.
    """
    spark = samples.sparkSession
    samples = samples.select("row", *[F.col(f).cast("float").cast("double").alias(f) for f in features], "cls")
    drawn = bootstrap(samples, config.trees).groupBy("tree", "row").agg(F.count("*").alias("weight")).join(samples, "row")
    rows = drawn.groupBy("tree", *features, "cls").agg(F.sum("weight").alias("weight"))
    rows = in_ranges(rows, features, value_ranges(samples, features, VALUE_RANGES))
    kept = [*features, "_in", "cls", "weight"]
    rows = materialize(rows.select("tree", F.lit(1).cast("long").alias("node"), *kept), "forest-rows")
    by, weight = ["tree", "node"], F.col("weight")
    levels: list[dict[tuple[int, int], tuple[int, float, int]]] = []
    for depth in range(config.depth + 1):
        nodes = {(r.tree, r.node): r for r in class_shares(rows, by, weight=weight).collect()}
        best = best_splits(rows, features, config.classes, by, weight).collect() if depth < config.depth else []
        split = {(r.tree, r.node): r for r in best}
        level = {}
        for key, node in nodes.items():
            found = split.get(key) if not node["pure"] and node["size"] >= config.min_split else None
            level[key] = (-1, 0.0, node["majority"]) if found is None else (found["feature"], found["threshold"], -1)
        levels.append(level)
        splits = [(t, n, f, v) for (t, n), (f, v, _) in levels[-1].items() if f >= 0]
        if not splits:
            break
        chosen = rows.join(F.broadcast(spark.createDataFrame(splits, "tree int, node long, feature int, threshold double")), by)
        value = F.element_at(F.array(*features), F.col("feature") + 1)
        child = F.col("node") * 2 + F.when(value < F.col("threshold"), 0).otherwise(1)
        last, rows = rows, materialize(chosen.select("tree", child.alias("node"), *kept), "forest-rows")
        release(last)
    release(rows)
    return spark.createDataFrame(_in_order({k: v for level in levels for k, v in level.items()}), NODE_SCHEMA)


def _in_order(found: dict[tuple[int, int], tuple[int, float, int]]) -> list[Node]:
    """Nodes known by path (the root 1, below n the nodes 2n and 2n + 1), numbered in the order they are visited."""
    out: list[list] = []
    for tree in sorted({t for t, _ in found}):
        first, waiting = len(out), [(1, None)]
        while waiting:
            path, above = waiting.pop()
            at = len(out) - first
            if above is not None:
                out[first + above][5 if path % 2 else 4] = at
            feature, threshold, cls = found[tree, path]
            out.append([tree, at, feature, threshold, -1, -1, cls])
            if feature >= 0:
                waiting += [(2 * path + 1, at), (2 * path, at)]
    return [tuple(n) for n in out]


# --- inference ------------------------------------------------------------------------------------

Node = tuple[int, int, int, float, int, int, int]


def collect_forest(nodes: DataFrame) -> list[Node]:
    """A trained forest is small: at most trees * 2^(depth + 1) nodes."""
    return sorted(tuple(r) for r in nodes.collect())


def _by_tree(forest: Sequence[Node]) -> list[dict[int, Node]]:
    trees: dict[int, dict[int, Node]] = {}
    for n in forest:
        trees.setdefault(n[0], {})[n[1]] = n
    return [trees[t] for t in sorted(trees)]


def _ballot(tree: dict[int, Node], features: list[str], bits: int, max_visits: int | None) -> Column:
    """A tree's vote as nested conditions: 1 in the class's field of ``bits`` bits, 0 where ``max_visits`` nodes reach no leaf."""

    def at(node: int, visits: int) -> Column:
        _, _, feature, threshold, left, right, cls = tree[node]
        if max_visits is not None and visits > max_visits:
            return F.lit(0).cast("long")
        if feature < 0:
            return F.lit(1 << bits * cls).cast("long")
        return F.when(F.col(features[feature]) < threshold, at(left, visits + 1)).otherwise(at(right, visits + 1))

    return at(0, 1)


def probabilities(rows: DataFrame, forest: Sequence[Node], features: list[str], classes: int = NUM_CLASSES, max_visits: int | None = None) -> DataFrame:
    """Adds ``p0 …``: the share of trees that vote for each class, the number of trees being the denominator.

    Votes are counted in the fields of one number, so each tree is walked once. Forests whose counts do not
    fit one, or with too many nodes for generated code, are walked in Arrow batches.
    """
    trees = _by_tree(forest)
    bits = len(trees).bit_length()
    if len(forest) > MOST_EXPRESSION_NODES or bits * classes > 62:
        return probabilities_by_arrow(rows, forest, features, classes, max_visits)
    votes = rows.withColumn("_votes", sum((_ballot(t, features, bits, max_visits) for t in trees), F.lit(0).cast("long")))
    field = lambda c: F.shiftright("_votes", bits * c).bitwiseAND(F.lit((1 << bits) - 1))
    return votes.withColumns({f"p{c}": field(c) / float(len(trees)) for c in range(classes)}).drop("_votes")


def probabilities_by_arrow(rows: DataFrame, forest: Sequence[Node], features: list[str], classes: int = NUM_CLASSES, max_visits: int | None = None) -> DataFrame:
    """The same in Arrow batches, all rows of a batch a step at a time."""
    ship(rows.sparkSession)
    tables = []
    for tree in _by_tree(forest):
        ordered = [tree[k] for k in range(len(tree))]
        tables.append([np.array([n[c] for n in ordered]) for c in (2, 3, 4, 5, 6)])

    @F.pandas_udf("array<double>")
    def walk(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], axis=1)
        votes = np.zeros((len(x), classes))
        for feature, threshold, left, right, cls in tables:
            node, visits = np.zeros(len(x), np.int64), 1
            while (feature[node] >= 0).any() and (max_visits is None or visits < max_visits):
                inner = feature[node] >= 0
                here = node[inner]
                less = x[np.flatnonzero(inner), feature[here]] < threshold[here]
                node[inner] = np.where(less, left[here], right[here])
                visits += 1
            leaf = feature[node] < 0
            np.add.at(votes, (np.flatnonzero(leaf), cls[node[leaf]]), 1.0)
        return pd.Series(list(votes / len(tables)))

    return rows.withColumn("_p", walk(*features)).select("*", *[F.col("_p")[c].alias(f"p{c}") for c in range(classes)]).drop("_p")


def node_counts(rows: DataFrame, forest: Sequence[Node], features: list[str]) -> DataFrame:
    """``(tree, node, reached)``: how many rows come by each node; 0 where none does.

    Rows are counted by leaf, trees together and before the shuffle; a node's count is the sum of those of the leaves below it. A forest of more than
    ``MOST_EXPRESSION_NODES`` nodes is an error.
    """
    if len(forest) > MOST_EXPRESSION_NODES:
        raise ValueError(f"{len(forest)} nodes, more than an expression takes")

    def leaf(tree: dict[int, Node], node: int) -> Column:
        _, _, feature, threshold, left, right, _ = tree[node]
        return F.lit(node) if feature < 0 else F.when(F.col(features[feature]) < threshold, leaf(tree, left)).otherwise(leaf(tree, right))

    def below(tree: dict[int, Node], node: int) -> list[int]:
        _, _, feature, _, left, right, _ = tree[node]
        return [node] if feature < 0 else below(tree, left) + below(tree, right)

    trees = _by_tree(forest)
    ends = F.array(*[F.struct(F.lit(t[0][0]).alias("tree"), leaf(t, 0).alias("leaf")) for t in trees])
    counted = rows.select(F.explode(ends).alias("at")).groupBy("at.tree", "at.leaf").agg(F.count("*").alias("rows"))
    pairs = rows.sparkSession.createDataFrame([(t[0][0], n, end) for t in trees for n in t for end in below(t, n)], "tree int, node int, leaf int")
    return pairs.join(counted, ["tree", "leaf"], "left").groupBy("tree", "node").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("reached"))


def to_flat(forest: Sequence[Node]) -> tuple[list[tuple[int, float, int, int]], list[int]]:
    """Four slots a node (feature, threshold, left, right or -(class + 1)) and each tree's first node."""
    slots: list[tuple[int, float, int, int]] = []
    roots = []
    for tree in _by_tree(forest):
        first = len(slots)
        roots.append(first)
        for k in range(len(tree)):
            _, _, feature, threshold, left, right, cls = tree[k]
            slots.append((-1, 0.0, -1, -(cls + 1)) if feature < 0 else (feature, threshold, first + left, first + right))
    return slots, roots


def case_text(tree: dict[int, Node], features: list[str]) -> str:
    """A tree as SQL text."""

    def at(node: int) -> str:
        _, _, feature, threshold, left, right, cls = tree[node]
        return str(cls) if feature < 0 else f"CASE WHEN {features[feature]} < {threshold!r} THEN {at(left)} ELSE {at(right)} END"

    return at(0)


def forest_text(forest: Sequence[Node], features: list[str], classes: int = NUM_CLASSES) -> str:
    """The class shares as SQL select items."""
    votes = [f"({case_text(t, features)})" for t in _by_tree(forest)]
    return ", ".join(f"({' + '.join(f'CASE WHEN {v} = {c} THEN 1 ELSE 0 END' for v in votes)}) / {float(len(votes))!r} AS p{c}" for c in range(classes))
