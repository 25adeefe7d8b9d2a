import numpy as np
import pytest

from gridmill.operators import forest

ONE_TREE = dict(trees=1, min_split=2)


def grow(x, y, **config):
    x = np.array(x, float).reshape(len(y), -1) if len(y) else np.zeros((0, 1))
    return forest.grow_tree(x, np.array(y, np.int64), forest.ForestConfig(**{"trees": 1, **config}))


def predict(nodes, *values):
    at = 0
    while nodes[at][0] >= 0:
        at = nodes[at][2] if values[nodes[at][0]] < nodes[at][1] else nodes[at][3]
    return nodes[at][4]


def test_separable():
    x, y = [1, 2, 3, 8, 9, 10], [0, 0, 0, 1, 1, 1]
    nodes = grow(x, y, depth=5, classes=2)
    assert [predict(nodes, v) for v in x] == y
    assert (predict(nodes, 0), predict(nodes, 100)) == (0, 1)


def test_two_features():
    x, y = [(1, 1), (2, 1), (9, 9), (8, 9), (1, 8), (2, 9)], [0, 0, 1, 1, 0, 0]
    nodes = grow(x, y, depth=6, classes=2)
    assert [predict(nodes, *v) for v in x] == y


def test_layout():
    nodes = grow([1, 2, 8, 9], [0, 0, 1, 1], depth=5, classes=2)
    table = [(0, k, *n) for k, n in enumerate(nodes)]
    slots, roots = forest.to_flat(table)
    assert roots == [0]
    for feature, _, left, right in slots:
        if feature < 0:
            assert left == -1 and right in (-1, -2)
        else:
            assert 0 < left < len(slots) and 0 < right < len(slots)


def test_pure_is_one_leaf():
    nodes = grow([1, 2, 3], [2, 2, 2])
    assert len(nodes) == 1 and predict(nodes, 7) == 2


def test_depth_one():
    nodes = grow([1, 2, 3, 8, 9, 10], [0, 0, 0, 1, 1, 1], depth=1, classes=2)
    assert len(nodes) == 3 and (predict(nodes, 1), predict(nodes, 10)) == (0, 1)


def test_equal_features_do_not_split():
    nodes = grow([5, 5, 5, 5], [0, 0, 1, 1], classes=2)
    assert len(nodes) == 1 and nodes[0][4] == 0


def test_stride():
    assert grow([(5, 1), (5, 2), (5, 8), (5, 9)], [0, 0, 1, 1], classes=2)[0][0] == 1


def test_empty_is_an_error():
    with pytest.raises(ValueError):
        grow([], [])


def brute_split(x, y, classes):
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for thr in (values[:-1] + values[1:]) / 2:
            left = x[:, f] < thr
            impurity = sum(s.mean() * (1 - sum((y[s] == c).mean() ** 2 for c in range(classes))) for s in (left, ~left))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, thr)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_split_is_the_best(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 9, (40, 3)).astype(float), rng.integers(0, 3, 40)
    _, f, thr = brute_split(x, y, 3)
    assert forest._best_split(x, y, 3) == (f, thr)


def rows_of(spark, x, y):
    rows = [(k, *map(float, v), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))]
    names = [f"f{k}" for k in range(len(x[0]))]
    return spark.createDataFrame(rows, "row long, " + ", ".join(f"{n} double" for n in names) + ", cls int"), names


def test_train_and_classify(spark):
    x, y = [(1,), (2,), (3,), (8,), (9,), (10,)], [0, 0, 0, 1, 1, 1]
    samples, names = rows_of(spark, x, y)
    nodes = forest.collect_forest(forest.train(samples, names, forest.ForestConfig(trees=8, classes=2)))
    _, roots = forest.to_flat(nodes)
    assert len(roots) == 8 and roots == sorted(roots)
    out = forest.probabilities(samples, nodes, names, 2).orderBy("row").collect()
    assert all(abs(r.p0 + r.p1 - 1) < 1e-12 for r in out)
    assert nodes == forest.collect_forest(forest.train(samples, names, forest.ForestConfig(trees=8, classes=2)))


def test_visit_bound_and_arrow_agree(spark, monkeypatch):
    x, y = [(1,), (2,), (8,), (9,)], [0, 0, 1, 1]
    samples, names = rows_of(spark, x, y)
    nodes = forest.collect_forest(forest.train(samples, names, forest.ForestConfig(trees=1, depth=1, classes=2)))
    short = forest.probabilities(samples, nodes, names, 2, max_visits=1).collect()
    assert all(r.p0 + r.p1 == 0 for r in short)
    for visits in (None, 1, 2):
        plain = [(r.p0, r.p1) for r in forest.probabilities(samples, nodes, names, 2, visits).orderBy("row").collect()]
        with monkeypatch.context() as m:
            m.setattr(forest, "MOST_EXPRESSION_NODES", 0)
            assert [(r.p0, r.p1) for r in forest.probabilities(samples, nodes, names, 2, visits).orderBy("row").collect()] == plain


def test_shares(spark):
    samples, _ = rows_of(spark, [(0,)] * 4, [0, 0, 1, 1])
    r = forest.class_shares(samples.selectExpr("0 as g", "cls"), "g").first()
    assert (r["gini"], r["pure"], r["majority"]) == (0.5, False, 0)
    samples, _ = rows_of(spark, [(0,)] * 3, [1, 1, 0])
    assert forest.class_shares(samples.selectExpr("0 as g", "cls"), "g").first()["majority"] == 1


def test_train_classify_and_count(spark):
    """Two bright squares on a dark ground, every pixel labelled: two objects of class 1, one of class 0."""
    from gridmill.plans import pipeline

    bright = lambda x, y: (2 <= x < 8 and 2 <= y < 8) or (13 <= x < 19 and 11 <= y < 17)
    grid = [("a", x, y, y * 22 + x, 200.0 if bright(x, y) else 10.0) for y in range(20) for x in range(22)]
    pixels = spark.createDataFrame(grid, "image_id string, x int, y int, i long, v double")
    labels = pixels.selectExpr("image_id", "i", "cast(v > 100 as int) as cls")
    counts = {r.cls: r.objects for r in pipeline.retrain(pixels, labels, 22, 20).collect()}
    assert counts == {0: 1, 1: 2, 2: 0, 3: 0}
    few = pipeline.retrain(pixels, labels.limit(4), 22, 20)
    assert {r.cls: r.objects for r in few.collect()} == {0: 0, 1: 0, 2: 0, 3: 0}


def drawn_samples(spark, n, values, classes, seed):
    rng = np.random.default_rng(seed)
    return rows_of(spark, rng.integers(0, values, (n, 3)) / 7, rng.integers(0, classes, n))


@pytest.mark.parametrize("n, values, ranges, config", [(300, 40, 64, dict(trees=3, depth=3)), (60, 3, 1, dict(trees=1, depth=4, min_split=5))])
def test_levels_give_the_same_forest(spark, monkeypatch, n, values, ranges, config):
    samples, names = drawn_samples(spark, n, values, 3, n)
    config = forest.ForestConfig(classes=3, **config)
    want = forest.collect_forest(forest.train(samples, names, config))
    monkeypatch.setattr(forest, "VALUE_RANGES", ranges)
    monkeypatch.setattr(forest, "MOST_TASK_SAMPLES", 0)
    assert forest.collect_forest(forest.train(samples, names, config)) == want


def test_ranges_lose_no_split(spark):
    samples, names = drawn_samples(spark, 200, 50, 4, 1)
    samples = samples.selectExpr("*", "row % 3 as g")
    want = sorted(map(tuple, forest.best_splits(samples, names, 4, ["g"]).collect()))
    for ranges in (2, 7, 200):
        assert sorted(map(tuple, forest.best_splits(samples, names, 4, ["g"], ranges=forest.value_ranges(samples, names, ranges)).collect())) == want


def test_defaults_of_a_forest():
    assert forest.ForestConfig.of() == forest.ForestConfig.of(0, 0, 0, 0) == forest.ForestConfig(10, 10, 2, 2)
    assert forest.ForestConfig() == forest.ForestConfig(8, 8, 2, 4) and forest.ForestConfig.of(3).trees == 3


def test_numbered(spark):
    from gridmill.plans import pipeline

    rows = spark.createDataFrame([(int(k), f"x{k}") for k in np.random.default_rng(0).permutation(500)], "k int, t string").repartition(7)
    assert all(r.row == r.k and r.t == f"x{r.k}" for r in pipeline.numbered(rows, ["k"]).collect())
    assert pipeline.numbered(rows.where("k < 0"), ["k"]).count() == 0


def test_ranges_are_looked_up_once_and_not_joined(spark):
    """Missing values, one value in most rows, and ranges that start by rows with the counts before them: the same splits, without a join of cells."""
    samples, names = drawn_samples(spark, 200, 50, 4, 2)
    samples = samples.selectExpr("row", "if(row % 3 > 0, 1.5, f0) as f0", "if(row % 11 = 0, null, f1) as f1", "if(row % 7 = 0, double('nan'), f2) as f2", "cls", "row % 3 as g")
    want = sorted(map(repr, forest.best_splits(samples, names, 4, ["g"]).collect()))
    split = forest.best_splits(samples, names, 4, ["g"], ranges=forest.value_ranges(samples, names, 7))
    assert sorted(map(repr, split.collect())) == want
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "split(" not in plan


def test_equal_rows_are_kept_once(spark, monkeypatch):
    samples, names = drawn_samples(spark, 400, 2, 2, 3)
    config = forest.ForestConfig(trees=3, depth=2, classes=2)
    want, sizes = forest.collect_forest(forest.train(samples, names, config)), []

    def counted(df, name, write=forest.materialize):
        out = write(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(forest, "materialize", counted)
    assert forest.collect_forest(forest.train_by_levels(samples, names, config)) == want
    assert max(sizes) <= config.trees * 2**3 * 2
