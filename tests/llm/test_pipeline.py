from pathlib import Path

import pytest
from corpus import clashing, frame, rows

import corpus_pipeline
from gridmill.llm import catalog
from gridmill.operators import graph

DATA = "/root/testdata/sf0.001"


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {k for e in edges for k in e if e[0] != e[1]}
    assert got == {k: find(k) for k in linked if find(k) != k}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
def test_stages_leave_no_tables(spark):
    from gridmill import store

    folder = f"{store.shared_dir(spark)}/gridmill"
    before = set(store.complete_tables(spark, folder))
    assert corpus_pipeline.run(spark, DATA).count() > 0
    left = sorted(name.rsplit("-", 1)[0] for name in set(store.complete_tables(spark, folder)) - before)
    assert left == ["pieces", "stage-mixing"]


def test_near_duplicates_by_five_words(spark):
    words = [f"t{k}" for k in range(200)]
    data = []
    # Of 196 shingles of five words, 19 differ (0.82; of three words 0.84), 22 (0.798) or, one word each, 20 (0.82; of three words 0.89).
    for first, places in ((0, range(90, 105)), (10, range(90, 108)), (20, range(20, 180, 40))):
        own = [f"{first}{w}" for w in words]
        copy = [f"new{k}" if k in places else w for k, w in enumerate(own)]
        data += [(first + 1, " ".join(own), "en", "a", 1), (first + 2, " ".join(copy), "en", "a", 1)]
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, frame(spark, data), DATA)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 11, 12, 21]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
def test_stages_take_odd_tables(spark):
    for docs in (clashing(frame(spark, rows(5))), frame(spark).where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, DATA).collect()


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_run_and_keep_documents(spark, name):
    out = catalog.queries()[name](spark, DATA)
    if "doc_id" not in out.columns:
        assert out.count() > 0  # op11 and op12 read other tables; test_new_operators.py compares their results
        return
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
