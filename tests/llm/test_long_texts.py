"""Texts longer than a chunk (1 MB) through the operators and stages whose other tests hold none."""

import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
from corpus import frame
from test_mixing_packing_pii import base
from test_rules_and_classifiers import counts
from test_spotsigs import edits

import corpus_pipeline
from gridmill.llm import mixing, packing, pii, quality_rules, spotsigs
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
WORDS = [f"v{k * 7919 % 300_007}" for k in range(250_000)]
LONG = "".join(w + ("\n" if k % 11 == 10 else " ") for k, w in enumerate(WORDS)).strip()


def data():
    short = " ".join(f"s{k} the" for k in range(60))
    return [(1, LONG, "en", "a", len(LONG)), (2, short, "en", "a", len(short)), (3, "the " + LONG[::-1], "en", "b", len(LONG)), (4, "y" * 2_500_000, "en", "b", 1), (5, None, None, None, None)]


def test_counts(spark):
    got = {r[0]: tuple(r[1:]) for r in quality_rules.judge(frame(spark, data()), []).select("doc_id", *quality_rules.COUNTS[:5]).collect()}
    assert got == {d[0]: counts(d[1]) for d in data()}


def test_fingerprints(spark):
    out = spotsigs.edited_and_next(frame(spark, data()))
    rows = {r.doc_id: r for r in out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), F.size("sigs").alias("n"), spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near")).collect()}
    for doc_id, (text, changed, _) in edits(data()).items():
        assert rows[doc_id].n_chars == len(text) and rows[doc_id].sha == hashlib.sha256(changed.encode()).hexdigest()
    # A text without anchors: each word begins a chain (a few of 250,000 share their 32 bits). The last third of it is cut off.
    assert 0 <= len(WORDS) - rows[1].n < 40 and 0.66 < rows[1].near < 0.68


def test_mix(spark):
    out = {r.doc_id: r for r in mixing.mix(frame(spark, data())).collect()}
    assert {k: r.size for k, r in out.items()} == {d[0]: counts(d[1])[0] for d in data()}
    assert all(0 <= r.copies <= 2 for r in out.values())
    longest, targets = max(r.size for r in out.values()), defaultdict(set)
    for r in out.values():
        targets[r.source_size].add(r.target)
    for size, goals in targets.items():
        for goal in goals:
            taken = sum(r.copies * r.size for r in out.values() if r.source_size == size and r.target == goal)
            assert abs(taken - goal) <= longest


def test_pack(spark):
    pieces = packing.pack_documents(frame(spark, data())).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.length, p.doc_tokens))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert sorted(by_doc) == [1, 2, 3, 4, 5]
    for spans in by_doc.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(spans, spans[1:]))
        assert spans[-1][0] + spans[-1][1] == spans[0][2]
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 1024


def test_personal_data(spark):
    found = "mail a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 123-4567. "
    text = found + LONG + " " + found
    without_end = found + "z" * 1_500_000 + " " + found
    r, endless = sorted(pii.digests(frame(spark, [(1, text, None, None, None), (2, without_end, None, None, None)])).collect())
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base(text))
    assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    for row in (r, endless):
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (2, 2, 2, 2)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
def test_stages(spark, tmp_path):
    """A long text and its near copy among the others: the copy goes, the text is packed whole as often as it is taken."""
    long = [(900_001, LONG, "en", "a", len(LONG)), (900_002, LONG.replace(WORDS[125_000], "changed"), "en", "a", len(LONG))]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(frame(spark, long).select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.where("doc_id > 900000"))
    assert [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept[:3]] == [[900_001, 900_002], [900_001, 900_002], [900_001]]
    copies = kept[3].count()
    pieces = kept[4].collect()
    assert sum(p.length for p in pieces) == copies * (pieces[0].doc_tokens if pieces else 0)
