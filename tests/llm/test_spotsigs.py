import hashlib

import pytest
from corpus import clashing, frame, order, rows
from pyspark.sql import functions as F

from gridmill.llm import catalog, spotsigs


def edits(data):
    """The contract's edited texts, next rows by descending identifier; identifiers are unique here."""
    ordered = sorted(data, key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = {}
    for k, d in enumerate(ordered):
        text, after = d[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(text) // 3
        out[d[0]] = (text, text[: len(text) - n] + after[:n], after)
    return out


@pytest.mark.parametrize("far", [False, True])
@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_next_and_edited(spark, bucket_rows, far, monkeypatch):
    import functools

    data = [d for d in rows(0) if d[0] is not None]
    if far:
        data[:4] = [((1 << 63) - 1, *data[0][1:]), ((1 << 63) - 2, *data[1][1:]), (-(1 << 63), *data[2][1:]), (-5, *data[3][1:])]
    data = data + [(None, "the last one of all", None, None, None)]
    monkeypatch.setattr(spotsigs, "with_next", functools.partial(spotsigs.with_next, bucket_rows=bucket_rows))
    out = spotsigs.edited_and_next(clashing(frame(spark, data)))
    got = {r.doc_id: r for r in out.select("*", F.sha2("edited", 256).alias("sha")).collect()}
    want = edits(data)
    prints = {r.doc_id: r.sigs for r in got.values()}
    assert len(got) == len(data) == out.count()
    ordered = sorted(data, key=lambda d: (d[0] is None, -(d[0] or 0)))
    for k, d in enumerate(ordered):
        r = got[d[0]]
        assert r.n_chars == len(want[d[0]][0]) and r.sha == hashlib.sha256(want[d[0]][1].encode()).hexdigest()
        assert r.next_sigs == prints[ordered[(k + 1) % len(ordered)][0]]


@pytest.mark.parametrize("ids", ["clustered", "null", "one", "third", "far"])
def test_buckets_are_small_and_in_order(spark, ids, monkeypatch):
    """Whatever the identifiers, no bucket holds many rows, and buckets follow (doc_id, hash of the text)."""
    monkeypatch.setattr(spotsigs, "_CELLS", 8)
    import random

    rng = random.Random(3)
    of = {
        "clustered": lambda k: (k % 5 << 40) + k // 5, "null": lambda k: None, "one": lambda k: 7, "third": lambda k: 500 if k % 3 else k,
        "far": lambda k: rng.choice([-1, 1]) * ((1 << 63) - 1 - k),
    }[ids]
    data = [(of(k), f"text {k}", None, None, None) for k in range(3000)]
    got = spotsigs._placed(frame(spark, data).select("doc_id", "text"), 20).collect()
    sizes = {}
    for r in got:
        sizes[r.bucket] = sizes.get(r.bucket, 0) + 1
    # At the ends of their range identifiers differ by less than a double tells.
    assert len(got) == 3000 and (ids == "far" or max(sizes.values()) <= 120)
    got.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    assert [r.bucket for r in got] == sorted(r.bucket for r in got) and [r.cell for r in got] == sorted(r.cell for r in got)
    rows_, order_by = spotsigs.with_next(frame(spark, data).select("doc_id", "text"), 20)
    after = {r.text: r.after for r in rows_.withColumn("after", F.lead("text").over(order_by)).where("not guest").collect()}
    got.reverse()
    assert len(after) == 3000 and all(after[r.text] == got[(k + 1) % 3000].text for k, r in enumerate(got))


def plain(text):
    """Signatures as tuples, by the rule in words."""
    import re

    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    content = [(k, w) for k, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out, last = set(), None
    for k, w in enumerate(words):
        ahead = [c for j, c in content if j >= k]
        if w in spotsigs.ANCHORS:
            last = k
            if ahead:
                out.add((w, *(ahead + [""] * 2)[:2]))
        elif last is None or k - last > spotsigs.REACH:
            out.add((ahead + [""] * 3)[0:3] and tuple((ahead + [""] * 3)[:3]))
    return out or {(w,) for w in words}


def test_signatures_against_plain_python(spark):
    data = [(k, t, None, None, None) for k, t in enumerate([
        "the quick brown fox and the lazy dog", "Fox, the. The fox! the", "and the of", "", "one two three four five six seven the eight", "a", "no anchors here whatsoever friend",
        "the one two three four five six seven eight nine and ten",
    ])]
    got = spotsigs.with_signatures(frame(spark, data), "text", "sigs").collect()
    for r in got:
        assert len(r.sigs) == len(plain(r.text)), r.text
    hash_of = {}
    for r in got:
        for other in got:
            shared = len(set(r.sigs) & set(other.sigs))
            assert shared == len(plain(r.text) & plain(other.text)), (r.text, other.text)
    assert hash_of == {}


def test_likeness(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], []), ([1], list(range(1, 30)))], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(spotsigs.likeness(F.col("a"), F.col("b"), 0.1)).collect()] == [0.5, 1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(spotsigs.likeness(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 1 / 29]


def test_short_text_quoted_in_a_long_one(spark, tmp_path):
    words = [f"c{k}x" for k in range(2000)]
    frame(spark, [(1, " ".join(words), "en", "a", 1), (2, " ".join(words[:60]), "en", "a", 1)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.near_next for r in catalog.op3_spotsigs(spark, str(tmp_path)).collect()}
    # Of 60 and 2000 chains, those at the end of the short text are cut off.
    assert got == {1: pytest.approx(58 / 2002), 2: pytest.approx(58 / 2002)}


@pytest.mark.parametrize("seed", [0, 1])
def test_near_classes(spark, seed):
    data = rows(seed, n=30)
    sigs = [set(r.sigs) for r in sorted(spotsigs.with_signatures(frame(spark, [(k, d[1] or "", *d[2:]) for k, d in enumerate(data)]), "text", "sigs").collect(), key=lambda r: r.doc_id)]
    root = list(range(len(data)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(data)):
        for b in range(a):
            if sigs[a] & sigs[b] and len(sigs[a] & sigs[b]) >= 0.8 * len(sigs[a] | sigs[b]):
                root[find(a)] = find(b)
    least = {}
    for k, d in enumerate(data):
        least[find(k)] = min(least.get(find(k), 1 << 64), order(d[0]))
    want = [(d[0], len(sigs[k]), None if least[find(k)] == order(None) else least[find(k)]) for k, d in enumerate(data)]
    got = [tuple(r) for r in spotsigs.near_classes(clashing(frame(spark, data))).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_rows_and_one_row(spark):
    assert spotsigs.edited_and_next(frame(spark).where("false")).count() == 0
    one = spotsigs.edited_and_next(frame(spark, [(7, "abcdef", None, None, None)])).first()
    assert one.edited == "abcdab" and one.next_sigs == one.sigs
