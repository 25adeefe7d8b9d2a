import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus import WORD, clashing, frame, rows

from pyspark.sql import functions as F

from gridmill.llm import language_id, quality_classifier, quality_rules


def counts(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    lines, before = 0, set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in before
            before.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(covered)


def test_counts_against_plain_python(spark):
    data = rows(3) + [(900, "x # y\nx # y\n\nx # y <&>|$%*", "en", "a", 1), (901, "a b c a b c d", None, None, None)]
    got = sorted((tuple(r[:6]) for r in quality_rules.judge(clashing(frame(spark, data)), []).select("doc_id", *quality_rules.COUNTS[:5]).collect()), key=repr)
    assert got == sorted(((d[0], *counts(d[1])) for d in data), key=repr)


def test_base_rules(spark):
    long = " ".join(f"w{k}" for k in range(60))
    data = [(1, long, "", "", 0), (2, "a b " * 40, "", "", 0), (3, "few", "", "", 0), (4, None, "", "", 0)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge(frame(spark, data), []).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False)}


def _labelled(spark, n=400):
    good = lambda k: " ".join(f"word{(k * 31 + j * 7) % 997}" for j in range(80))
    data = [(k, good(k) if k % 4 else good(k).replace("word", "wo##"), "en", "a", 1) for k in range(n)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(n)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    return frame(spark, data), labels


def test_rules_are_learned_and_applied(spark):
    docs, labels = _labelled(spark)
    rules = quality_rules.fit(docs, labels)
    assert rules and any("symbols" in str(r) for r in rules)
    out = quality_rules.judge(docs, rules).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in out)
    kept = quality_rules.filter_documents(clashing(docs), rules)
    assert kept.columns == clashing(docs).columns and {r.doc_id for r in kept.collect()} == {k for k in range(400) if k % 4}


def test_decision_list_covers_in_order():
    rng = np.random.default_rng(0)
    x = rng.random((900, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = quality_rules.learn(x, np.where(bad, 0, 1), ["a", "b", "c"])
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= quality_rules._holds(x, ["a", "b", "c"], r.conditions)
    assert (hit == bad).mean() > 0.97
    assert quality_rules.learn(x, np.ones(900), ["a", "b", "c"]) == []


@pytest.mark.parametrize("empty", ["docs", "labels"])
def test_nothing_to_learn_from(spark, empty):
    docs, labels = _labelled(spark, 40)
    docs, labels = (docs.where("false"), labels) if empty == "docs" else (docs, labels.where("false"))
    assert quality_rules.fit(docs, labels) == []
    model = quality_classifier.fit(docs, labels)
    assert quality_classifier.score(docs, model).where("score < 0 or score > 1 or score is null").count() == 0


def test_classifier_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.score(docs, model).selectExpr("doc_id", "score", "crc32(cast(doc_id as string)) % 3 = 1 as held").collect()
    held = [r for r in out if r.held]
    assert len(held) > 100 and np.mean([(r.score >= 0.5) == (r.doc_id % 4 > 0) for r in held]) > 0.95
    # Labels of the held-out fold play no part: turned around, they change nothing.
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    again = quality_classifier.score(docs, quality_classifier.fit(docs, turned)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in out}


def test_classifier_scores_every_row(spark):
    docs, labels = _labelled(spark, 120)
    model = quality_classifier.fit(docs, labels)
    odd = clashing(frame(spark))
    out = quality_classifier.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)


def test_word_vectors_against_plain_python(spark, monkeypatch):
    data = [(k, t, None, None, None) for k, t in enumerate(["a b a c", "c c b", "", "Zed", "a  zed b", None, "d e f g h d"])]
    texts = frame(spark, data)
    words, _ = quality_classifier.word_vectors(texts)
    at, sign = quality_classifier._index_vectors(quality_classifier.WORD_SLOTS, 1)

    def slot(word):
        (chunk,) = quality_classifier.tokens.chunks(pa.array([word]))
        return int(quality_classifier._slots(chunk)[0][0])

    def index(word):
        out = np.zeros(quality_classifier.DIMENSIONS)
        for a, s in zip(at[slot(word)], sign[slot(word)], strict=True):
            out[a] += s
        return out

    total = {}
    for _, text, *_ in data:
        own = (text or "").lower().split()
        for i, w in enumerate(own):
            for j in range(max(0, i - 2), min(len(own), i + 3)):
                if j != i:
                    total[w] = total.get(w, 0) + index(own[j])
    for w in ["a", "b", "c", "d", "e", "zed", "never"]:
        want = total.get(w, index(w))
        np.testing.assert_allclose(words[slot(w)], want / np.linalg.norm(want), atol=1e-6)
    model = quality_classifier.Model(words, words[: quality_classifier.SHAPE_SLOTS], *([None] * 7))
    (chunk,) = quality_classifier.tokens.chunks(pa.array(["a b a c"]))
    np.testing.assert_allclose(model.pooled(chunk)[0][: quality_classifier.DIMENSIONS], np.mean([words[slot(w)] for w in "abac"], axis=0), atol=1e-6)


def test_learning_from_a_very_long_text_and_repeats(spark):
    docs, labels = _labelled(spark, 60)
    long = " ".join(f"word{k}" for k in range(600_000))
    more = frame(spark, [(2, long, "en", "a", 1)] * 2 + [(3, "again and again", "en", "a", 1)] * 500)
    model = quality_classifier.fit(docs.where("doc_id > 3").unionByName(more), labels)
    assert quality_classifier.score(more, model).where("score between 0 and 1").count() == 502
    assert len(quality_rules.judge(more, quality_rules.fit(docs.unionByName(more), labels)).where("n_words = 600000").collect()) == 2
    langs = language_id.fit(more.withColumn("lang", F.lit("en")).unionByName(frame(spark, list(_tongues(60))).selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars")))
    assert {r.lang_pred for r in language_id.identify(more, langs).where("doc_id = 2").collect()} == {"en"}


LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}


def _tongues(n=300):
    rng = np.random.default_rng(5)
    for k in range(n):
        lang = ["aa", "bb", "cc"][k % 3]
        yield k, " ".join("".join(rng.choice(list(LETTERS[lang]), 5)) for _ in range(20)), lang, "s", 1


def test_languages_are_told_apart(spark):
    data = list(_tongues())
    model = language_id.fit(frame(spark, data))
    out = {r.doc_id: r for r in language_id.identify(frame(spark, data), model).collect()}
    assert all(out[d[0]].lang_pred == d[2] and 0 <= out[d[0]].score <= 1 for d in data)


def test_language_of_odd_texts(spark):
    model = language_id.fit(frame(spark, list(_tongues(90))))
    odd = clashing(frame(spark))
    for r in language_id.identify(odd, model).join(odd.select("doc_id", "text"), "doc_id").collect():
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
    nobody = language_id.fit(frame(spark).where("false"))
    assert language_id.identify(odd, nobody).where("lang_pred <> 'und'").count() == 0


def test_kernel_and_regression_against_plain_python(spark):
    """Kernels by sets of n-grams; weights by a ridge over all learning rows at once; a text's score is the mean of its segments'."""
    data = list(_tongues(30))
    texts = frame(spark, data).select("doc_id", "lang", "text")
    marks, names = language_id.landmarks(texts, 4)
    model = language_id.learn(texts)
    grams = lambda t: {t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)}
    like = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    assert names == ["aa", "bb", "cc"] and marks.shape == (12, language_id.SLOTS)
    by_size = {int(language_id.presence(np.frombuffer(d[1].encode(), np.uint8), np.array([0, len(d[1])])).sum()) for d in data}
    assert {int(m.sum()) for m in marks} <= by_size
    # Every text is short, so a landmark is a text.
    (chunk,) = language_id.tokens.chunks(pa.array([d[1] for d in data]))
    x = language_id.presence(chunk.data, language_id.segments(chunk)[0])
    k = np.array([[like(grams(a[1]), grams(b[1])) for b in data] for a in data])
    # Some 300 n-grams in 8,192 slots: one in thirty falls into a slot that is taken.
    np.testing.assert_allclose(language_id._scaled(x) @ language_id._scaled(x).T, k, atol=0.1)
    lang = np.array([d[2] for d in data])
    target = np.where(lang[:, None] == np.array(names)[None, :], 1.0, -1.0)
    use = np.array([int(language_id.tokens.mix(np.array([d[0]], np.uint64))[0]) % 10 != 9 for d in data])
    values, vectors = np.linalg.eigh(model.landmarks.astype(float) @ model.landmarks.T.astype(float))
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    phi = model.kernel(x).astype(float) @ root
    solved = np.linalg.solve(phi[use].T @ phi[use] + 1e-2 * use.sum() / 100 * np.eye(phi.shape[1]), phi[use].T @ target[use])
    np.testing.assert_allclose(phi @ solved, model.kernel(x) @ model.weights, atol=1e-3)
    assert [names[j] for j in (phi @ solved).argmax(axis=1)] == lang.tolist()


def test_presence_counts_n_grams_once_and_within_segments():
    texts = ["abab", "abc", "a" * 9000, "", "x"]
    (chunk,) = list(language_id.tokens.chunks(pa.array(texts)))
    edges, segment_rows = language_id.segments(chunk)
    x = language_id.presence(chunk.data, edges)
    sizes = [len({t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)}) for t in texts]
    got = [x[segment_rows == k].max(axis=0).sum() for k in range(len(texts))]
    assert got == sizes and (segment_rows == 2).sum() == 3
    assert edges[-1] == len(chunk.data) and re.fullmatch("a+", texts[2])
