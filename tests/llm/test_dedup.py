import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import WORD, clashing, frame, order, rows

from gridmill.llm import exchange, line_dedup, ngram_join, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_windows(data, window=20):
    """Each row's words that stay; windows that start earlier are found by a plain table."""
    first = {}
    for doc_id, text, *_ in data:
        words = WORD.findall(text or "")
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            first[key] = min(first.get(key, (1 << 64, 0)), (order(doc_id), p))
    out = []
    for doc_id, text, *_ in data:
        words = WORD.findall(text or "")
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < (order(doc_id), p):
                gone.update(range(p, p + window))
        out.append((doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_substrings(spark, monkeypatch, seed):
    monkeypatch.setattr(exchange, "PARCEL_ITEMS", 700)
    data = rows(seed, vocabulary=200 if seed else 4000)
    data += data[:3]
    got = substring_dedup.dedup(clashing(frame(spark, data)))
    assert sorted(map(tuple, got.collect()), key=repr) == by_windows(data)


def test_substrings_of_no_rows(spark):
    assert substring_dedup.dedup(frame(spark).where("false")).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeats(frame(spark), window=18)


def shingles(text, width=3):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def by_pairs(data, percent=90):
    sets = [shingles(d[1]) for d in data]
    root = list(range(len(data)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 64)
    for k, d in enumerate(data):
        least[find(k)] = min(least[find(k)], order(d[0]))
    name = lambda v: None if v == order(None) else v
    return sorted(((d[0], len(sets[k]), name(least[find(k)])) for k, d in enumerate(data)), key=repr), find


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("group", [256, 4])
def test_join(spark, monkeypatch, seed, group):
    monkeypatch.setattr(exchange, "PARCEL_ITEMS", 900)
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "QUERIES", 3)
    data = rows(seed, n=30)
    got = ngram_join.classes(clashing(frame(spark, data))).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == by_pairs(data)[0]


def test_bound_by_token_unions(spark):
    """Every query that links with a member passes; one that shares less than a link needs with the union does not."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(20, 60)).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.append(s[: len(s) - 1], np.uint64(9000 + k))) for k, s in enumerate(sets[:20])]
    schema = "node long, shingles binary, key long, part int"
    members = [(k, s.tobytes(), k % 4, 0) for k, s in enumerate(sets[:40])]
    asked = [(k, s.tobytes(), g, 0, 0) for k, s in enumerate(sets) for g in range(4)]
    groups = ngram_join.token_groups(spark.createDataFrame(members, schema)).selectExpr("*", "0 as load")
    got = {(r.node, r.key) for r in ngram_join.qualifying(spark.createDataFrame(asked, schema + ", load int"), groups).collect()}
    links = ngram_join.linked(sets, sets[:40])
    want = set()
    for g in range(4):
        union = np.unique(np.concatenate([s for k, s in enumerate(sets[:40]) if k % 4 == g]))
        least = min(len(s) for k, s in enumerate(sets[:40]) if k % 4 == g)
        for k, s in enumerate(sets):
            other = max(least, -(-90 * len(s) // 100))
            if 190 * len(np.intersect1d(s, union)) >= 90 * (len(s) + other):
                want.add((k, g))
    assert got == want and {(int(q), int(m) % 4) for q, m in np.argwhere(links)} <= got < {(k, g) for k in range(60) for g in range(4)}


def test_chains_of_links_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 2)
    words = [f"t{k}" for k in range(400)]
    data = [(100 - s, " ".join(words[s * 8 : s * 8 + 200]), "en", "a", 1) for s in range(20)]
    want, _ = by_pairs(data)
    assert len({w[2] for w in want}) == 1
    assert sorted(map(tuple, ngram_join.classes(frame(spark, data)).select("doc_id", "n_shingles", "component_id").collect()), key=repr) == want


def test_one_of_each_stays(spark):
    data = rows(4, n=30)
    data += data[:2]
    kept = ngram_join.one_of_each(clashing(frame(spark, data)))
    _, find = by_pairs(data)
    groups = defaultdict(list)
    for k, d in enumerate(data):
        if shingles(d[1]):
            groups[find(k)].append(d)
    want = [min((order(d[0]), d[1]) for d in g)[0] for g in groups.values()] + [order(d[0]) for d in data if not shingles(d[1])]
    assert kept.columns == clashing(frame(spark, data)).columns
    assert sorted(order(r.doc_id) for r in kept.collect()) == sorted(want)


def test_join_of_no_rows(spark):
    assert ngram_join.classes(frame(spark).where("false")).count() == 0
    alone = [(1, None, None, None, None), (2, "", "", "", 0)]
    assert sorted(tuple(r)[:3] for r in ngram_join.classes(frame(spark, alone)).collect()) == [(1, 0, 1), (2, 0, 2)]


def by_tree(data, min_docs):
    """The template tree in plain Python; lines of a leaf come by first document."""

    def parse(line):
        words = WORD.findall(line)
        if not words:
            return None
        varies = [any("0" <= c <= "9" for c in w) for w in words]
        toks = tuple("\0" if v and not all(varies) else w for v, w in zip(varies, words, strict=True))
        return (len(toks), *toks[: line_dedup.DEPTH]), toks

    leaves = defaultdict(lambda: defaultdict(set))
    for doc_id, text, *_ in data:
        for line in (text or "").split("\n"):
            if got := parse(line):
                leaves[got[0]][got[1]].add(order(doc_id))
    keeper = {}
    for lines in leaves.values():
        known, members = [], []
        for toks in sorted(lines, key=lambda t: (min(lines[t]), t)):
            agree = [sum(a == b for a, b in zip(k, toks, strict=True)) for k in known]
            best = max(range(len(known)), key=lambda k: (agree[k], -k), default=None)
            if best is not None and agree[best] >= line_dedup.LIKE * len(toks) - 1e-9:
                known[best] = [a if a == b else "\0" for a, b in zip(known[best], toks, strict=True)]
                members[best].append(toks)
            else:
                known.append(list(toks))
                members.append([toks])
        for group in members:
            docs = set().union(*(lines[t] for t in group))
            if len(docs) >= min_docs:
                keeper |= {t: min(docs) for t in group}
    out = []
    for doc_id, text, *_ in data:
        lines = [] if text is None else text.split("\n")
        left = [x for x in lines if not ((p := parse(x)) and keeper.get(p[1], order(doc_id)) != order(doc_id))]
        out.append((doc_id, None if text is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_lines(spark, monkeypatch, seed):
    monkeypatch.setattr(exchange, "PARCEL_ITEMS", 300)
    import random

    rng = random.Random(seed)
    data = [(d[0], d[1] if d[1] is None or len(d[1]) < 30 else d[1] + rng.choice(["\nposted by user %d at noon" % rng.randrange(99), "\nall rights reserved", "\nIn short, not much"]), *d[2:]) for d in rows(seed)]
    got = line_dedup.drop_lines(frame(spark, data).select("doc_id", "text"), 4)
    assert sorted(map(tuple, got.collect()), key=repr) == by_tree(data, 4)
    assert any(r[3] for r in by_tree(data, 4))


def test_lines_keep_columns_and_first_copies(spark):
    data = [(k, f"unique start {chr(97 + k)} here now\nvisited 1{k} times since monday\n", "en", "a", None) for k in range(8)] + [(50, "visited 5 times since monday", None, None, 28)]
    df = clashing(frame(spark, data))
    out = line_dedup.without_recurring(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert 50 not in got and got[0] == (data[0][1], None)
    assert all(got[k][0] == data[k][1].split("\n")[0] + "\n" and got[k][1] == len(got[k][0]) for k in range(1, 8))
    assert line_dedup.drop_lines(df.where("false")).count() == 0


def plain_templates(toks, like):
    """Each line against all templates so far."""
    known, out = [], []
    for line in toks.tolist():
        agree = [sum(a == b for a, b in zip(k, line, strict=True)) for k in known]
        best = max(range(len(known)), key=lambda k: (agree[k], -k), default=None)
        if best is None or agree[best] < like * len(line) - 1e-9:
            best = len(known)
            known.append(list(line))
        known[best] = [a if a == b else 0 for a, b in zip(known[best], line, strict=True)]
        out.append(best)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 12])
@pytest.mark.parametrize("vocabulary", [2, 4, 30])
def test_templates_of_a_leaf(n, vocabulary):
    rng = np.random.default_rng(n)
    toks = rng.integers(0, vocabulary, (400, n)).astype(np.uint32)
    toks[:, :3] = 7
    assert line_dedup.templates(toks).tolist() == plain_templates(toks, line_dedup.LIKE)


def test_large_leaf():
    import time

    rng = np.random.default_rng(0)
    toks = rng.integers(1, 1 << 31, (100_000, 12)).astype(np.uint32)
    toks[:, :3] = 0
    toks[50_000:] = toks[:50_000]
    toks[50_000:, 5] = 3
    began = time.time()
    got = line_dedup.templates(toks)
    assert time.time() - began < 60
    assert (got[:50_000] == np.arange(50_000)).all() and (got[50_000:] == got[:50_000]).all()


@pytest.mark.parametrize("n, vocabulary", [(20, 3), (20, 10), (9, 6), (16, 2)])
def test_frequent_tokens(n, vocabulary):
    rng = np.random.default_rng(n + vocabulary)
    toks = rng.integers(1, vocabulary + 1, (1500, n)).astype(np.uint32)
    toks[:, :3] = 0
    toks[rng.random(toks.shape) < 0.05] = 0
    toks[:, :3] = 0
    toks[700:] = np.where(rng.random((800, n)) < 0.1, rng.integers(0, vocabulary, (800, n)), toks[rng.integers(0, 700, 800)])
    toks[:, :3] = 0
    assert line_dedup.templates(toks).tolist() == plain_templates(toks, line_dedup.LIKE)


@pytest.mark.parametrize("fixed", [0, 14])
def test_large_leaf_of_frequent_tokens(fixed):
    """Lines of 20 tokens from 10 words; or all alike but in 6 places."""
    import time

    rng = np.random.default_rng(0)
    toks = rng.integers(1, 11, (100_000, 20)).astype(np.uint32)
    if fixed:
        toks[:, fixed:] = rng.integers(1, 1 << 30, (100_000, 20 - fixed))
    toks[:, : max(3, fixed)] = 0
    began = time.time()
    line_dedup.templates(toks)
    assert time.time() - began < 60


def test_short_lines_and_lines_of_numbers(spark):
    data = [(k, f"body {'abcdefghij'[k]} stays alone\nLes.\n17 4\n{k} {k}\n\nrow {k} x{k}", "en", "a", 1) for k in range(8)]
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(frame(spark, data).select("doc_id", "text")).collect()}
    assert got[0] == data[0][1]
    # The rows of numbers differ, and "row <any> <any>" is one template.
    assert all(got[k] == f"body {'abcdefghij'[k]} stays alone\n{k} {k}\n" for k in range(1, 8))


def one_record(deal, rows, hashes):
    """What a parcel of documents with these items sends to its buckets, and its directory."""
    parcel = exchange.Parcel(deal)
    n = len(rows)
    keys = {"id": np.arange(n), "tie": np.arange(n), "tie2": np.arange(n)}
    counts = np.array([len(h) for h in hashes])
    parcel.add(keys, counts, np.arange(counts.sum()), np.concatenate(hashes), np.zeros(counts.sum(), bool))
    payload = lambda _, items, some: [items.hashes[items.leaders[some]].tobytes(), items.places[items.leaders[some]].tobytes()]
    return [d for b in parcel.records(payload) for d in b.to_pylist()]


def test_a_hash_of_all_documents_costs_its_bucket_one_item():
    hot = np.array([5 << 32, 9 << 32], np.uint64)
    sizes = []
    for n in (10, 100_000):
        records = one_record(exchange.Deal(4, 1 << 30), range(n), [hot] * n)
        sizes.append(sum(len(x) for r in records if not r["directory"] for x in r["data"]))
        (directory,) = [r["data"] for r in records if r["directory"]]
        followers = exchange.Followers(exchange.unpack_places(directory[-2]), np.frombuffer(directory[-1], np.uint32).astype(np.int64))
        assert (followers.places == np.arange(2, 2 * n)).all() and (followers.leaders == np.arange(2, 2 * n) % 2).all()
        places, after = followers.of(np.array([1]))
        assert (places == np.arange(3, 2 * n, 2)).all() and not after.any()
    assert sizes[0] == sizes[1] == 2 * 16


@pytest.mark.parametrize("batch", [10_000, 25_000, 50_000])
def test_batches_of_any_size(spark, batch):
    passage = " ".join(f"p{k}" for k in range(20))
    data = spark.range(75_000).selectExpr("id as doc_id", f"concat('a', id, ' {passage} b', id) as text").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.n_removed: r["count"] for r in substring_dedup.dedup(data).groupBy("n_removed").count().collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {0: 1, 20: 74_999}


def test_one_very_long_text(spark):
    """Two texts of more than one chunk (1 MB), alike but for a word, and one of one word without end."""
    words = [f"v{k}" for k in range(300_000)]
    long, other = " ".join(words), " ".join(words[:150_000] + ["changed"] + words[150_001:])
    data = [(1, long, "en", "a", 1), (2, other, "en", "a", 1), (3, "x" * 3_000_000, "en", "a", 1)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup(frame(spark, data)).collect()}
    assert got == {1: (300_000, 0), 2: (300_000, 299_999), 3: (1, 0)}
    assert {r.doc_id: r.component_id for r in ngram_join.classes(frame(spark, data)).collect()} == {1: 1, 2: 1, 3: 3}
    lines = [(k, "\n".join([f"{'abcdef'[k]} own {'uvwxyz'[k]} {j}" for j in range(2)] + ["of everyone"] * 100_000), "en", "a", 1) for k in range(6)]
    assert {r.doc_id: r.n_dropped for r in line_dedup.drop_lines(frame(spark, lines).select("doc_id", "text")).collect()} == {0: 0} | dict.fromkeys(range(1, 6), 100_000)


def test_answers_do_not_depend_on_parcels(spark, monkeypatch):
    df = frame(spark, rows(7), parts=1)
    whole = sorted(map(tuple, substring_dedup.dedup(df).collect()), key=repr)
    monkeypatch.setattr(exchange, "PARCEL_ITEMS", 1)
    assert sorted(map(tuple, substring_dedup.dedup(df).collect()), key=repr) == whole
    assert Counter(len(r) for r in whole) == {4: len(whole)}


def test_asks_grow_with_nodes(spark, monkeypatch):
    """Families that share a hot shingle: a query asks few groups, and hot rarest shingles are dealt over parts."""
    asked = {}
    own = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: asked.update({name: own(df, name)}) or asked[name])
    data = [(i * 60 + j, f"x{i} a b c y{j}", None, None, None) for i in range(60) for j in range(60)]
    assert ngram_join.classes(frame(spark, data)).select("component_id").distinct().count() == 3600
    assert asked["queries"].count() <= 2 * 3600
    rows_ = spark.range(1000).selectExpr("id as node", "7L as key", "array(if(id < 900, 1L, id)) as prefix")
    sizes = [r["count"] for r in ngram_join.parted(rows_).groupBy("part").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 3 * ngram_join.GROUP


def test_overlaps_beyond_single_precision():
    many = np.arange(1 << 20, dtype=np.uint64)
    assert ngram_join.overlaps([many], [many[1:]]).tolist() == [[(1 << 20) - 1]]
    assert ngram_join.overlaps([many], [many]).dtype == np.float64
