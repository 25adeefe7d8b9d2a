import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from corpus import SCHEMA, WORD, clashing, frame, rows
from pyspark.sql import functions as F

from gridmill.llm import catalog, conversation_trie, exact_topk, periodic_runs

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def plain_runs(words, least=24, turns=3):
    out, n = set(), len(words)
    for p in range(1, n // turns + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, turns * p):
                own = words[i : i + length]
                if not any(own[q:] == own[: length - q] for q in range(1, p)):
                    out.add((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_digest(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    found = plain_runs(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if found else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, milli, sha(listed), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def random_symbols(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(100))]
    if rng.random() < 0.6:
        turn = [rng.randrange(6) for _ in range(rng.randrange(1, 20))]
        words = words[: rng.randrange(50)] + (turn * 60)[: rng.randrange(110)] + words
    return words


@pytest.mark.parametrize("least, turns", [(24, 3), (6, 2), (10, 4)])
def test_runs_of_symbols(monkeypatch, least, turns):
    monkeypatch.setattr(periodic_runs, "PORTION", 50)
    rng = random.Random(least)
    docs = [random_symbols(rng) for _ in range(150)] + [[], [1], [5] * 300, list(range(7)) * 30]
    first = np.cumsum([0, *map(len, docs)])
    row, start, length, period = periodic_runs.runs(np.array(sum(docs, []), np.int64), first, least, turns)
    for k, own in enumerate(docs):
        mine = row == k
        assert list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist())) == plain_runs(own, least, turns)


def test_levels_name_equal_stretches():
    rng = np.random.default_rng(1)
    symbols, first = rng.integers(0, 3, 200), np.array([0, 60, 60, 200])
    document = np.repeat([0, 2], [60, 140])
    for k, name in enumerate(periodic_runs.name_levels(symbols, first)):
        stretch = lambda i, w=1 << k: (*document[i : i + w], *symbols[i : i + w])
        for i in range(200 - (1 << k) + 1):
            twins = [j for j in range(200 - (1 << k) + 1) if j != i and stretch(i) == stretch(j)]
            assert (name[i] >= 0) == bool(twins) and all(name[j] == name[i] for j in twins)


def run_rows():
    rng = random.Random(4)
    data = rows(7)
    for k in range(1000, 1080):
        own = [f"v{x}" for x in random_symbols(rng)]
        data.append((k, rng.choice([" ", "\n", "\t \x0b"]).join(own), "en", "a", 1))
    data += [(5000, "tick tock " * 9000, "en", "a", 1), (5001, "a b c " * 8 + "a", None, None, None)]
    return data + data[-3:]


def test_periodic_runs_query(spark, tmp_path):
    data = run_rows()
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op13_periodic_runs(spark, str(tmp_path))
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"),
        ("runs_sha256", "string"), ("collapsed_sha256", "string"),
    ]
    small = [d for d in data if len(d[1] or "") < 50_000]
    want = sorted((plain_digest(d[0], d[1]) for d in small), key=repr)
    rows_ = [tuple(r) for r in got.collect()]
    assert sorted((r for r in rows_ if r[0] != 5000), key=repr) == want
    assert sum(1 for r in want if r[1]) > 40
    (long,) = {r for r in rows_ if r[0] == 5000}
    assert long[1:5] == (1, 0, 18000, 2) and long[7] == sha("tick tock")


def test_periodic_runs_of_odd_tables(spark):
    got = periodic_runs.collapse(clashing(frame(spark).withColumn("runs", F.lit(1)).withColumn("Collapsed", F.lit(2))))
    assert got.columns[-3:] == ["_runs", "strongest", "_collapsed"]
    for r in got.collect():
        assert (r["_collapsed"] is None) == (r["text"] is None) and (r["strongest"] is None) == (not r["_runs"])
    assert periodic_runs.collapse(frame(spark).where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.collapse(frame(spark), min_turns=1)


# Exact top-k


def plain_topk(data, k=20, every=20):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (i, q) in enumerate(usable):
        if i is None or i % every:
            continue
        score = lambda v, q=q: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v))))
        scored = [(-score(v), j is None, j or 0, j) for n, (j, v) in enumerate(usable) if n != own]
        out += [(i, rank, r[3], -r[0]) for rank, r in enumerate(sorted(scored, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=repr)


def vectors(spark, data, kind="float"):
    return spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>").repartition(4)


def some_vectors(seed, n=300, dims=24, spread=1.0):
    rng = np.random.default_rng(seed)
    data = [(int(rng.integers(-200, 400)), [float(np.float32(x)) for x in rng.normal(0, spread, dims)]) for _ in range(n)]
    hot = data[0][1]
    data += [(int(rng.integers(0, 400)), hot) for _ in range(n // 3)]
    data += [(20, None), (40, [None] * dims), (60, [math.nan] + hot[1:]), (80, [math.inf] + hot[1:]), (None, hot), (None, data[1][1]), (100, hot[:5]), (120, [])]
    return data + data[:4]


@pytest.mark.parametrize("seed, spread", [(0, 0.1), (1, 3.0), (2, 200.0), (3, 1e7)])
def test_topk(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(exact_topk, "BLOCK_COMPONENTS", 700)
    monkeypatch.setattr(exact_topk, "SPAN_BLOCKS", 3)
    monkeypatch.setattr(exact_topk, "BAND_QUERIES", 10)
    data = some_vectors(seed, spread=spread)
    got = exact_topk.search(vectors(spark, data).withColumn("score", F.lit(1)).withColumn("block", F.lit("x")), F.col("vec_id") % 20 == 0)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_topk(data)


@pytest.mark.parametrize("scale", [1e18, 1e300])
def test_topk_of_enormous_numbers(spark, scale):
    rng = np.random.default_rng(0)
    data = [(k, [float(x) for x in rng.normal(0, scale, 5)]) for k in range(60)]
    got = exact_topk.search(vectors(spark, data, "double"), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_topk(data)


def test_topk_prunes(monkeypatch):
    """With a floor from one block, most pairs of the next are given up before their last dimensions."""
    rng = np.random.default_rng(5)
    values = np.floor(64 * rng.normal(size=(64, 4000)) * (0.9 ** np.arange(64))[:, None])
    cuts, order = [*range(0, 64, exact_topk.STEP), 64], np.arange(64)
    kind = np.dtype(np.float64)
    side = exact_topk.Side.of(values, order, cuts, kind)
    queries = exact_topk.Side.of(values[:, :32], order, cuts, kind)
    best = exact_topk.Best(32, 20, kind, 1.0)
    own = (np.arange(32), np.arange(32))
    exact_topk._scan(queries, side, np.arange(4000), own, cuts, best)
    seen = []
    monkeypatch.setattr(exact_topk.Best, "add", lambda self, q, s, i: seen.append(len(q)))
    exact_topk._scan(queries, side, np.arange(4000), own, cuts, best)
    assert seen[0] == 32 * 20


def test_topk_of_few_rows(spark):
    assert exact_topk.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert exact_topk.search(vectors(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert exact_topk.search(vectors(spark, [(1, [1.0]), (2, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
    data = [(20, [1.0]), (21, [0.5]), (22, [])]
    assert sorted(map(tuple, exact_topk.search(vectors(spark, data), F.col("vec_id") % 20 == 0).collect())) == plain_topk(data)


# Conversation trie


def plain_trie(data):
    own = {}
    for c, turn, role, text in data:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, kids = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved, out = {}, {}, []
    for key in sorted(members, key=len, reverse=True):
        own_kids = kids.get(key, [])
        leaves[key] = sum(leaves[x] for x in own_kids) or 1
        saved[key] = sum(saved[x] for x in own_kids) + (len(members[key]) - 1) * (len(WORD.findall(key[-1][1])) if key else 0)
        ends = sorted(c for c in members[key] if len(whole[c]) == len(key))
        above = min(members[key[:-1]]) if key else None
        out.append((min(members[key]), len(key), above, len(members[key]), len(own_kids), leaves[key], saved[key], sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def conversations(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)


def some_conversations(seed):
    rng = random.Random(seed)
    texts = [None, "", "x", "y z", "hello there you", "日本 語", " \n"]
    data = [(rng.choice([None, *range(-30, 60)]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "u", "a"]), rng.choice(texts)) for _ in range(300)]
    data += [(100 + k, i, "u", "same words here") for k in range(40) for i in range(4)]  # copies
    data += [(200, i, "a", f"t{i % 3}") for i in range(250)] + [(201, i, "a", f"t{i % 3}") for i in range(250)]  # long
    return data + data[:5]


@pytest.mark.parametrize("limit", [1, 6, 90, None])
def test_trie(spark, limit):
    data = some_conversations(3)
    odd = conversations(spark, data).withColumn("depth", F.lit("x")).withColumn("piece", F.lit(1.0))
    trie = conversation_trie.build(odd, limit=limit)
    got = trie.nodes()
    assert got.dtypes == [(c, "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(data)
    heavy, light = trie.heavy.count(), trie.shards.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
    assert heavy + light == got.count() and (limit != 6 or min(heavy, light) > 50)


def test_trie_beyond_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "MOST_BROADCAST", 0)
    data = some_conversations(8)
    assert sorted(map(tuple, conversation_trie.build(conversations(spark, data), limit=20).nodes().collect()), key=repr) == plain_trie(data)


def test_trie_of_few_rows(spark):
    assert conversation_trie.build(conversations(spark, [])).nodes().count() == 0
    for data in ([(7, None, None, None)], [(3, 1, "u", "a")] * 3, [(20, 1, "u", "a"), (25, 1, "u", "b c")]):
        for limit in (1, None):
            assert sorted(map(tuple, conversation_trie.build(conversations(spark, data), limit=limit).nodes().collect()), key=repr) == plain_trie(data)


def test_louds():
    parents = [0, 0, 1, 1, 1, 3, 5, 5]  # of nodes 1 to 8, in level order
    louds = conversation_trie.Louds.of(np.bincount(parents, minlength=9), np.array([0, 1, 3, 6, 7, 9]))
    assert "".join(louds.bits.astype(int).astype(str)) == "110" "1110" "0" "10" "0" "110" "0" "0" "0"
    assert louds.parents().tolist() == parents and louds.degrees().tolist() == np.bincount(parents, minlength=9).tolist()
    total = louds.rolled_up(np.ones(9, np.int64))
    plain = np.ones(9, np.int64)
    for k in range(8, 0, -1):
        plain[parents[k - 1]] += plain[k]
    assert total.tolist() == plain.tolist()


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
def test_queries_over_whole_tables(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, catalog.op12_conversation_trie(spark, DATA).collect()), key=repr) == plain_trie(data)
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(map(tuple, catalog.op11_exact_topk(spark, DATA).collect()), key=repr) == plain_topk(data)
