import random
import re

import numpy as np
import pyarrow as pa

from gridmill.llm import exchange, tokens

WORD = re.compile(b"[^\x20\x09-\x0d]+")


def test_words_hashes_and_windows():
    rng = random.Random(1)
    texts = [None, "", "a", " a  b ", "日本 語\x0bé", *["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(200))) for _ in range(60)]]
    seen = {}
    for limit in (1, 50, 1 << 20):
        at = 0
        for chunk in tokens.chunks(pa.array(texts), limit):
            assert chunk.first_row == at
            at += chunk.rows
            starts, ends, first = chunk.words()
            hashes = chunk.running_hash().of(starts, ends)
            runs, places = tokens.windows(hashes, first, 3)
            row3 = np.searchsorted(first, places, "right") - 1
            for k in range(chunk.rows):
                words = WORD.findall((texts[chunk.first_row + k] or "").encode())
                mine = slice(first[k], first[k + 1])
                assert [chunk.data[a:b].tobytes() for a, b in zip(starts[mine], ends[mine])] == words
                for w, h in zip(words, hashes[mine].tolist(), strict=True):
                    assert seen.setdefault(w, h) == h
                grams = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
                for g, h in zip(grams, runs[row3 == k].tolist(), strict=True):
                    assert seen.setdefault(g, h) == h
        assert at == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_sliced_arrays_and_no_rows():
    texts = pa.array(["x y", None, "z", "w w w"])
    counts = [int(n) for c in tokens.chunks(texts.slice(1)) for n in np.diff(c.words()[2])]
    assert counts == [0, 1, 3]
    assert list(tokens.chunks(pa.array([], pa.string()))) == []


def test_places_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (500, 600), (300, 10**8), (3, 200_000)):
        places = np.sort(rng.choice(top, min(n, top), replace=False)) if n else np.zeros(0, np.int64)
        assert (exchange.unpack_places(exchange.pack_places(places)) == places).all()
    edge = np.array([0, 65533, 65534, 65535, 131069, 131070, 262139])
    assert (exchange.unpack_places(exchange.pack_places(edge)) == edge).all()
