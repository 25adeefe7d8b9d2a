"""Small corpora for the tests: prose of invented words, copies, edits, odd texts, and odd tables around them."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "a b", "Ab aB", "tab\tand\x0bbreak\x0cs", "nb sp  line", "日本語 テキスト", "é è ê", "🙂 🙃 🙂", "0123 456", "x" * 5000, "same " * 400,
]


def prose(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.08 else " ") for w in words).strip()


def edited(rng, text, share):
    words = text.split(" ")
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def rows(seed=0, n=60, words=120, vocabulary=4000):
    """Documents with exact copies, near copies of many degrees, shared passages, odd texts and nulls in every column."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(5, words), vocabulary) for _ in range(n)]
    passage = prose(rng, 30, vocabulary)
    texts += [rng.choice(texts[:n]) for _ in range(n // 4)]
    family = prose(rng, 90, vocabulary)
    texts += [edited(rng, family, s) for s in (0.01, 0.02, 0.02, 0.03, 0.05, 0.1) for _ in range(3)] + [family]
    texts += [f"{prose(rng, 20, vocabulary)} {passage} {prose(rng, 15, vocabulary)}" for _ in range(8)]
    texts += [prose(rng, 3000, 50)] + ODD_TEXTS
    rng.shuffle(texts)
    out = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), len(t) if t else 0) for k, t in enumerate(texts)]
    return [*out, (None, texts[0], None, None, None), (None, "only here " * 12, "en", "b", 1)]


def frame(spark, data=None, seed=0, parts=3, **more):
    return spark.createDataFrame(rows(seed, **more) if data is None else data, SCHEMA).repartition(parts)


def clashing(df):
    """The same rows with extra columns called like those that operators make."""
    for name in ("score", "id", "tie", "tie2", "n_words", "label", "places", "lines", "kept", "n_lines", "n_dropped", "size", "copies", "node", "bucket", "sigs", "key_id", "mix_id"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


def order(doc_id):
    return (1 << 63) - 1 if doc_id is None else doc_id
