"""Quality classifier: random-indexing word vectors, pooled by document, then a two-layer network.

Each word (and each word's shape: case, symbols, digits, length) owns a sparse
ternary index vector given by its hash. A word's vector is the sum of its
neighbours' index vectors over the learning texts, scaled to length one. A
document is the mean of its words' vectors, the mean of its shapes' vectors,
their lengths, its size, and how often words come again; a network of one hidden layer turns that into a
logit, which a temperature fitted on rows left out of learning calibrates.

Words and shapes are known by the slot their hash falls into (``WORD_SLOTS``, ``SHAPE_SLOTS``), so a model's
size does not grow with the vocabulary. Learning texts stay on the executors: the driver gets word
vectors and a pooled vector for each document, both of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import tokens
from gridmill.llm.frames import id_and_text
from gridmill.llm.quality_rules import labelled_sample
from gridmill.store import materialize

#: Labelled documents whose whole texts are read for learning, at most.
MAX_LABELLED = 4_000
WORD_SLOTS = 1 << 15
SHAPE_SLOTS = 1 << 10
DIMENSIONS = 48
_NONZERO = 4
_REACH = 2
HIDDEN = 32

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _sum_to(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def _slots(chunk: tokens.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the words (whatever their case), slots of their shapes, and the first word by row."""
    data = chunk.data
    starts, ends, first = chunk.words()
    small = tokens.RunningHash(tokens.lower_ascii(data)).of(starts, ends)
    level = lambda n: np.minimum(n, 3)
    shape = level((ends - starts) // 3)
    rest = np.zeros(len(starts), np.int32)
    for table in (_UPPER, _LOWER, _DIGIT):
        sums = _sum_to(table[data])
        n = sums[ends] - sums[starts]
        rest += n
        shape = shape * 4 + level(n)
    shape = shape * 4 + level((ends - starts) - rest)
    return (small % np.uint64(WORD_SLOTS)).astype(np.int64), shape % SHAPE_SLOTS, first


def _index_vectors(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each slot's index vector is not zero, and the signs there."""
    key = tokens.mix(np.arange(n * _NONZERO, dtype=np.uint64) + np.uint64(salt << 40) + np.uint64(1))
    at = (key % np.uint64(DIMENSIONS)).astype(np.int64).reshape(n, _NONZERO)
    sign = np.where((key >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).reshape(n, _NONZERO)
    return at, sign


def _add_contexts(total: np.ndarray, slots: np.ndarray, first: np.ndarray, at: np.ndarray, sign: np.ndarray) -> None:
    """Add to each slot's vector the index vectors of its neighbours, itself left out."""
    rows = tokens.row_of(first)
    for step in range(1, _REACH + 1):
        both = np.flatnonzero(rows[step:] == rows[:-step])
        for me, other in ((both, both + step), (both + step, both)):
            cells = (slots[me][:, None] * DIMENSIONS + at[slots[other]]).ravel()
            total += np.bincount(cells, sign[slots[other]].ravel(), total.size).reshape(total.shape)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pool(vectors: np.ndarray, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, vectors.shape[1]), np.float32)
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(vectors[slots], first[:-1][full], axis=0) / counts[full][:, None]
    return out


def _repetition(slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By row: the share of words like the word before, and the share of words seen before in the row."""
    n, rows = len(first) - 1, tokens.row_of(first)
    words = np.maximum(np.diff(first), 1)
    same = rows[1:][(slots[1:] == slots[:-1]) & (rows[1:] == rows[:-1])]
    distinct = np.unique(rows * WORD_SLOTS + slots) // WORD_SLOTS
    seen = np.diff(first) - np.bincount(distinct, minlength=n)
    return np.stack([np.bincount(same, minlength=n) / words, seen / words], axis=1)


#: What a document's pooled vector holds besides the two means.
_SCALARS = 5


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pooled(self, chunk: tokens.Chunk) -> np.ndarray:
        words, shapes, first = _slots(chunk)
        parts = [_pool(self.words, words, first), _pool(self.shapes, shapes, first)]
        lengths = [np.linalg.norm(p, axis=1, keepdims=True) for p in parts]
        return np.hstack([*parts, *lengths, np.log1p(np.diff(first))[:, None], _repetition(words, first)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, texts: pa.Array) -> np.ndarray:
        parts = [self.logits(self.pooled(c)) for c in tokens.chunks(texts)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -40, 40)))


def _train(x: np.ndarray, y: np.ndarray, model: Model, epochs: int, rng: np.random.Generator) -> None:
    """Adam over the log loss, with decay of the weights."""
    p = {"w1": rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, v, t = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    z = (x - model.mean) / model.scale
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 64):
            some = order[at : at + 64]
            a, b = z[some], y[some]
            raw = a @ p["w1"] + p["b1"]
            hidden = np.maximum(raw, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"], -40, 40))) - b) / len(some)
            back = np.outer(error, p["w2"]) * (raw > 0)
            g = {"w1": a.T @ back + 1e-3 * p["w1"], "b1": back.sum(0), "w2": hidden.T @ error + 1e-3 * p["w2"], "b2": error.sum(keepdims=True)}
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p["w1"], p["b1"], p["w2"], float(p["b2"][0])


def word_vectors(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all word and shape slots: the index vectors of neighbours, summed over ``texts (text)``, at length one.

    A task sends the slots it has seen; sums are whole numbers, so their order plays no part.
    """
    index = (_index_vectors(WORD_SLOTS, 1), _index_vectors(SHAPE_SLOTS, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((n, DIMENSIONS)) for n in (WORD_SLOTS, SHAPE_SLOTS)]
        for batch in batches:
            for chunk in tokens.chunks(batch.column(0)):
                w, s, first = _slots(chunk)
                for total, slots, vectors in zip(totals, (w, s), index, strict=True):
                    _add_contexts(total, slots, first, *vectors)
        for kind, total in enumerate(totals):
            seen = np.flatnonzero(total.any(axis=1))
            sums = pa.array([x.tobytes() for x in total[seen].astype(np.int64)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), kind), pa.int32()), pa.array(seen, pa.int32()), sums], names=["kind", "slot", "sums"])

    def add(table: pa.Table) -> pa.Table:
        slots, which = np.unique(table["slot"].to_numpy(), return_inverse=True)
        total = np.zeros((len(slots), DIMENSIONS), np.int64)
        np.add.at(total, which, np.frombuffer(b"".join(table["sums"].to_pylist()), np.int64).reshape(-1, DIMENSIONS))
        return pa.table({"kind": table["kind"].slice(0, 1).take(pa.array(np.zeros(len(slots), np.int64))), "slot": pa.array(slots, pa.int32()), "sums": pa.array([x.tobytes() for x in total], pa.binary())})

    parts = texts.select("text").mapInArrow(run, "kind int, slot int, sums binary").withColumn("block", F.shiftright("slot", 8))
    got = parts.groupBy("kind", "block").applyInArrow(lambda t: add(t), "kind int, slot int, sums binary").toArrow()
    totals = [np.zeros((n, DIMENSIONS)) for n in (WORD_SLOTS, SHAPE_SLOTS)]
    kinds, slots = got["kind"].to_numpy(), got["slot"].to_numpy()
    sums = np.frombuffer(b"".join(got["sums"].to_pylist()), np.int64).reshape(-1, DIMENSIONS)
    for kind, (total, (at, sign)) in enumerate(zip(totals, index, strict=True)):
        total[slots[kinds == kind]] = sums[kinds == kind]
        # What was never seen keeps its own index vector.
        unseen = np.flatnonzero(~total.any(axis=1))
        np.add.at(total, (unseen[:, None], at[unseen]), sign[unseen])
    return _unit(totals[0]), _unit(totals[1])


def fit_network(model: Model, x: np.ndarray, label: np.ndarray, *, epochs: int = 40, seed: int = 7) -> Model:
    """Train on pooled vectors; every fifth is left for the temperature. With one label only, that label is likely everywhere."""
    y = label.astype(float)
    if not len(x):
        model.mean, model.w1, model.b1, model.w2 = np.zeros(2 * DIMENSIONS + _SCALARS), np.zeros((2 * DIMENSIONS + _SCALARS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN)
        return model
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    left_out = np.arange(len(x)) % 5 == 4
    _train(x[~left_out], y[~left_out], model, epochs, np.random.default_rng(seed))
    if left_out.any():
        z, b = model.logits(x[left_out]), y[left_out]
        loss = lambda t: np.logaddexp(0, np.where(b > 0, -z, z) / t).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def fit(docs: DataFrame, labels: DataFrame, *, limit: int = MAX_LABELLED, fold: tuple[int, int] | None = (3, 1)) -> Model:
    """Learn from at most ``limit`` labelled documents outside the held-out fold.

    Null labels and documents without an identifier are not learned from; of rows that share an identifier the
    least text is.
    """
    sample = labelled_sample(labels, limit, fold)
    texts = id_and_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts = materialize(texts, "labelled-texts")
    words, shapes = word_vectors(texts)
    model = Model(words, shapes, np.zeros(1), np.ones(1), np.zeros((1, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled = [x.astype(float).tobytes() for c in tokens.chunks(batch.column("text")) for x in shared.value.pooled(c)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(pooled, pa.binary())], names=["doc_id", "label", "x"])

    rows = texts.mapInArrow(run, "doc_id long, label int, x binary").toArrow()
    ids = rows["doc_id"].to_numpy()
    order = np.lexsort((ids, tokens.mix(ids.astype(np.uint64))))
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), float).reshape(-1, 2 * DIMENSIONS + _SCALARS)
    return fit_network(model, x[order], rows["label"].to_numpy()[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of ``docs``: doc_id and ``score``, the probability of label 1. A null text scores as the empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")
