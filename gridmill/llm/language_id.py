"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of byte n-grams
(n = 2, 3, 4, any case, other signs as spaces) that both hold, over the
geometric mean of how many each holds; n-grams are hashed into ``SLOTS`` slots, and
those of one slot count as one (a segment of 4 KB fills about a quarter of them). Kernel ridge regression, one language
against the rest, is solved in the space spanned by landmark texts (Nyström).
Long texts are read in segments, all of them, and their scores averaged, so
the presence of n-grams does not saturate. Scoring is two matrix products.

Learning texts stay on the executors: the driver gets landmarks, sums of kernel rows
and of their products, and for each text left out its mean kernel row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm import tokens
from gridmill.llm.frames import id_and_text
from gridmill.llm.ids import in_fold
from gridmill.store import materialize

#: Documents learned from: about so many of a language, and so many in all at most.
MAX_PER_LANGUAGE = 600
MAX_LABELLED = 4_000
LANDMARKS = 96
#: Learning texts lie in at most so many parts, whose sums are added by blocks of so many rows.
SAMPLE_PARTS = 64
GRAM_ROWS = 256
#: So many languages' counts are sent to every executor; more are joined by shuffle.
BROADCAST_LANGUAGES = 10_000
SLOTS = 1 << 13
SEGMENT_BYTES = 4_096
UNKNOWN = "und"
_SUMS = "kind string, part long, first long, lang string, n long, data binary"

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_FOLDED = np.full(256, 0x20, np.uint8)
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)
_FOLDED[0x80:] = np.arange(0x80, 0x100)


def segments(chunk: tokens.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Where segments begin (and the last ends), and the row of each; every row has at least one."""
    sizes = np.diff(chunk.offsets)
    per_row = np.maximum(1, -(-sizes // SEGMENT_BYTES))
    rows = np.repeat(np.arange(chunk.rows), per_row)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    starts = chunk.offsets[rows] + within * sizes[rows] // per_row[rows]
    return np.append(starts, len(chunk.data)), rows


def presence(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which n-gram slots each segment holds, as a matrix of 0 and 1."""
    n = len(edges) - 1
    out = np.zeros(n * SLOTS, np.uint8)
    folded = _FOLDED[data].astype(np.uint32)
    where = np.repeat(np.arange(n), np.diff(edges))
    ends = np.repeat(edges[1:], np.diff(edges))
    code = folded.copy()
    for width in (2, 3, 4):
        if len(folded) < width:
            break
        code = (code[:-1] << np.uint32(8)) | folded[width - 1 :]
        at = np.flatnonzero(np.arange(len(code)) + width <= ends[: len(code)])
        slot = ((code[at].astype(np.uint64) + np.uint64(width << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)
        out[where[at] * SLOTS + slot.astype(np.int64)] = 1
    return out.reshape(n, SLOTS).astype(np.float32)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    sharpness: float

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return _scaled(x) @ self.landmarks.T

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        e = np.exp(self.sharpness * (scores - scores.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, best = [], []
        for chunk in tokens.chunks(texts):
            edges, rows = segments(chunk)
            scores = np.zeros((chunk.rows, len(self.languages)))
            for a in range(0, len(rows), 512):
                b = min(a + 512, len(rows))
                part = self.kernel(presence(chunk.data[edges[a] : edges[b]], edges[a : b + 1] - edges[a])) @ self.weights
                weight = np.maximum(np.diff(edges[a : b + 1]), 1)[:, None]
                np.add.at(scores, rows[a:b], part * weight)
            p = self.probabilities(scores / np.maximum(np.diff(chunk.offsets), 1)[:, None])
            top = p.argmax(axis=1)
            lettered = chunk.count(_LETTERS[chunk.data]) > 0
            pieces = chunk.pieces() if not lettered.all() else []
            for k in range(chunk.rows):
                known = bool(lettered[k]) or any(map(str.isalpha, pieces[k].decode("utf-8", "replace")))
                names.append(self.languages[top[k]] if known else UNKNOWN)
                best.append(float(p[k, top[k]]) if known else 0.0)
        return names, np.array(best)


def _segment_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """By text: identifier, language, the presence matrix of its segments (512 at a time) and their sizes in bytes."""
    ids, langs = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
    for chunk in tokens.chunks(batch.column("text")):
        edges, rows = segments(chunk)
        at = np.searchsorted(rows, np.arange(chunk.rows + 1))
        for k in range(chunk.rows):
            for a in range(at[k], at[k + 1], 512):
                b = min(a + 512, at[k + 1])
                yield ids[chunk.first_row + k], langs[chunk.first_row + k], presence(chunk.data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]), np.maximum(np.diff(edges[a : b + 1]), 1)


def landmarks(texts: DataFrame, each: int) -> tuple[np.ndarray, list[str]]:
    """``each`` segments of each language, picked by hash, and the languages in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[int, bytes]]] = {}
        for batch in batches:
            seen: dict[int, int] = {}
            for doc_id, lang, x, _ in _segment_rows(batch):
                own, first = best.setdefault(lang, []), seen.get(doc_id, 0)
                rank = tokens.mix(tokens.mix(np.full(len(x), doc_id, np.int64).astype(np.uint64)) ^ np.arange(first, first + len(x), dtype=np.uint64))
                own += [(int(r), np.packbits(row.astype(np.uint8)).tobytes()) for r, row in zip(rank >> np.uint64(1), x, strict=True)]
                seen[doc_id] = first + len(x)
                best[lang] = sorted(own)[:each]
        rows = [(lang, *r) for lang, own in best.items() for r in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["lang", "rank", "bits"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "bits"))
    got = texts.mapInArrow(run, "lang string, rank long, bits binary").withColumn("place", place).where(F.col("place") <= each)
    rows = sorted((r.lang, r.rank, bytes(r.bits)) for r in got.collect())
    bits = [np.unpackbits(np.frombuffer(r[2], np.uint8)) for r in rows]
    return np.array(bits, np.float32).reshape(len(rows), SLOTS), sorted({r[0] for r in rows})


def _sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SUMS.split(", ")])


def kernel_sums(texts: DataFrame, model: Model, leave: bool) -> pa.Table:
    """By language the sum and number of its kernel rows, their outer products summed by blocks of ``GRAM_ROWS`` rows, and left texts' mean rows.

    Executors add what their tasks found, in the tasks' order, so the driver gets each sum once. With ``leave``, a tenth of the texts, by hash, is left out of the sums.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        width = len(m.landmarks)
        gram, sums, left, first = np.zeros((width, width)), {}, {}, None
        for batch in batches:
            for doc_id, lang, x, sizes in _segment_rows(batch):
                k = m.kernel(x).astype(float)
                first = doc_id if first is None else min(first, doc_id)
                if leave and int(tokens.mix(np.array([doc_id], np.int64).astype(np.uint64))[0]) % 10 == 9:
                    total, weight = left.get((doc_id, lang), (0.0, 0))
                    left[doc_id, lang] = total + sizes @ k, weight + int(sizes.sum())
                else:
                    gram += k.T @ k
                    total, n = sums.get(lang, (0.0, 0))
                    sums[lang] = total + k.sum(axis=0), n + len(k)
        rows = [("sum", 0, first, lang, n, total.tobytes()) for lang, (total, n) in sorted(sums.items())]
        rows += [("left", doc_id, doc_id, lang, 1, (total / weight).tobytes()) for (doc_id, lang), (total, weight) in sorted(left.items())]
        rows += [("gram", a, first, "", 0, gram[a : a + GRAM_ROWS].tobytes()) for a in range(0, width, GRAM_ROWS)] if sums else []
        yield _sums_batch(rows)

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        kind, part, first, lang = (table[c][0].as_py() for c in ("kind", "part", "first", "lang"))
        total = sum((np.frombuffer(x, float) for x in table["data"].to_pylist()), 0.0)
        return pa.Table.from_batches([_sums_batch([(kind, part, first, lang, sum(table["n"].to_pylist()), total.tobytes())])])

    parts = texts.mapInArrow(run, _SUMS).groupBy("kind", "part", "lang").applyInArrow(lambda t: add(t), _SUMS)
    return parts.toArrow().sort_by([("kind", "ascending"), ("part", "ascending"), ("lang", "ascending")])


def learn(texts: DataFrame, *, ridge: float = 1e-2) -> Model:
    """Kernel ridge regression over ``texts (doc_id, lang, text)``; what is left out sets the sharpness of the probabilities."""
    n_languages = texts.select("lang").distinct().count()
    if not n_languages:
        return Model([UNKNOWN], np.zeros((1, SLOTS), np.float32), np.zeros((1, 1)), 1.0)
    marks, names = landmarks(texts, max(2, LANDMARKS // n_languages))
    model = Model(names, _scaled(marks), np.zeros((1, 1)), 1.0)
    got = kernel_sums(texts, model, leave=True)
    if "sum" not in got["kind"].to_pylist():
        got = kernel_sums(texts, model, leave=False)
    width = len(model.landmarks)
    gram, by_language, n, left, truth = np.zeros((width, width)), np.zeros((len(names), width)), 0, [], []
    for r in got.to_pylist():
        data = np.frombuffer(r["data"], float)
        if r["kind"] == "gram":
            gram[r["part"] : r["part"] + GRAM_ROWS] += data.reshape(-1, width)
        elif r["kind"] == "sum":
            by_language[names.index(r["lang"])] += data
            n += r["n"]
        else:
            left.append(data)
            truth.append(names.index(r["lang"]))
    values, vectors = np.linalg.eigh(model.landmarks.astype(float) @ model.landmarks.T.astype(float))
    keep = values > 1e-6 * values.max() if values.max() > 0 else values > np.inf
    root = vectors[:, keep] / np.sqrt(values[keep])
    # One against the rest: 1 for the language's rows, -1 for all others.
    target = 2 * by_language.T - by_language.sum(axis=0)[:, None]
    model.weights = root @ np.linalg.solve(root.T @ gram @ root + ridge * n / 100 * np.eye(int(keep.sum())), root.T @ target)
    if left:
        scores = np.array(left) @ model.weights

        def loss(s: float) -> float:
            model.sharpness = s
            return float(-np.log(np.maximum(model.probabilities(scores)[np.arange(len(truth)), truth], 1e-12)).mean())

        model.sharpness = float(min(np.geomspace(0.5, 32, 25), key=loss))
    return model


def fit(docs: DataFrame, *, lang: str = "lang", fold: tuple[int, int] | None = (5, 0), per_language: int = MAX_PER_LANGUAGE, limit: int = MAX_LABELLED) -> Model:
    """Learn from about ``per_language`` documents of each language, ``limit`` in all at most, outside the held-out fold.

    Which documents follows from hashes of their identifiers. Null languages and null texts are not learned from;
    of rows that share an identifier and a language the least text is.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )
    if fold:
        rows = rows.where(~in_fold(F.col("doc_id"), *fold))
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if counts.count() <= BROADCAST_LANGUAGES:
        counts = F.broadcast(counts)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(counts, "lang").where(draw < F.lit(float(per_language)) / F.col("n"))
    sample = sample.select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(limit)
    texts = id_and_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).where(F.col("text").isNotNull())
    return learn(materialize(texts.repartition(SAMPLE_PARTS, "doc_id").sortWithinPartitions("doc_id", "lang"), "language-texts"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of ``docs``: doc_id, ``lang_pred`` and ``score``; null texts and texts without a letter are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, best = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
