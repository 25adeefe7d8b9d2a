"""Quality rules: a decision list learned from labelled text statistics.

Sequential covering grows one conjunction of thresholds at a time for the label
0 (by FOIL's gain on two thirds of the rows), prunes its last conditions on the
other third, keeps it if it is precise there, and removes what it covers. The
list becomes one ordered Spark conditional expression; what no rule covers is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.llm import tokens
from gridmill.llm.frames import fresh, id_and_text, with_batch_columns
from gridmill.llm.ids import in_fold

#: Labelled documents whose statistics are gathered for learning, at most.
MAX_LABELLED = 20_000
#: Base rules: fewest words, and most percent of words in repeated 3-word windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks", "n_letters",
]


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SYMBOLS = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _table("0123456789")
_MARKS = _table("!?=;{}[]\"")
_LETTERS = _UPPER | _table("abcdefghijklmnopqrstuvwxyz")
_LETTERS[0xC0:] = True


def _in_row(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The keys, made different from row to row."""
    return tokens.mix(keys ^ tokens.mix(rows.astype(np.uint64) + np.uint64(1)))


def _chunk_counts(chunk: tokens.Chunk) -> np.ndarray:
    data, rows = chunk.data, chunk.rows
    inside = ~tokens.SEPARATOR[data]
    starts, ends, first = chunk.spans(inside)
    hashes = chunk.running_hash()
    out = np.zeros((len(COUNTS), rows), np.int64)
    out[0] = np.diff(first)
    out[1] = chunk.count(inside & ~tokens.CONTINUES[data])
    out[2] = chunk.count(_SYMBOLS[data])
    # Lines with a word, less the different ones among them.
    line_starts, line_ends, line_first = chunk.spans(data != 10)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_rows = tokens.row_of(line_first)[has_word]
    line_keys = _in_row(hashes.of(line_starts[has_word], line_ends[has_word]), line_rows)
    once = np.unique(line_keys, return_index=True)[1]
    out[5] = np.bincount(line_rows, minlength=rows)
    out[3] = out[5] - np.bincount(line_rows[once], minlength=rows)
    # Words in 3-word windows that come twice or more in their text.
    word_rows = tokens.row_of(first)
    keys, at = tokens.windows(hashes.of(starts, ends), first, 3)
    keys = _in_row(keys, word_rows[at])
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1] if len(keys) else False
    twice = at[order[same[1:] | same[:-1]]]
    out[4] = np.bincount(word_rows[tokens.covered(len(starts), twice, 3)], minlength=rows)
    for k, flags in ((6, _UPPER), (7, _DIGITS), (8, _MARKS), (9, _LETTERS)):
        out[k] = chunk.count(flags[data])
    return out


def text_counts(texts: pa.Array) -> list[pa.Array]:
    """The counts named in ``COUNTS``, one array each; a null text counts as empty."""
    parts = [_chunk_counts(c) for c in tokens.chunks(texts)]
    whole = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
    return [pa.array(x, pa.int64()) for x in whole]


def with_counts(docs: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    return with_batch_columns(docs, text, [T.StructField(names[k], T.LongType(), False) for k in COUNTS], text_counts)


def features(names: dict[str, str] | None = None) -> dict[str, Column]:
    """What the learned conditions speak about, as expressions over the counts."""
    c = {k: F.col((names or {}).get(k, k)).cast("double") for k in COUNTS}
    per = lambda a, b: a / F.greatest(b, F.lit(1.0))
    return {
        "words": c["n_words"],
        "word_length": per(c["word_chars"], c["n_words"]),
        "symbols_per_word": per(c["n_symbols"], c["n_words"]),
        "marks_per_word": per(c["n_marks"], c["n_words"]),
        "upper_share": per(c["n_upper"], c["n_letters"]),
        "digits_per_word": per(c["n_digits"], c["n_words"]),
        "dup_line_share": per(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": per(c["n_repeat_words"], c["n_words"]),
        "words_per_line": per(c["n_words"], c["n_lines"]),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the document is rejected."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))

    def column(self, over: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & ((over[c.feature] >= c.threshold) if c.above else (over[c.feature] < c.threshold))
        return out


def _holds(x: np.ndarray, names: list[str], conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in conditions:
        v = x[:, names.index(c.feature)]
        out &= (v >= c.threshold) if c.above else (v < c.threshold)
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The threshold with the highest FOIL gain over the rows still covered."""
    p0, n0 = bad.sum(), (~bad).sum()
    best: tuple[float, Condition | None] = (0.0, None)
    before = np.log2(max(p0, 1e-9) / (p0 + n0))
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        v, b = x[order, k], bad[order]
        left = np.cumsum(b)[:-1]
        ends = np.flatnonzero(v[1:] > v[:-1])
        if not len(ends):
            continue
        middle = (v[ends] + v[ends + 1]) / 2
        for above in (False, True):
            p = (p0 - left[ends]) if above else left[ends]
            t = (len(v) - ends - 1) if above else ends + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / t) - before), -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), Condition(name, above, float(middle[i])))
    return best


def learn(
    x: np.ndarray, label: np.ndarray, names: list[str], *, min_precision: float = 0.95, min_covered: int = 3
) -> list[Rule]:
    """A decision list for label 0. Rows are taken as ordered at random; every third one prunes.

    Every threshold between two values is tried. A rule grows until it covers no other label or nothing
    gains; the list ends with the first rule that is not precise or covers too few. Without rows of both labels the list is empty and nothing is rejected.
    """
    bad = label == 0
    prunes = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while True:
        grow = left & ~prunes
        if not (bad & grow).any():
            break
        conditions: tuple[Condition, ...] = ()
        while True:
            now = grow & _holds(x, names, conditions)
            if not (now & ~bad).any() and conditions:
                break
            _, found = _best_condition(x[now], bad[now], names)
            if found is None:
                break
            conditions += (found,)
        kept: tuple[float, tuple[Condition, ...]] = (-1.0, ())
        for n in range(len(conditions), 0, -1):
            hit = left & prunes & _holds(x, names, conditions[:n])
            p, m = int((hit & bad).sum()), int((hit & ~bad).sum())
            worth = (p - m) / (p + m) if p + m else -1.0
            if worth >= kept[0] and p + m:
                kept = (worth, conditions[:n])
        conditions = kept[1]
        hit = left & _holds(x, names, conditions) if conditions else np.zeros(len(x), bool)
        checked = hit & prunes
        p = int((hit & bad).sum())
        precise = lambda h: (h & bad).sum() >= min_precision * max(h.sum(), 1)
        if not conditions or p < min_covered or not precise(hit) or not precise(checked):
            break
        rules.append(Rule(conditions, p / int(hit.sum()), p))
        left &= ~hit
    return rules


def labelled_sample(labels: DataFrame, limit: int, fold: tuple[int, int] | None = (3, 1)) -> DataFrame:
    """At most ``limit`` identifiers with their quality, picked by hash; outside the held-out fold.

    Several labels of one document become their rounded mean; null labels don't count.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if fold:
        rows = rows.where(~in_fold(F.col("doc_id"), *fold))
    rows = rows.groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, *, limit: int = MAX_LABELLED, fold: tuple[int, int] | None = (3, 1)) -> list[Rule]:
    """Learn from at most ``limit`` labelled documents; their whole texts are counted on the executors.

    Documents that fail the base rules are not learned from: the list is asked about the others only.
    Of rows that share an identifier the one with the least counts is taken.
    """
    sample = labelled_sample(labels, limit, fold)
    texts = id_and_text(docs).join(F.broadcast(sample), "doc_id")
    over = features()
    rows = (
        with_counts(texts, "text", {k: k for k in COUNTS})
        .groupBy("doc_id", "label")
        .agg(F.min(F.struct(*COUNTS)).alias("counts"))
        .select("doc_id", "label", "counts.*")
        .where(~base_failed())
        .select("doc_id", "label", *[v.alias(f"f_{k}") for k, v in over.items()])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .toPandas()
    )
    return learn(rows[[f"f_{k}" for k in over]].to_numpy(float), rows["label"].to_numpy(), list(over))


def verdict(rules: list[Rule], names: dict[str, str] | None = None) -> Column:
    """Ordered conditional: the number of the first rule that rejects, from 1; null where none does."""
    over = features(names)
    out = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(over), F.lit(n)).otherwise(out)
    return out


def base_failed(names: dict[str, str] | None = None) -> Column:
    c = lambda k: F.col((names or {}).get(k, k))
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each row of ``docs``: counts, ``base_failed``, ``rule`` and ``kept``.

    Null and empty texts have no words and fail the base rules; repeated rows are judged alike.
    """
    rows = with_counts(id_and_text(docs), "text", {k: k for k in COUNTS}).drop("text")
    return rows.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def filter_documents(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the list keep, with their own columns and no others."""
    names, taken = {}, list(docs.columns)
    for k in COUNTS:
        names[k] = fresh(k, taken)
        taken.append(names[k])
    rows = with_counts(docs, text, names)
    return rows.where(~base_failed(names) & verdict(rules, names).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
