"""What each query returns: names, types, a row for each input row, and null and repeated identifiers."""

from pathlib import Path

import pytest
from corpus import SCHEMA, rows

from gridmill.llm import catalog

BIG, TEXT, INT, FLAG, REAL = "bigint", "string", "int", "boolean", "double"
COLUMNS = {
    "op1_quality_classifier": {"doc_id": BIG, "held_out": FLAG, "score": REAL, "predicted": INT},
    "op2_quality_rules": {"doc_id": BIG, **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), BIG), "base_failed": FLAG, "kept": FLAG},
    "op3_spotsigs": {"doc_id": BIG, "n_chars": BIG, "edited_sha256": TEXT, "fingerprint": TEXT, "edited_fingerprint": TEXT, "near_edited": REAL, "near_next": REAL},
    "op4_substring_dedup": {"doc_id": BIG, "n_words": BIG, "n_removed": BIG, "kept_sha256": TEXT},
    "op5_ngram_join": {"doc_id": BIG, "n_shingles": BIG, "component_id": BIG},
    "op6_mixing": {"doc_id": BIG, "size": BIG, "source_size": BIG, "target": REAL, "taken": BIG},
    "op7_packing": {"doc_id": BIG, **dict.fromkeys(("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), BIG)},
    "op8_pii": {"doc_id": BIG, **dict.fromkeys(("n_email", "n_ip", "n_card", "n_phone"), BIG), "base_sha256": TEXT, "spans": TEXT},
    "op9_line_dedup": {"doc_id": BIG, "n_lines": BIG, "n_dropped": BIG, "kept_sha256": TEXT},
    "op10_language_id": {"doc_id": BIG, "held_out": FLAG, "lang_pred": TEXT, "score": REAL},
    "op13_periodic_runs": {"doc_id": BIG, **dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), BIG), "runs_sha256": TEXT, "collapsed_sha256": TEXT},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with odd texts, null and repeated identifiers and labels of some; and the same without rows."""
    out = {}
    data = rows(11)
    data += data[:4]
    for kind, docs in (("rows", data), ("none", [])):
        folder = tmp_path_factory.mktemp(kind)
        spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
        labels = [(d[0], (d[0] or 0) % 2, 0) for d in docs if d[0] is not None and d[0] % 3 == 0]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out[kind] = str(folder)
    return out, len(data)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, tables, name):
    folders, n = tables
    got = catalog.queries()[name](spark, folders["rows"])
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    found = got.collect()
    if name == "op7_packing":
        found = [r for r in found if r.start == 0]
    assert len(found) == n and sum(r.doc_id is None for r in found) == 2
    for c in ("fingerprint", "kept_sha256", "base_sha256", "runs_sha256", "collapsed_sha256", "edited_sha256", "score", "kept"):
        if c in kinds:
            # op9 has no contract: its null texts stay null.
            assert sum(r[c] is None for r in found) == (sum(d[1] is None for d in rows(11)) if name == "op9_line_dedup" else 0)
    empty = catalog.queries()[name](spark, folders["none"])
    assert {c: dict(empty.dtypes).get(c) for c in COLUMNS[name]} == COLUMNS[name] and empty.count() == 0


def test_all_document_queries_are_covered():
    assert set(catalog.queries()) - set(COLUMNS) == {"op11_exact_topk", "op12_conversation_trie"}  # see test_new_operators.py
    assert Path(catalog.__file__).exists()
