"""The stages one after the other, each against brute force on what its predecessor kept."""

from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_operators import components, wide_fingerprint
from tracewell.llm import decontamination, quality_rules, token_output
from tracewell.llm.common import DOCUMENT_COLUMNS, slices, store, table


def test_stages(spark):
    docs, kept = table(spark, SMALL, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SMALL), "test-stage")
        kept.append(docs.collect())
    rules, near, clean, mixed, ids = kept
    assert all(list(rows[0].asDict()) == DOCUMENT_COLUMNS for rows in kept[:4])
    verdict = quality_rules.op3_quality_rules(spark, SMALL).where("kept").collect()
    assert {r.doc_id for r in rules} == {r.doc_id for r in verdict} and len(rules) > 0.5 * table(spark, SMALL, "documents").count()
    fps = {r.doc_id: wide_fingerprint(r.text) for r in rules}
    group = components(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 20])
    assert sorted(r.doc_id for r in near) == sorted(set(group.values()))
    hit = {r.doc_id for r in decontamination.matches(spark.createDataFrame(near), table(spark, SMALL, "benchmark")).collect()}
    assert {r.doc_id for r in clean} == {r.doc_id for r in near} - hit
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    assert sorted(r.doc_id for r in ids) == sorted(r.doc_id for r in mixed)
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns, empty tables."""
    text = "\n".join(" ".join(f"word{(i * 7 + j * 3) % 97}" for j in range(9)) for i in range(12))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, text, "en", None, 7), (4, text, "en", "a", 14), (4, text, "en", "a", 14), (5, "x" * 300_000 + " y" * 30, "de", "b", 1), (6, text + " more", None, "b", 1), (7, text.upper(), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"t_key": F.lit(1), "node": F.lit(2), "size": F.lit(3), "row": F.lit(4), "item_id": F.lit(5), "kept": F.lit(6)})
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        counts[name] = out.collect()
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == DOCUMENT_COLUMNS
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    ids = {name: sorted(str(r.doc_id) for r in got) for name, got in counts.items()}
    assert "1" not in ids["quality rules"] and "2" not in ids["quality rules"]
    assert ids["SimHash near-dedup"] == ["1", "4", "5"]  # empty texts are one group, the copies and near copies another
    assert ids["benchmark decontamination"] == sorted(str(r[0]) for r in rows)
    assert set(ids["mixing sources to target weights"]) <= {str(r[0]) for r in rows}
    assert ids["token-ID / binary output"] == sorted(str(r[0]) for r in rows)


def test_a_worker_holds_the_memory_of_one_operator():
    """The words that the token stage remembers go when the worker turns to another stage, and stay between the stage's own tasks."""
    token_output._ENCODERS["x", 1] = "words"
    list(slices(iter([]), keep=token_output._ENCODERS))
    assert token_output._ENCODERS == {("x", 1): "words"}
    list(slices(iter([])))
    assert token_output._ENCODERS == {}
