"""The corpus pipeline, stage by stage, against brute force on its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline
from inkwell.llm.common import materialize
from tests.llm.test_queries import joined

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's input, and the last one's output."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        out.append(docs)
        docs = materialize(f(spark, docs, sf_dir))
    return [*out, docs]


def test_stages_return_documents(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == COLUMNS for s in stages[:5])
    assert stages[5].count() == stages[4].count() > 0


def test_language_rejects_what_has_no_letter(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    rows = stages[0].collect()
    lettered = {r.doc_id for r in rows if r.text and any(c.isalpha() for c in r.text)}
    assert kept <= lettered and len(kept) >= 0.97 * len(lettered)


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_duplicates_by_jaccard(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = joined(len(sets), links)
    assert links and {r.doc_id for r in stages[3].collect()} == {rows[i][0] for i in set(root)}


def test_decontamination_keeps_clean_documents(spark, sf_dir, stages):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text]
    before, after = stages[3].collect(), {r.doc_id for r in stages[4].collect()}
    assert not any(x in r.text for r in before if r.doc_id in after for x in items if len(x.split()) >= 8)
    grams = {tuple(w[i : i + 3]) for x in items for w in [x.lower().split()] for i in range(len(w) - 2)}
    clean = {r.doc_id for r in before for w in [r.text.lower().split()] if not any(tuple(w[i : i + 3]) in grams for i in range(len(w) - 2))}
    assert clean <= after


def test_short_lines_that_recur_go(spark, sf_dir):
    docs = spark.createDataFrame([(i, f"Les.\n\nown line of {chr(97 + i) * 3} alone\nAnd ornd.", "en", "a", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, sf_dir).collect()}
    assert got == {i: f"\nown line of {chr(97 + i) * 3} alone" if i else "Les.\n\nown line of aaa alone\nAnd ornd." for i in range(6)}


@pytest.mark.parametrize("kind", ["messy", "empty"])
def test_messy_and_empty_tables(spark, kind, request):
    folder = request.getfixturevalue(kind)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = materialize(f(spark, docs, folder))
    rows = docs.collect()
    assert docs.columns[:5] == COLUMNS and (kind == "messy") == bool(rows)
    assert all(r[c] == f"own {c}" for r in rows for c in docs.columns[5:])
    assert corpus_pipeline.run(spark, folder).count() == len(rows)
