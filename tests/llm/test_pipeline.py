"""The pipeline: every stage on awkward rows, and the whole of it on the smallest tables."""

import re

import pytest

import corpus_pipeline
from test_operators import BASE, PASSAGE, ROWS, documents
from vigilake.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def test_stage_names_and_columns(spark):
    docs = documents(spark)
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
    assert corpus_pipeline.encoding_stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_decisions_take_effect(spark):
    docs = documents(spark)
    left = corpus_pipeline.language_stage(spark, docs, SF_DIR)
    assert {r["doc_id"] for r in left.collect()} == {i for i, t, *_ in ROWS if t and re.search(r"[^\W\d_]", t)}
    one = corpus_pipeline.near_copy_stage(spark, left, SF_DIR).collect()
    assert [r["doc_id"] for r in one if r["text"].lower() == BASE.lower()] == [1]
    cut = corpus_pipeline.repeat_stage(spark, docs, SF_DIR).collect()
    assert [r["doc_id"] for r in cut if r["text"] and PASSAGE in r["text"]] == [10]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut)
    assert sorted(r["doc_id"] or 0 for r in cut if not r["text"]) == [0, 4, 5]  # 2 lost all, these had none


def test_run_over_the_smallest_tables(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    rows = got.collect()
    assert got.columns == ["doc_id", "source", "n_tokens", "ids"] and len(rows) > 100
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0
