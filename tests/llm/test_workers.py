"""Spark keeps each Python worker that a task ever held: no task holds two at once, none is held for rows of the driver."""

import random
import re

import corpus_pipeline
import pyarrow as pa
import pytest
from test_nearcopies import brute
from test_operators import documents
from pyspark.sql import functions as F
from vigilake.llm import covering, language, nearcopies
from vigilake.session import BATCH_LIMIT


def test_a_task_of_the_near_copy_stage_holds_one_python_worker(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(30)]
    texts += [*[t + " end" for t in texts[:10]], "one"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    plans = []
    monkeypatch.setattr(nearcopies, "_written", lambda df, real=nearcopies._written: (
        plans.append(df._jdf.queryExecution().sparkPlan().toString()), real(df))[1])
    got = nearcopies.one_of_each(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == brute(rows)
    evaluations = [len(re.findall(r"(?:ArrowEvalPython|MapInArrow|BatchEvalPython) ", p)) for p in plans]
    assert evaluations[0] == 1 and max(evaluations) == 1


def test_further_columns_come_with_the_fingerprint(spark):
    import pyarrow as pa
    from pyspark.sql import types as T

    texts = [None, "", "a b c d", *(f"word {i} of a text {i * i}" for i in range(600))]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    alone = covering.add_fingerprint(docs)
    both = covering.add_fingerprint(docs, also=lambda part: [pa.array([len(t or "") for t in part], pa.int64())],
                                    fields=[T.StructField("size", T.LongType())])
    assert both.columns == [*[c for c in docs.columns if c != "fp"], "fp", "size"]
    wanted = {(r["doc_id"], r["fp"], len(texts[r["doc_id"]] or "")) for r in alone.collect()}
    assert len(wanted) == len(texts) and {(r["doc_id"], r["fp"], r["size"]) for r in both.collect()} == wanted


def test_training_sends_no_rows_through_python_workers(spark, monkeypatch):
    words = {"en": "the cat and the dog ran home", "de": "der Hund und die Katze sind hier"}
    rows = [(i, f"{words[lang]} {i}", lang, "a") for i, lang in enumerate(["en", "de"] * 30)]
    docs = documents(spark, rows)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: 1 / 0)
    assert language.train(docs).labels == ["de", "en"]


@pytest.mark.parametrize("name", ["language", "near_copies", "repeats", "encoding"])
def test_stages_hand_long_texts_to_python_in_small_batches(spark, name):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())],
                                             names=["n", "bytes"])

    docs = documents(spark, [(i, f"the cat and the dog {i}", "en", "a") for i in range(3)])
    long = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    spark.conf.unset(BATCH_LIMIT)
    try:
        stage = dict(corpus_pipeline.STAGES)[name](spark, docs, None)
        seen = long.mapInArrow(sizes, "n long, bytes long").collect()
        assert stage.columns and sum(r["n"] for r in seen) == 3000 and max(r["bytes"] for r in seen) < 5_000_000
    finally:
        spark.conf.unset(BATCH_LIMIT)


def test_a_limit_that_the_session_names_stays(spark):
    spark.conf.set(BATCH_LIMIT, "3m")
    try:
        corpus_pipeline.near_copy_stage(spark, documents(spark, [(1, "a b", "en", "a")]), None)
        assert spark.conf.get(BATCH_LIMIT) == "3m"
    finally:
        spark.conf.unset(BATCH_LIMIT)
