"""A corpus pipeline of five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of documents;
the last returns the encoded corpus. Each result is written to the shared folder
and read back before the next stage, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import bpe, chunks, language, mixing, nearcopies, queries
from vigilake.session import fresh_path, small_batches

#: Of the held-out documents whose language is predicted rightly, this share is less sure than what is kept.
UNSURE = 1e-3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter and those of no clear language; fill a missing ``lang``.

    Unclear is a score that nearly all rightly predicted held-out documents pass, so the
    bound follows the number of languages and the corpus. If no document has a language
    to learn from, none is rejected for its score.
    """
    small_batches(spark)
    net = language.train(docs)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    least = language.least_score(docs, net, UNSURE)
    found = language.identify(docs, net).filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest id.

    The covering search of ``op10_simhash`` finds what its radius reaches; an exact check follows, and prefix
    filtering finds the rest.
    """
    small_batches(spark)
    return nearcopies.one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds; a document that loses all its words goes."""
    small_batches(spark)
    left = chunks.without_repeats(docs)
    gone = (F.size("cut_spans") > 0) & ~F.col("text").rlike(r"\S")
    return (left.filter(~F.coalesce(gone, F.lit(False)))
            .withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents, so that sources come near their target weights."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids``: the mixed corpus as token ids."""
    small_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "source", "text"), queries.vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language_stage), ("near_copies", near_copy_stage), ("repeats", repeat_stage),
          ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: Trained models and rolling hashes have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
