"""The operators and the pipeline as named queries, with check SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from vigilake.llm import (alignment, bpe, chunks, conversation, covering, fixity, language, lattice, mixing, sharding,
                          sketch, tokencounts, toxicity)
from vigilake.llm.common import table

#: Folder of the public vocabulary files; the installed package's own place unless set.
VOCABULARIES = "VIGILAKE_VOCABULARIES"


def vocabulary(name: str) -> str:
    folder = os.environ.get(VOCABULARIES)
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.document_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(table(spark, sf_dir, "documents"))


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(spark, table(spark, sf_dir, "documents"))


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audited_pages(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.cut_documents(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.copies(table(spark, sf_dir, "documents"))
    return drawn.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering.near_document_components(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.conversation_repairs(table(spark, sf_dir, "conversations"))


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.documents_counted(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                                    vocabulary("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_fingerprints, op3_language, op4_lattice, op5_shards, op6_fixity, op7_bpe, op8_chunks,
    op9_mixing, op10_simhash, op11_repair, op12_tokens, op13_alignment)}

CHECKS = {
    "op9_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS seq
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS most, [5.0::DOUBLE, 2.0, 1.0][seq % 3 + 1] AS weight FROM sources),
levels AS (
  SELECT *, most / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total,
    coalesce(sum(most) OVER (ORDER BY most / weight, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER (ORDER BY most / weight, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed),
filled AS (
  SELECT *, (total - spent::DOUBLE) / rest AS level FROM levels),
water AS (
  SELECT level, ratio, seq FROM filled WHERE most > level * weight ORDER BY ratio, seq LIMIT 1),
targets AS (
  SELECT f.source, f.source_size,
    CASE WHEN w.level IS NULL OR (f.ratio, f.seq) < (w.ratio, w.seq) THEN f.most::DOUBLE ELSE w.level * f.weight END
      AS target,
    ('0x' || substr(md5('9:' || coalesce(f.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM filled f LEFT JOIN water w ON true),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.shift,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (floor(rate * place + shift) - floor(rate * (place - 1) + shift)))::BIGINT AS taken
FROM ranked""",
    "op6_fixity": r"""
WITH records AS (
  SELECT page_id, page_id // 1000 AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)
    AS payload
  FROM pages),
placed AS (
  SELECT *, coalesce(sum(strlen(payload)) OVER (PARTITION BY file ORDER BY page_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM records),
held AS (
  SELECT *, CASE WHEN page_id % 211 = 5 THEN NULL
    WHEN page_id % 97 = 13 THEN 'X' || substr(payload, 2)
    WHEN page_id % 163 = 7 THEN substr(payload, 1, length(payload) - 1) ELSE payload END AS copy
  FROM placed)
SELECT page_id, file, start AS "offset", CASE WHEN copy IS NULL THEN 'missing' ELSE 'changed' END AS status,
  sha256(payload) AS first_digest, sha256(copy) AS second_digest
FROM held WHERE copy IS DISTINCT FROM payload""",
}
