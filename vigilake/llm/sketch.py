"""Document fingerprints: bottom-k sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import WORD, following

SHINGLE = 5
K = 128
FIRST_ID = -(2**63)


def word_array(text: Column | str) -> Column:
    """Lower-cased words of the whole text; null: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def sketch_of(words: str, k: int = K, shingle: int = SHINGLE) -> Column:
    """The ``k`` smallest distinct 32-bit shingle hashes of a word column, ascending.

    Fewer words than a shingle has: one shingle of them all. No word: an empty sketch.
    """
    w = F.col(words)
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.shiftright(
        F.xxhash64(*[w[i + j] for j in range(shingle)]), 32).cast("int"))
    whole = F.array(F.shiftright(F.xxhash64(F.concat_ws(" ", w)), 32).cast("int"))
    shingles = F.when(F.size(w) >= shingle, hashed).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<int>"))
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def add_sketch(df: DataFrame, name: str, text: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    words = f"_{name}_words"
    return df.withColumn(words, word_array(F.col(text))).withColumn(name, sketch_of(words, k, shingle)).drop(words)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together, from their sketches alone."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated shared part of all distinct shingles; exact while both hold under ``k``. Two empty ones are equal."""
    union = merged(F.col(a), F.col(b), k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / F.size(union)).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact under ``k``."""
    share = (F.element_at(a, k).cast("double") + 2147483648.0) / 4294967296.0
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated part of ``a``'s distinct shingles that ``b`` holds too. An empty ``a`` is contained."""
    both = resemblance(a, b, k) * distinct_count(merged(F.col(a), F.col(b), k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(F.col(a), k)))


def hex_string(a: str) -> Column:
    """A sketch as text: eight lowercase hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(
        F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(4294967295)))), 8, "0")), "")


def merge_sketches(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group from the sketches of its parts: the ``k`` smallest hashes of all.

    Hashes are exploded, made distinct and first cut to ``k`` in 64 parts of each
    group, so a group of any number of sketches is never in one task.
    """
    hashes = df.select(*by, F.explode(sketch).alias("_hash")).distinct().withColumn(
        "_part", F.pmod("_hash", F.lit(64)))
    for parts in (["_part"], []):
        rank = F.row_number().over(Window.partitionBy(*by, *parts).orderBy("_hash"))
        hashes = hashes.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return hashes.groupBy(*by).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprint every whole text and its edited text.

    The edited text has its last quarter (rounded down) of code points replaced by
    as many first ones of the next document by ascending id, after the last by the
    first. Null text is empty; a null id sorts first. Rows with one id share the
    next document: the smallest text of the next larger id. A single id is its own
    next. No rows: no rows.

    Texts move once, dealt by id; both joins read that exchange. Each document asks
    its successor for a prefix, so the second move carries a quarter of the text.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(FIRST_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    lengths = base.groupBy("key").agg(F.max(F.char_length("text")).alias("longest"))
    asks = following(lengths, "key").select(
        F.col("key").alias("asker"), "next_key", F.floor(F.col("longest") / 4).cast("int").alias("need"))
    dealt = add_sketch(base, "sketch", "text", k).repartition(F.col("key"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("text"))
    given = (dealt.withColumn("nth", first).filter("nth = 1")
             .join(asks, F.col("key") == F.col("next_key"))
             .select("asker", F.expr("substring(text, 1, need)").alias("prefix"),
                     F.col("sketch").alias("next_sketch")))
    joined = dealt.join(given, F.col("key") == F.col("asker"))
    chars = joined.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, int(n_chars - n_chars div 4)), substring(prefix, 1, int(n_chars div 4)))")
    chars = chars.withColumn("edited", edited).drop("prefix", "text")
    both = add_sketch(chars, "edited_sketch", "edited", k)
    return both.select(
        F.when(F.col("key") != FIRST_ID, F.col("key")).alias("doc_id"), "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"), hex_string("sketch").alias("fingerprint"),
        hex_string("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch", k).alias("near_edited"),
        resemblance("sketch", "next_sketch", k).alias("near_next"))
