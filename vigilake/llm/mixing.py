"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import LAST_ID, WORD, in_ranges, without

#: Fixed by the contract: weights in code point order of the sources, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = MOST_COPIES) -> DataFrame:
    """``source, source_size, target, seq`` from rows of ``source, size``.

    Sources in code point order, null last, take the weights in turn. The share of
    all words is dealt by weight; a target above ``cap`` times its source stops
    there and the excess goes to the others by weight. Filling sources in ascending
    order of cap over weight gives that fixed point without iteration. One row per
    source meets in one task.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = per_source.withColumn("seq", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("seq") % len(weights) + 1).cast("int"))
    filled = Window.orderBy("ratio", "seq")
    earlier, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("ratio", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (named.withColumn("weight", weight)
              .withColumn("most", cap * F.col("source_size"))
              .withColumn("ratio", F.col("most") / F.col("weight"))
              .withColumn("total", share * F.sum("source_size").over(whole))
              .withColumn("spent", F.coalesce(F.sum("most").over(earlier), F.lit(0.0)))
              .withColumn("level", (F.col("total") - F.col("spent")) / F.sum("weight").over(rest))
              .withColumn("open", F.col("most") > F.col("level") * F.col("weight"))
              .withColumn("water", F.min(F.when(F.col("open"), F.struct("ratio", "seq", "level"))).over(whole)))
    below = F.col("water").isNull() | (F.struct("ratio", "seq") < F.struct("water.ratio", "water.seq"))
    return levels.select("source", "source_size", "seq",
                         F.when(below, F.col("most")).otherwise(F.col("water.level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, seed: int = 9, weights=WEIGHTS, share: float = SHARE,
           cap: float = MOST_COPIES) -> DataFrame:
    """How often each document enters the mix: ``doc_id, text_hash, source, size, source_size, target, copies``.

    A document's expected copies are its source's target over its size. Inside a
    source documents stand in order of size, then id; the running sum of expected
    copies plus one offset per source (a digest of seed and source) crosses whole
    numbers, and each crossing emits the document once. Neighbours have nearly equal
    sizes, so the words taken stay near the target. Running sums are kept inside
    ranges of that order and carried over by one row per (source, range): no source
    needs to fit in a task, however much of the input it holds.

    Size is the number of words of the whole text (null: 0). A source without words
    takes nothing. Null sources form one source. Rows equal in all columns are
    separate documents. Empty input: no rows.
    """
    narrow = docs.select(
        "doc_id", "source", F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.coalesce("doc_id", F.lit(LAST_ID)).asc(),
             F.col("text_hash").asc()]
    parted = in_ranges(narrow, *order)
    targets = source_targets(parted, weights, share, cap)
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10)
    targets = targets.withColumn("offset", bits.cast("double") / 4294967296.0).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    inside = Window.partitionBy("source", "part").orderBy(*order[1:])
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (parted.groupBy("source", "part").count()
              .withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
              .join(targets.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
              .select(F.col("source").alias("of"), F.col("part").alias("range"),
                      "start", "source_size", "target", "offset", "rate"))
    ranked = parted.withColumn("rank", F.row_number().over(inside)).join(
        starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("range")))
    place = F.col("start") + F.col("rank")
    crossed = F.floor(F.col("rate") * place + F.col("offset")) - F.floor(F.col("rate") * (place - 1) + F.col("offset"))
    return ranked.select("doc_id", "text_hash", "source", "size", "source_size", "target",
                         crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as ``copies`` says, columns as given.

    Rows equal in id, source and text share their copies evenly.
    """
    key = ["_id", "_hash", "_source"]
    drawn = copies(docs, **options).groupBy(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source")
    ).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0")
    keyed = [F.coalesce("_id", F.lit(LAST_ID)).alias("_id"), "_hash", F.coalesce("_source", F.lit("")).alias("_source"),
             F.col("_source").isNull().alias("_none")]
    drawn = drawn.select(*keyed, F.col("_id").isNull().alias("_no_id"), "_copies", "_rows")
    keys = ["_id", "_hash", "_source", "_none", "_no_id"]
    rows = without(docs, *keys, "_copies", "_rows", "_nth")
    rows = rows.select("*", F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), F.xxhash64("text").alias("_hash"),
                       F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"),
                       F.col("doc_id").isNull().alias("_no_id"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    found = rows.withColumn("_nth", nth).join(drawn, keys)
    times = F.expr("int((_copies * _nth) div _rows - (_copies * (_nth - 1)) div _rows)")
    return (found.withColumn("_nth", F.explode(F.array_repeat(F.lit(1), times)))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
