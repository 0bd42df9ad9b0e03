"""Two-pass external shuffle into shards."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import without
from vigilake.session import fresh_path

#: Most buckets one call may use; their counts (16 bytes each) are broadcast.
MOST_BUCKETS = 1 << 20


def record_size(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shuffled(df: DataFrame, seed: int = 20_11, bucket_bytes: int = 8 << 20) -> DataFrame:
    """All records of ``df`` in a uniformly random order: adds ``place``, gapless from 0.

    Pass 1 scatters records over buckets by a seeded hash of the whole record; the
    number of buckets follows from the bytes, so that one bucket fits in memory.
    Pass 2 shuffles each bucket with Spark's ``shuffle`` function, which is a
    Fisher-Yates walk over the array. A bucket's first place is the count of all
    earlier buckets. Buckets are sorted before the walk and dealt to a fixed number
    of partitions, so the order depends on records, seed and bucket size alone.

    The hash covers every column: equal texts under different ids scatter. Rows
    equal in every column share a bucket (they can't be told apart). Nulls in any
    column hash like values. No rows: no rows. A ``place`` column of the input is
    replaced. At 100 TB pass a larger ``bucket_bytes`` (512 MB: 200,000 tasks).
    """
    df = without(df, "place")
    columns = [F.col(f"`{c}`") for c in df.columns]
    text_bytes = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    weight = sum(text_bytes, F.lit(8 * len(columns))).cast("long")
    total = df.agg(F.count("*").alias("n"), F.sum(weight).alias("bytes")).first()
    buckets = max(1, math.ceil((total["bytes"] or 0) / bucket_bytes))
    if buckets > MOST_BUCKETS:
        raise ValueError(f"{buckets} buckets: raise bucket_bytes")
    hashed = df.select(F.struct(*columns).alias("row"), F.xxhash64(F.lit(seed), *columns).alias("h"))
    dealt = hashed.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket").count().select(
        "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    walked = (dealt.repartition(buckets, "bucket")
              .groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("h", "row"))).alias("rows"))
              .sortWithinPartitions("bucket")
              .withColumn("rows", F.shuffle("rows", F.lit(seed))))
    return (walked.select("bucket", F.posexplode("rows").alias("at", "record"))
            .join(F.broadcast(starts), "bucket")
            .select("record.row.*", (F.col("start") + F.col("at")).alias("place")))


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 20_11, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Write ``df`` shuffled into ``shards`` folders under ``path`` and return what was written.

    Adds ``shard`` and ``slot``; a shard is a contiguous run of the shuffled order,
    so counts differ by one at most and a bucket lands in one or two shards.
    ``slot`` counts from 0 inside the shard. Input columns with these names are
    replaced. Written before it is read: a lost executor can't reorder it.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    placed = shuffled(without(df, "shard", "slot"), seed, bucket_bytes)
    total = df.count()
    shard = F.expr(f"int(((place + 1) * {shards} - 1) div {max(total, 1)})")
    start = F.expr(f"(shard * {total}L) div {shards}")
    (placed.withColumn("shard", shard).withColumn("slot", F.col("place") - start).drop("place")
     .write.partitionBy("shard").parquet(path))
    schema = T.StructType([*without(df, "shard", "slot").schema, T.StructField("slot", T.LongType()),
                           T.StructField("shard", T.IntegerType())])
    return df.sparkSession.read.schema(schema).parquet(path)


def sharded_documents(spark: SparkSession, docs: DataFrame, shards: int = 24) -> DataFrame:
    """The digest of ``write_shards`` over documents: law ``rows``, nothing grows."""
    written = write_shards(docs.select("doc_id", "text"), fresh_path(spark, "shards"), shards)
    return written.select(
        "doc_id", record_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))
