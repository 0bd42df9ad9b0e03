"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import vigilake

from vigilake.session import cut

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once a session, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "vigilake_shipped", False):
        return
    root = os.path.dirname(vigilake.__file__)
    path = os.path.join(tempfile.mkdtemp(prefix="vigilake-code-"), "vigilake.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context.vigilake_shipped = True


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add: its own win over an input's."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def in_ranges(df: DataFrame, *keys: Column) -> DataFrame:
    """Rows dealt into contiguous ranges of ``keys``; ``part`` numbers the ranges.

    The bounds come from Spark's range partitioner, which samples; the result is
    checkpointed, so that a retried task can't see other bounds. Give keys that
    tell rows apart, so that no run of ties makes one range large.
    """
    return cut(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))


def following(df: DataFrame, key: str) -> DataFrame:
    """``df`` (one row per ``key``) with ``next_key``: the next larger key, after the last the first.

    Rows are compared inside ranges; only the first key of each range, as many
    rows as there are partitions, meets in one task.
    """
    parted = in_ranges(df, F.col(key))
    inside = Window.partitionBy("part").orderBy(key)
    ahead = Window.orderBy("part")
    firsts = parted.groupBy("part").agg(F.min(key).alias("head"))
    heads = firsts.select("part", F.coalesce(F.lead("head").over(ahead), F.min("head").over(
        ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_head"))
    return (parted.withColumn("inner", F.lead(key).over(inside))
            .join(F.broadcast(heads), "part")
            .withColumn("next_key", F.coalesce("inner", "next_head"))
            .drop("part", "inner", "next_head"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``a, b`` (longs): ``node, root`` for every node of an edge.

    The root is the smallest node reachable. Large-star and small-star steps
    (Kiveris et al. 2014) as joins and map-side combined minima: no neighbour list
    is ever built, so a node of any degree is fine. Each round is checkpointed; the
    driver sees one number per round.
    """
    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                .distinct())
    before = state(links)
    while before[0]:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.filter("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        links = cut(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
