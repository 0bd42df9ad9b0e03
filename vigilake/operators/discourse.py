"""Sentiment mix, top sources, hashtags and trending words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.operators.enrich import hashtags
from vigilake.operators.stats import top_k


def sentiment_distribution(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "negative", "neutral")])


def top_counts(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return top_k(counts, [F.desc("n"), F.asc(col)], k)


def trending_hashtags(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    return top_counts(hashtags(df, col).select("tag"), "tag", k)


def trending(df: DataFrame, col: str = "title", k: int = 20, keep: int = 10) -> DataFrame:
    """Most frequent words longer than four characters; of the top ``k`` those
    seen at least twice, the first ``keep`` of them."""
    words = df.select(F.explode(F.filter(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"\s+"),
                                         lambda w: F.length(w) > 4)).alias("keyword"))
    best = top_counts(words, "keyword", k).filter(F.col("n") >= 2)
    out = top_k(best, [F.desc("n"), F.asc("keyword")], keep)
    return out.withColumn("velocity", F.when(F.col("n") > 5, "accelerating").otherwise("stable"))
