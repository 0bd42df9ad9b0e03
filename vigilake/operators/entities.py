"""Entities and country threat scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions import dims
from vigilake.functions.match import lookup, steps
from vigilake.operators.stats import top_k

THREAT_LEVELS = [(80, "critical"), (60, "high"), (40, "medium")]


def canonical_entities(mentions: DataFrame) -> DataFrame:
    """One row per entity id with its mention count and all aliases. Aliases are
    made distinct per row before they are collected, so a frequent entity costs
    its number of different aliases, not its number of mentions."""
    counts = mentions.groupBy("entity_id", "entity_name", "entity_type", "aliases").agg(F.count("*").alias("n"))
    return counts.groupBy("entity_id").agg(
        F.min("entity_name").alias("entity_name"), F.min("entity_type").alias("entity_type"),
        F.sum("n").alias("event_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))


def threat_baseline(codes: DataFrame, baseline: DataFrame | None = None, code: str = "code") -> DataFrame:
    """Baseline score and factors of a country code; unlisted codes get the default."""
    if baseline is None:
        baseline = dims.seed_table(codes.sparkSession, dims.THREAT_BASELINE,
                                   ["code", "base_score", "base_level", "factors"])
    score, level = dims.DEFAULT_THREAT
    return (
        codes.join(baseline.withColumnRenamed("code", code), code, "left")
        .withColumn("base_score", F.coalesce("base_score", F.lit(score)))
        .withColumn("base_level", F.coalesce("base_level", F.lit(level)))
        .withColumn("factors", F.coalesce("factors", F.array().cast("array<string>")))
    )


def country_threat(incidents: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Score = base + 5 per critical + 2 per high event, at most 100."""
    counts = incidents.withColumn("code", F.explode("countries")).groupBy("code").agg(
        F.count("*").alias("events"), F.count_if(F.col("severity") == "critical").alias("critical_events"),
        F.count_if(F.col("severity") == "high").alias("high_events"))
    scored = threat_baseline(counts, baseline).withColumn("threat_score", F.least(
        F.lit(100), F.col("base_score") + 5 * F.col("critical_events") + 2 * F.col("high_events")))
    return (
        scored.withColumn("threat_level", steps(F.col("threat_score"), THREAT_LEVELS, "low"))
        .withColumn("trend", F.when(F.col("critical_events") > 2, "increasing").otherwise("stable"))
        .withColumn("name", F.coalesce(lookup(F.col("code"), dict(dims.ISO_NAMES), None), F.col("code")))
    )


def top_threats(threats: DataFrame, k: int = 10) -> DataFrame:
    return top_k(threats, [F.desc("threat_score"), F.asc("code")], k)


def threat_summary(entities: DataFrame, threats: DataFrame) -> DataFrame:
    """``threats`` is the report's list of countries (top 10 by default)."""
    listed = threats.agg(F.count("*").alias("total_countries"),
                         F.count_if(F.col("threat_level") == "critical").alias("critical_threats"))
    return entities.agg(F.count("*").alias("total_entities")).join(F.broadcast(listed))  # one row each
