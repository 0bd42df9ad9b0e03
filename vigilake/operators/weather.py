"""Weather impact on operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.match import lookup, steps

# fixed values: column, comparison, (cut, points, factor text) most severe first
IMPACT_RULES = [
    ("visibility", "lt", [
        (2, 40, "Very low visibility - UAV/satellite operations severely impacted"),
        (5, 25, "Low visibility - limited drone operations"),
        (10, 10, "Moderate visibility - some restrictions")]),
    ("wind_speed", "gt", [
        (30, 30, "High winds - aircraft instability risk"),
        (20, 15, "Moderate winds - drone operations affected"),
        (15, 5, "Light winds - minor impact")]),
    ("condition", "eq", [
        ("sandstorm", 50, "Sandstorm - all operations impacted, equipment at risk"),
        ("dust", 25, "Dust - reduced visibility, equipment wear")]),
    ("temperature", "gt", [
        (45, 15, "Extreme heat - equipment overheating, personnel risk"),
        (40, 5, "High temperature - reduced equipment efficiency")]),
]
DEFAULTS = {"visibility": 20.0, "wind_speed": 10.0, "condition": "clear", "temperature": 30.0}
IMPACT_LEVELS = [(80, "severe"), (50, "high"), (25, "moderate")]
RECOMMENDATIONS = {
    "severe": "Suspend all UAV, satellite, and airborne operations. Ground all aircraft. Secure equipment.",
    "high": "Limit UAV operations to essential only. Increase maintenance checks. Consider postponing non-critical missions.",
    "moderate": "UAV operations possible with caution. Monitor equipment closely. Plan for reduced endurance.",
    "minimal": "All operations nominal. Standard monitoring protocols.",
}
SEA_STATES = [(3, 1), (5, 2), (7, 3)]


def weather_impact(obs: DataFrame) -> DataFrame:
    points, factors = [], []
    for name, how, rules in IMPACT_RULES:
        value = F.coalesce(F.col(name), F.lit(DEFAULTS[name]))
        score, text = None, None
        for cut, worth, why in rules:
            test = {"lt": lambda: value < cut, "gt": lambda: value > cut, "eq": lambda: value == cut}[how]()
            score = F.when(test, F.lit(worth)) if score is None else score.when(test, F.lit(worth))
            text = F.when(test, F.lit(why)) if text is None else text.when(test, F.lit(why))
        points.append(score.otherwise(F.lit(0)))
        factors.append(text)
    scored = obs.withColumn("_raw", sum(points, F.lit(0))).withColumn(
        "factors", F.array_compact(F.array(*factors)))
    return (
        scored.withColumn("impact_level", steps(F.col("_raw"), IMPACT_LEVELS, "minimal"))
        .withColumn("impact_score", F.least(F.lit(100), F.col("_raw"))).drop("_raw")
        .withColumn("recommendation", lookup(F.col("impact_level"), RECOMMENDATIONS, None))
    )


def sea_state(df: DataFrame, col: str = "wind_speed") -> DataFrame:
    return df.withColumn("sea_state", steps(F.col(col), SEA_STATES, 4, "lt"))


def latest_per_region(obs: DataFrame) -> DataFrame:
    """Current observation of each region (aggregation, not a window)."""
    cols = [c for c in obs.columns if c != "region"]
    newest = obs.groupBy("region").agg(F.max_by(F.struct(*cols), F.struct("ts", "id")).alias("_row"))
    return newest.select("region", "_row.*")


def weather_summary(impacts: DataFrame) -> DataFrame:
    out = impacts.agg(
        F.round(F.coalesce(F.avg("impact_score"), F.lit(0.0)), 1).alias("overall_risk_score"),
        F.count_if(F.col("impact_level") == "severe").alias("severe_regions"),
        F.count_if(F.col("impact_level") == "high").alias("high_risk_regions"))
    return out.withColumn("readiness", F.when(F.col("severe_regions") > 2, "degraded").otherwise("normal"))
