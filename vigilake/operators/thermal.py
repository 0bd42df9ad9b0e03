"""Thermal detections: classification, regions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import dims
from vigilake.functions.match import lookup
from vigilake.operators.stats import top_k


def classify_fires(df: DataFrame) -> DataFrame:
    """Fire type from power and brightness, risk adjusted by confidence."""
    frp = F.coalesce("frp", F.lit(0.0))
    bright = F.coalesce("brightness", F.lit(300.0))
    kind = (F.when(frp > 100, "industrial_large").when(frp > 50, "industrial_medium")
            .when(bright > 350, "gas_flare").when(frp > 20, "wildfire").otherwise("controlled_burn"))
    base = (F.when(frp > 100, "high").when((frp > 50) | (bright > 350) | (frp > 20), "medium").otherwise("low"))
    sure = F.coalesce("confidence", F.lit("nominal"))
    risk = (F.when(sure == "high", F.when(base != "low", "high").otherwise("medium"))
            .when(sure == "low", F.when(base != "high", "low").otherwise("medium")).otherwise(base))
    return (df.withColumn("fire_type", kind).withColumn("risk_level", risk)
            .withColumn("is_thermal_anomaly", bright > 320))


def region_of(lat: Column, lng: Column, boxes=tuple(dims.THERMAL_REGIONS)) -> Column:
    """First listed box that holds the point, for box lists short enough to inline."""
    out = None
    for name, lat_min, lat_max, lng_min, lng_max in boxes:
        test = lat.between(lat_min, lat_max) & lng.between(lng_min, lng_max)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("Other"))


def region_join(points: DataFrame, boxes: DataFrame, lat: str = "latitude", lng: str = "longitude",
                cell: float = 2.0, default: str = "Other") -> DataFrame:
    """Point-in-box join for a table of boxes (region, priority, lat_min, lat_max,
    lng_min, lng_max), lowest priority number first. Boxes are cut into grid
    cells, so points meet only the boxes of their own cell through an equi join;
    the winning box is chosen per distinct point."""
    def cell_of(col):
        return F.floor(col / F.lit(cell))

    tiles = (
        boxes.withColumn("_cx", F.explode(F.sequence(cell_of(F.col("lat_min")), cell_of(F.col("lat_max")))))
        .withColumn("_cy", F.explode(F.sequence(cell_of(F.col("lng_min")), cell_of(F.col("lng_max")))))
    )
    spots = points.select(lat, lng).distinct().withColumn("_cx", cell_of(F.col(lat))).withColumn(
        "_cy", cell_of(F.col(lng)))
    placed = (
        spots.join(tiles, ["_cx", "_cy"])
        .filter(F.col(lat).between(F.col("lat_min"), F.col("lat_max"))
                & F.col(lng).between(F.col("lng_min"), F.col("lng_max")))
        .groupBy(lat, lng).agg(F.min_by("region", "priority").alias("region"))
    )
    return points.join(placed, [lat, lng], "left").withColumn("region", F.coalesce("region", F.lit(default)))


def analyze_thermal(df: DataFrame) -> DataFrame:
    """Detections and power in total, per fire type and per region, one pass."""
    rows = classify_fires(df).withColumn("region", region_of(F.col("latitude"), F.col("longitude")))
    grouped = rows.groupingSets([[], ["fire_type"], ["region"]], "fire_type", "region").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("detections"),
        F.round(F.sum(F.coalesce("frp", F.lit(0.0))), 1).alias("total_frp"))
    return (grouped.withColumn("scope", lookup(F.col("_g"), {3: "total", 1: "type", 2: "region"}, None))
            .withColumn("label", F.coalesce("fire_type", "region", F.lit("all")))
            .select("scope", "label", "detections", "total_frp"))


def hotspots(df: DataFrame, k: int = 10) -> DataFrame:
    return top_k(classify_fires(df), [F.desc("frp"), F.asc("id")], k)
