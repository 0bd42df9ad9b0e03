"""Time buckets, daily anomalies, trends and period-over-period change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.operators.enrich import time_key
from vigilake.operators.filters import hours_before, new_hotspots
from vigilake.operators.stats import top_k

SEVERITIES = ["critical", "high", "medium", "low"]


def time_counts(df: DataFrame, bucket: str = "day", col: str = "published") -> DataFrame:
    return df.groupBy(time_key(F.col(col), bucket).alias("bucket")).agg(F.count("*").alias("n"))


def severity_series(df: DataFrame, as_of: str, days: int = 30, col: str = "published") -> DataFrame:
    """Daily totals with one column per severity; a missing severity is medium."""
    level = F.coalesce("severity", F.lit("medium"))
    return (
        df.filter(F.col(col) >= hours_before(as_of, 24 * days))
        .groupBy(F.date_format(col, "yyyy-MM-dd").alias("day"))
        .agg(F.count("*").alias("total"), *[F.count_if(level == s).alias(s) for s in SEVERITIES])
    )


def anomalies(df: DataFrame, threshold: float = 2.0, col: str = "published") -> DataFrame:
    """Days whose count lies more than ``threshold`` population deviations from
    the mean. The mean comes from a one-row aggregate of the daily counts joined
    back, not from a window over all rows; under three events there is none."""
    daily = df.groupBy(F.date_format(col, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    overall = daily.agg(F.sum("n").alias("_events"), F.avg("n").alias("_mean"), F.stddev_pop("n").alias("_sd"))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    scored = daily.join(F.broadcast(overall)).withColumn("_z", (F.col("n") - F.col("_mean")) / sd)
    return (
        scored.filter((F.col("_events") >= 3) & (F.abs("_z") > threshold))
        .withColumn("z_score", F.round("_z", 2))
        .withColumn("severity", F.when(F.abs("_z") > 3, "critical").otherwise("high"))
        .drop("_events", "_mean", "_sd", "_z")
    )


def severity_trend(df: DataFrame, as_of: str, days: int = 7, col: str = "published") -> DataFrame:
    """Critical counts of the recent days against all older ones, in percent. A
    missing date counts as recent."""
    recent = F.col(col).isNull() | (F.col(col) >= hours_before(as_of, 24 * days))
    critical = F.coalesce(F.col("severity") == "critical", F.lit(False))
    out = df.agg(F.count_if(recent).alias("recent_count"), F.count_if(~recent).alias("older_count"),
                 F.count_if(recent & critical).alias("critical_recent"),
                 F.count_if(~recent & critical).alias("_older"))
    change = (F.when(F.col("_older") > 0, (F.col("critical_recent") - F.col("_older")) / F.col("_older") * 100.0)
              .when(F.col("critical_recent") > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    return (
        out.withColumn("_change", change).withColumn("severity_trend_pct", F.round("_change", 1))
        .withColumn("direction", F.when(F.col("_change") > 10, "increasing")
                    .when(F.col("_change") < -10, "decreasing").otherwise("stable"))
        .drop("_older", "_change")
    )


def temporal_summary(df: DataFrame, col: str = "published") -> DataFrame:
    daily = time_counts(df, "day", col)
    found = anomalies(df, col=col).agg(F.count("*").alias("anomaly_days"))
    out = daily.agg(
        F.sum("n").alias("total_events"), F.min("bucket").alias("first_day"), F.max("bucket").alias("last_day"),
        F.min_by("bucket", F.struct(-F.col("n"), F.col("bucket"))).alias("peak_day"))
    return out.join(F.broadcast(found))  # one row each


def last_days(daily: DataFrame, k: int = 30, col: str = "day") -> DataFrame:
    return top_k(daily, [F.desc(col)], k)


# --- period comparison ------------------------------------------------------

def cells(df: DataFrame, lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """Distinct 0.1-degree cells; a zero coordinate means missing."""
    return (
        df.select(F.round(F.col(lat), 1).alias("cell_lat"), F.round(F.col(lng), 1).alias("cell_lng"))
        .filter((F.col("cell_lat") != 0) & (F.col("cell_lng") != 0)).distinct()
    )


def cell_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Every cell of either period with status new, removed or unchanged. One
    union and one aggregation give the three set operations together."""
    both = cells(current).withColumn("_now", F.lit(1)).unionByName(cells(previous).withColumn("_now", F.lit(-1)))
    seen = both.groupBy("cell_lat", "cell_lng").agg(F.max("_now").alias("_hi"), F.min("_now").alias("_lo"))
    return seen.withColumn("status", F.when(F.col("_lo") == 1, "new").when(F.col("_hi") == -1, "removed")
                           .otherwise("unchanged")).drop("_hi", "_lo")


def change_summary(changes: DataFrame, threshold: float = 0.2) -> DataFrame:
    out = changes.agg(
        F.count_if(F.col("status") == "new").alias("new_cells"),
        F.count_if(F.col("status") == "removed").alias("removed_cells"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged_cells"), F.count("*").alias("_all"))
    ratio = (F.col("new_cells") + F.col("removed_cells")) / F.greatest(F.lit(1), F.col("_all"))
    return (out.withColumn("_ratio", ratio).withColumn("change_ratio", F.round("_ratio", 3))
            .withColumn("magnitude", F.when(F.col("_ratio") > threshold, "significant").otherwise("minor"))
            .drop("_all", "_ratio"))


def changed_cells(changes: DataFrame, status: str = "new", k: int = 10) -> DataFrame:
    return top_k(changes.filter(F.col("status") == status).drop("status"),
                 [F.asc("cell_lat"), F.asc("cell_lng")], k)


def thermal_change(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Change summary plus the shift of mean radiative power and both sizes."""
    def power(df: DataFrame, prefix: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"{prefix}_count"),
                      (F.coalesce(F.sum("frp"), F.lit(0.0)) / F.greatest(F.lit(1), F.count("*"))).alias(f"_{prefix}"))

    out = (change_summary(cell_changes(current, previous))
           .join(F.broadcast(power(current, "current")))     # one row each
           .join(F.broadcast(power(previous, "previous"))))
    change = F.when(F.col("_previous") > 0, (F.col("_current") - F.col("_previous"))
                    / F.greatest(F.lit(1.0), F.col("_previous")) * 100.0).otherwise(F.lit(100.0))
    return out.withColumn("intensity_change_pct", F.round(change, 1)).drop("_current", "_previous")


