"""Sinks. Large results are written as partitioned files by the executors; run
statistics go to a one-row file beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.operators.enrich import ui_severity
from vigilake.operators.stats import (badge_summary, country_stats, notam_counts, regional_stats,
                                      screening_stats, threat_post_summary)
from vigilake.operators.moderation import report_status

CSV_COLUMNS = ["ID", "Title", "Country", "Type", "Severity", "Published", "Source", "Lat", "Lng", "Casualties"]


def write_incidents(accepted: DataFrame, rejected: DataFrame, path: str) -> None:
    """Accepted incidents partitioned by day (newest first inside each file) and
    the run's statistics."""
    dated = accepted.withColumn("published_date", F.date_format("published", "yyyy-MM-dd"))
    (dated.repartition("published_date", F.pmod(F.xxhash64("seq"), F.lit(8)))
     .sortWithinPartitions("published_date", F.desc("published"), "seq")
     .write.mode("overwrite").partitionBy("published_date").parquet(f"{path}/incidents"))
    screening_stats(accepted, rejected).write.mode("overwrite").json(f"{path}/stats")


def write_groups(groups: DataFrame, members: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").json(f"{path}/groups")
    members.select("group_id", "id", "source", "is_government").write.mode("overwrite").parquet(f"{path}/members")
    badge_summary(groups).write.mode("overwrite").json(f"{path}/summary")


def write_regional_stats(facts: DataFrame, path: str) -> None:
    regional_stats(facts).write.mode("overwrite").json(f"{path}/regional")
    country_stats(facts).write.mode("overwrite").json(f"{path}/countries")


def write_threats(threats: DataFrame, path: str) -> None:
    threats.write.mode("overwrite").json(f"{path}/threats")
    threat_post_summary(threats).write.mode("overwrite").json(f"{path}/summary")


def write_report_status(accepted_reports: DataFrame, path: str) -> None:
    report_status(accepted_reports).write.mode("overwrite").json(path)


def write_prices(prices: DataFrame, path: str) -> None:
    prices.write.mode("overwrite").json(path)


def write_notams(notams: DataFrame, path: str) -> None:
    notams.write.mode("overwrite").json(f"{path}/notams")
    notam_counts(notams).write.mode("overwrite").json(f"{path}/counts")


# --- exports ----------------------------------------------------------------

def csv_rows(df: DataFrame) -> DataFrame:
    """The ten export columns. Zero coordinates count as missing."""
    def place(name: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit(0.0)) != 0, F.col(name))

    values = [
        F.col("id"), F.coalesce("title", F.lit("")), F.coalesce("country", F.lit("Unknown")),
        F.coalesce("type", F.lit("unknown")), ui_severity(F.col("title"), F.col("badge")),
        F.coalesce(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")),
        F.coalesce("source", F.lit("Unknown")), place("lat"), place("lng"),
        F.coalesce("casualties_total", F.lit(0))]
    return df.select(*[v.alias(n) for v, n in zip(values, CSV_COLUMNS)])


def csv_lines(df: DataFrame) -> DataFrame:
    """Export rows as text lines: the title quoted with doubled quotes."""
    rows = csv_rows(df)
    title = F.concat(F.lit('"'), F.replace(F.col("Title"), F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [title if c == "Title" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CSV_COLUMNS]
    return rows.select(F.col("ID").alias("id"), F.concat_ws(",", *cells).alias("line"))


def export_csv(df: DataFrame, path: str) -> None:
    csv_rows(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def geojson_features(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per line, coordinates as [lng, lat]; rows without a
    place are left out."""
    located = df.filter((F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lng", F.lit(0.0)) != 0))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("id", "title", "country", "type", ui_severity(F.col("title"), F.col("badge")).alias("severity"),
                 F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss").alias("published"), "source").alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"))
    return located.select("id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def export_geojson(df: DataFrame, path: str) -> None:
    """Newline-delimited features: one collection document would pass through a
    single task."""
    geojson_features(df).select("feature").write.mode("overwrite").text(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
