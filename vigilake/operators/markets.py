"""Prices, airspace notices, aircraft and visitor sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions import dims
from vigilake.functions.match import lookup


def _money(value: Column, decimals: int, thousands: bool) -> Column:
    grouped = F.format_number(F.round(F.abs(value), decimals), decimals)
    plain = grouped if thousands else F.replace(grouped, F.lit(","), F.lit(""))
    return F.concat(F.lit("$"), F.when(value < 0, "-").otherwise(""), plain)


def price_change(df: DataFrame) -> DataFrame:
    """Change against the previous close in percent, with display strings. Rows
    without both prices (or with a zero) are dropped."""
    present = df.filter((F.coalesce("price", F.lit(0.0)) != 0) & (F.coalesce("prev_close", F.lit(0.0)) != 0))
    change = F.round(F.try_divide(F.col("price") - F.col("prev_close"), F.col("prev_close")) * 100, 2)
    shown = None
    for symbol, _, decimals, thousands in dims.PRICE_SYMBOLS:
        text = _money(F.col("price"), decimals, thousands)
        shown = F.when(F.col("symbol") == symbol, text) if shown is None else shown.when(
            F.col("symbol") == symbol, text)
    return (
        present.withColumn("change", change)
        .withColumn("formatted_price", shown.otherwise(_money(F.col("price"), 2, False)))
        .withColumn("formatted_change", F.format_string("%+.2f%%", F.col("change")))
        .withColumn("name", lookup(F.col("symbol"), {s[0]: s[1] for s in dims.PRICE_SYMBOLS}, None))
    )


def previous_close(ticks: DataFrame, bucket: str = "day") -> DataFrame:
    """Daily closes with the previous day's close. Ticks fold into one row per
    symbol and day first, so the window sees days, not ticks."""
    closes = ticks.groupBy("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("price"))
    return closes.withColumn("prev_close", F.lag("price").over(Window.partitionBy("symbol").orderBy("day")))


def notams_with_airports(notams: DataFrame, airports: DataFrame | None = None) -> DataFrame:
    if airports is None:
        airports = dims.seed_table(notams.sparkSession, dims.AIRPORTS,
                                   ["icao", "airport", "airport_country", "lat", "lng"])
    return notams.join(airports, "icao")


def notam_style(notams: DataFrame) -> DataFrame:
    return notams.withColumn("radius_km", lookup(
        F.col("category"), dims.NOTAM_RADIUS_KM, dims.NOTAM_DEFAULT_RADIUS_KM)).withColumn(
        "color", lookup(F.col("severity"), dims.NOTAM_COLORS, dims.NOTAM_DEFAULT_COLOR))


def aircraft_view(states: DataFrame) -> DataFrame:
    """Display columns: callsign or hex id, whole metres, km/h."""
    callsign = F.trim(F.coalesce("callsign", F.lit("")))
    return (
        states.withColumn("label", F.coalesce(F.nullif(callsign, F.lit("")), F.col("icao24")))
        .withColumn("origin", F.coalesce(F.nullif(F.col("origin_country"), F.lit("")), F.lit("Unknown")))
        .withColumn("altitude_m", F.floor(F.coalesce("baro_altitude", F.lit(0.0)) + 0.5).cast("bigint"))
        .withColumn("speed_kmh", F.floor(F.coalesce("velocity", F.lit(0.0)) * 3.6 + 0.5).cast("bigint"))
    )


def sessions(visits: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions split by inactivity. Spark's session window merges partial
    sessions per partition first, so a busy visitor is not one sorted group."""
    window = F.session_window(F.col(ts).cast("timestamp"), gap)
    return visits.groupBy(F.col(user).alias("visitor"), window).agg(F.count("*").alias("visits")).select(
        "visitor", F.col("session_window.start").alias("started"), "visits")


def visit_counts(session_rows: DataFrame) -> DataFrame:
    return session_rows.groupBy("visitor").agg(F.count("*").alias("sessions"), F.sum("visits").alias("visits"))
