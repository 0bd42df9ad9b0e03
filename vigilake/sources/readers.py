"""Readers for landed files. Each format has a ``parse_*`` half that works on any
DataFrame of raw text (batch or stream) and a ``read_*`` half that opens files.
All schemas are declared; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import dims
from vigilake.operators.enrich import (casualties, classify, enrich_source, extract_location, publish_ts,
                                       with_ids)
from vigilake.operators.filters import filter_recent, filter_relevant, head_per_key
from vigilake.functions import lexicons as lex
from vigilake.functions.match import first_label

ENTRY_SCHEMA = ("id bigint, source string, title string, source_url string, published timestamp_ntz, "
                "updated timestamp_ntz, position bigint")
INCIDENT_SCHEMA = (
    "id bigint, title string, source string, source_url string, published string, type string, status string, "
    "location struct<name:string,city:string,country:string,lat:double,lng:double>, credibility int, "
    "is_government boolean, casualties struct<total:int,military:int,civilian:int,injured:int>, "
    "verification struct<badge:string,score:int,num_sources:int,status:string>, severity string, "
    "content string, timestamp string")
NEWS_PAGE_SCHEMA = ("status string, results array<struct<title:string,link:string,source_id:string,pubDate:string>>")
CHART_SCHEMA = ("chart struct<result:array<struct<meta:struct<regularMarketPrice:double,"
                "chartPreviousClose:double>>>>")
NOTAM_SCHEMA = (
    "id string, icao string, airport string, country string, content string, category string, severity string, "
    "coordinates struct<lat:double,lng:double>, valid_from string, valid_until string, issued_at string")
REPORT_SCHEMA = ("reports map<string,array<struct<timestamp:string,reason:string,details:string,"
                 "fingerprint:string>>>, hidden_incidents array<string>")
# fixed values: post page markup
POST_PATTERN = r'(?s)<a href="/i/status/(\d+)"[^>]*>.*?<div class="tweet-content[^"]*"[^>]*>(.*?)</div>'
POST_TIME_PATTERN = r'<span class="tweet-date"[^>]*><a href[^>]*title="([^"]*)"'
THERMAL_COLUMNS = {
    "A": {"brightness": "bright_ti4", "frp": "fire_radiative_power", "satellite": "VIIRS-NPP"},
    "B": {"brightness": "brightness", "frp": "frp", "satellite": "MODIS-Aqua"},
}
# fixed values: positions in an aircraft state array
AIRCRAFT_SLOTS = ["icao24", "callsign", "origin_country", "time_position", "last_contact", "lon", "lat",
                  "baro_altitude", "on_ground", "velocity", "true_track", "vertical_rate", "sensors",
                  "geo_altitude", "squawk", "spi", "position_source"]
_AIRCRAFT_NUMBERS = {"time_position", "last_contact", "lon", "lat", "baro_altitude", "velocity", "true_track",
                     "vertical_rate", "geo_altitude"}


# --- articles ---------------------------------------------------------------

def ingest_entries(entries: DataFrame, as_of: str, per_feed: int = 20) -> DataFrame:
    """Feed entries to incident candidates: first ``per_feed`` of each feed, then
    relevance, feed registry, date, 72 h cutoff, place, casualties, type, status."""
    head = head_per_key(entries, "source", [F.col("position").asc()], per_feed).drop("rn")
    known = enrich_source(filter_relevant(head))
    dated = filter_recent(publish_ts(known, as_of, updated="updated"), as_of, 72, "published_at")
    placed = extract_location(dated)
    counted = casualties(placed, F.col("title"), "max")
    typed = classify(classify(counted, lex.INGEST_TYPES, "title", "security", "kind"),
                     lex.STATUS_WORDS, "title", "unconfirmed", "report_status")
    return with_ids(typed)


def read_articles(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    return ingest_entries(spark.read.schema(ENTRY_SCHEMA).json(path), as_of)


def parse_news_pages(pages: DataFrame, per_country: int = 5, col: str = "body") -> DataFrame:
    """Result pages (country, body) to incidents: first ``per_country`` results,
    then relevance; titles cut to 200 characters, missing source 'Unknown'. Taking
    the head of each page is an array slice, not a window over all articles."""
    page = pages.withColumn("_p", F.from_json(col, NEWS_PAGE_SCHEMA)).filter(F.col("_p.status") == "success")
    rows = page.select("country", F.posexplode(F.slice("_p.results", 1, per_country)).alias("position", "r")).select(
        "country", "position", F.coalesce("r.title", F.lit("")).alias("title"), F.col("r.link").alias("source_url"),
        F.concat(F.lit("NewsData.io - "), F.coalesce("r.source_id", F.lit("Unknown"))).alias("source"),
        F.col("r.pubDate").alias("published"))
    kept = filter_relevant(rows.filter(F.col("title") != ""))
    return (
        with_ids(kept).withColumn("kind", first_label(F.lower("title"), lex.INGEST_TYPES, "security"))
        .withColumn("title", F.substring("title", 1, 200)).withColumn("report_status", F.lit("reported"))
        .withColumn("credibility", F.lit(85)).withColumn("is_government", F.lit(False))
    )


def read_news_pages(spark: SparkSession, path: str, per_country: int = 5) -> DataFrame:
    """One JSON line per page: {"country": ..., "body": "<page JSON>"}."""
    return parse_news_pages(spark.read.schema("country string, body string").json(path), per_country)


def extract_posts(pages: DataFrame, pattern: str = POST_PATTERN, time_pattern: str | None = POST_TIME_PATTERN,
                  limit: int = 10, id_col: str = "account", html: str = "html") -> DataFrame:
    """First ``limit`` posts of each page: id and tag-free, space-collapsed text,
    with the time mark at the same position when there is one."""
    ids = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(2))
    times = (F.regexp_extract_all(F.col(html), F.lit(time_pattern), F.lit(1)) if time_pattern
             else F.array().cast("array<string>"))
    zipped = F.slice(F.arrays_zip(ids.alias("id"), texts.alias("raw")), 1, limit)
    rows = pages.select(id_col, times.alias("_times"), F.posexplode(zipped).alias("position", "p"))
    text = F.trim(F.regexp_replace(F.col("p.raw"), r"<[^>]+>", ""))
    return rows.select(
        id_col, "position", F.col("p.id").alias("post_id"),
        F.regexp_replace(text, r"\s+", " ").alias("content"),
        F.coalesce(F.try_element_at("_times", F.col("position") + 1), F.lit("")).alias("time"))


# --- thermal ----------------------------------------------------------------

def parse_thermal(raw: DataFrame, feed: str) -> DataFrame:
    """String columns of one feed to the shared thermal schema."""
    names = THERMAL_COLUMNS[feed]

    def col(name: str):
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    return raw.select(
        F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"),
        F.coalesce(col(names["brightness"]).try_cast("double"), F.lit(0.0)).alias("brightness"),
        F.coalesce(col(names["frp"]).try_cast("double"), F.lit(0.0)).alias("frp"),
        F.coalesce(col("acq_date"), F.lit("")).alias("acq_date"), F.coalesce(col("acq_time"), F.lit("")).alias("acq_time"),
        F.lit(names["satellite"]).alias("satellite"), F.coalesce(col("confidence"), F.lit("nominal")).alias("confidence"),
        F.coalesce(col("type").try_cast("int"), F.lit(0)).alias("type"),
    ).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


_THERMAL_RAW = {
    "A": "latitude string, longitude string, bright_ti4 string, fire_radiative_power string, acq_date string, "
         "acq_time string, confidence string, type string",
    "B": "latitude string, longitude string, brightness string, frp string, acq_date string, acq_time string, "
         "confidence string, type string",
}


def read_thermal(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """CSV with a header; ``enforceSchema=false`` checks the header names."""
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(_THERMAL_RAW[feed]).csv(path)
    return parse_thermal(raw, feed)


def thermal_union(feed_a: DataFrame, feed_b: DataFrame) -> DataFrame:
    return feed_a.unionByName(feed_b, allowMissingColumns=True)


# --- incidents, prices, notices, aircraft, reports, elements ----------------

def flatten_incidents(df: DataFrame) -> DataFrame:
    """Nested incident records to the flat columns the operators use."""
    return df.select(
        "id", "title", "source", "source_url",
        F.coalesce("timestamp", "published").try_cast("timestamp_ntz").alias("published"), "type", "status",
        F.coalesce("location.city", "location.name").alias("city"), F.col("location.country").alias("country"),
        F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"), "credibility", "is_government",
        *[F.col(f"casualties.{k}").alias(f"casualties_{k}") for k in ("total", "military", "civilian", "injured")],
        F.col("verification.badge").alias("badge"), F.col("verification.status").alias("verification_status"),
        "severity", "content")


def read_incident_envelope(spark: SparkSession, path: str) -> DataFrame:
    """Documents holding either an object with ``incidents`` or a bare list."""
    text = spark.read.text(path, wholetext=True)
    return parse_incident_envelope(text)


def parse_incident_envelope(text: DataFrame, col: str = "value") -> DataFrame:
    body = F.trim(F.col(col))
    rows = F.when(body.startswith("["), F.from_json(body, f"array<struct<{_fields(INCIDENT_SCHEMA)}>>")).otherwise(
        F.from_json(body, f"incidents array<struct<{_fields(INCIDENT_SCHEMA)}>>")["incidents"])
    return flatten_incidents(text.select(F.explode(rows).alias("i")).select("i.*"))


def _fields(ddl: str) -> str:
    """'a int, b struct<c:int>' -> 'a:int, b:struct<c:int>' (top level only)."""
    out, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind.strip()}")
            part = ""
        else:
            part += ch
    return ",".join(out)


def parse_price_charts(raw: DataFrame, col: str = "body") -> DataFrame:
    """Chart documents per symbol to price and previous close; documents without
    both are dropped."""
    meta = F.try_element_at(F.from_json(col, CHART_SCHEMA)["chart"]["result"], F.lit(1))["meta"]
    rows = raw.withColumn("_m", meta).withColumn("price", F.col("_m.regularMarketPrice")).withColumn(
        "prev_close", F.col("_m.chartPreviousClose")).drop("_m", col)
    return rows.filter(F.col("price").isNotNull() & F.col("prev_close").isNotNull())


def read_price_charts(spark: SparkSession, path: str) -> DataFrame:
    return parse_price_charts(spark.read.schema("symbol string, body string").json(path))


def read_notams(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(f"notams array<struct<{_fields(NOTAM_SCHEMA)}>>").json(path, multiLine=True)
    return parse_notams(doc)


def parse_notams(doc: DataFrame) -> DataFrame:
    rows = doc.select(F.explode("notams").alias("n")).select("n.*")
    return rows.select(
        "id", "icao", "airport", "country", "content", "category", "severity",
        F.col("coordinates.lat").alias("lat"), F.col("coordinates.lng").alias("lng"),
        *[F.col(c).try_cast("timestamp_ntz").alias(c) for c in ("valid_from", "valid_until", "issued_at")])


def parse_aircraft_states(raw: DataFrame, col: str = "body") -> DataFrame:
    """Positional state arrays to named columns. Mixed-type arrays are read as
    text items and numbers cast by slot."""
    states = F.from_json(col, "states array<array<string>>")["states"]
    rows = raw.select(F.explode(states).alias("s"))
    return rows.select(*[
        (F.try_element_at("s", F.lit(i)).try_cast("double") if name in _AIRCRAFT_NUMBERS
         else F.try_element_at("s", F.lit(i))).alias(name)
        for i, name in enumerate(AIRCRAFT_SLOTS, 1)])


def read_aircraft_states(spark: SparkSession, path: str) -> DataFrame:
    return parse_aircraft_states(spark.read.text(path, wholetext=True), "value")


def parse_reports(doc: DataFrame) -> DataFrame:
    """Report store (incident -> list of reports) to one row per report."""
    per_incident = doc.select(F.explode("reports").alias("incident_id", "rs"))
    return per_incident.select("incident_id", F.explode("rs").alias("r")).select(
        "incident_id", F.col("r.timestamp").try_cast("timestamp_ntz").alias("ts"), "r.reason", "r.details",
        "r.fingerprint")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return parse_reports(spark.read.schema(REPORT_SCHEMA).json(path, multiLine=True))


def read_elements(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Element sets from JSON lines (name, norad_id, kind, line1, line2), or the
    seed list."""
    from vigilake.operators.orbit import parse_elements

    cols = ["name", "norad_id", "kind", "line1", "line2"]
    raw = (dims.seed_table(spark, dims.ELEMENTS, cols) if path is None
           else spark.read.schema(", ".join(f"{c} string" for c in cols)).json(path))
    return parse_elements(raw)
