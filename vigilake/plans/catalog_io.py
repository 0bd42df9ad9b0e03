"""Queries over readers, writers and streams. Raw documents are rendered from
the event rows by Spark, then parsed back by the reader under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.functions import dims, lexicons as lex
from vigilake.operators import discourse, enrich, markets, moderation, stats, temporal, verify
from vigilake.operators.filters import active_notams
from vigilake.plans.adapter import (AS_OF, INCIDENTS, NOTAMS, PRICES, REPORTS, THERMAL, incidents, sql_view, table, view, with_views)
from vigilake.plans.catalog_dedup import articles, grouped, groups_sql, ordered_sql
from vigilake.plans.catalog_enrich import CODE_SQL, SEVERITY_SQL, THREAT_SQL, _city, _land, _posts, casualties_sql
from vigilake.plans.catalog_stats import CLOSE_SQL, SESSION_SQL, _FIRST_REPORTS, _FP, _REASONS, _judged, VERDICT_SQL, stats_rows
from vigilake.plans.registry import CHECKS, any_sql, label_sql, list_sql, map_sql, q, query, values_sql
from vigilake.session import cut, fresh_path
from vigilake.sources import readers, writers
from vigilake.streaming import streams

_T = f"TIMESTAMP '{AS_OF}'"


# --- sources ----------------------------------------------------------------

def _entries(spark, d):
    return incidents(spark, d).select("id", "source", "title", "source_url", "published",
                                      F.lit(None).cast("timestamp_ntz").alias("updated"), (-F.col("seq")).alias("position"))


_URL_DATE = (
    "coalesce(TRY_CAST(nullif(regexp_extract(u, '/(\\d{4})/jan/(\\d{1,2})/', 1), '') || '-01-' || lpad(regexp_extract(u, '/(\\d{4})/jan/(\\d{1,2})/', 2), 2, '0') AS TIMESTAMP), "
    "TRY_CAST(nullif(regexp_extract(u, '/(\\d{4})/(\\d{2})/(\\d{2})/', 1), '') || '-' || regexp_extract(u, '/(\\d{4})/(\\d{2})/(\\d{2})/', 2) || '-' || regexp_extract(u, '/(\\d{4})/(\\d{2})/(\\d{2})/', 3) AS TIMESTAMP), published)")


@query("ingested_entries", "S1,F1,F2,F3,J1", with_views(
    f"SELECT h.id, f.cred AS feed_credibility, coalesce(c.name, l.name, 'Unknown') AS loc_name, coalesce(c.country2, l.country2, f.country) AS loc_country, {label_sql('lower(title)', lex.INGEST_TYPES, 'security')} AS kind, "
    f"{label_sql('lower(title)', lex.STATUS_WORDS, 'unconfirmed')} AS report_status, k.total AS cas_total FROM (SELECT *, {_URL_DATE} AS pub, {_city} AS ck, {_land} AS lk FROM (SELECT *, lower(source_url) AS u, row_number() OVER (PARTITION BY source ORDER BY -seq) AS rn FROM incidents) WHERE rn <= 20 AND {any_sql('lower(title)', lex.RELEVANCE_WORDS)}) h "
    f"JOIN {values_sql(dims.FEEDS, 'f', ['name', 'country', 'cred', 'gov'])} ON f.name = h.source "
    f"LEFT JOIN {values_sql(dims.INGEST_CITIES, 'c', ['key', 'name', 'country2', 'lat2', 'lng2'])} ON c.key = ck LEFT JOIN {values_sql(dims.INGEST_COUNTRIES, 'l', ['key', 'name', 'country2', 'lat2', 'lng2'])} ON l.key = lk "
    f"JOIN ({casualties_sql('incidents', 'id', 'title', 'max')}) k ON k.id = h.id WHERE pub >= {_T} - INTERVAL '72' HOUR"))
def _(spark, d):
    return readers.ingest_entries(_entries(spark, d), AS_OF).select(
        "id", "feed_credibility", "loc_name", "loc_country", "kind", "report_status", "cas_total")


@query("news_pages", "S2", with_views(
    f"SELECT id, position, t AS title, {label_sql('lower(t)', lex.INGEST_TYPES, 'security')} AS kind, source FROM (SELECT id, p AS position, CASE WHEN p % 3 = 2 THEN '' WHEN p = 4 THEN 'calm day no ' || id ELSE title || ' part ' || p END AS t, "
    "'NewsData.io - ' || CASE WHEN p = 1 THEN 'Unknown' ELSE 'src' || id % 7 END AS source FROM incidents, (SELECT unnest(range(0, 5)) AS p)) "
    f"WHERE t <> '' AND {any_sql('lower(t)', lex.RELEVANCE_WORDS)}"))
def _(spark, d):
    page = F.expr(
        "to_json(named_struct('status', 'success', 'results', transform(sequence(0, 6), p -> named_struct('title', "
        "CASE WHEN p % 3 = 2 THEN '' WHEN p = 4 THEN 'calm day no ' || id ELSE title || ' part ' || p END, 'link', source_url, "
        "'source_id', CASE WHEN p = 1 THEN NULL ELSE 'src' || id % 7 END, 'pubDate', CAST(published AS STRING)))))")
    pages = incidents(spark, d).select(F.col("id").cast("string").alias("country"), page.alias("body"))
    return readers.parse_news_pages(pages).select(
        F.col("country").cast("bigint").alias("id"), F.col("position").cast("bigint").alias("position"), "title", "kind", "source")


_LINK = r'(?s)<a href="/([^"]*)">(.*?)</a>'


@query("page_posts", "S3,W4", "SELECT page_id, CAST(pos - 1 AS INT) AS position, ids[pos] AS post_id, trim(regexp_replace(trim(regexp_replace(txt[pos], '<[^>]+>', '', 'g')), '\\s+', ' ', 'g')) AS content FROM "
       f"(SELECT page_id, ids, txt, unnest(range(1, least(10, len(ids)) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, {q(_LINK)}, 1) AS ids, regexp_extract_all(html, {q(_LINK)}, 2) AS txt FROM pages))")
def _(spark, d):
    return readers.extract_posts(table(spark, d, "pages"), _LINK, None, 10, "page_id").select(
        "page_id", "position", "post_id", "content")


_RAW_A = {"latitude": "CASE WHEN id % 13 = 0 THEN 'bad' ELSE CAST(latitude AS STRING) END", "longitude": "CAST(longitude AS STRING)",
          "bright_ti4": "CAST(brightness AS STRING)", "fire_radiative_power": "CASE WHEN id % 11 = 0 THEN '' ELSE CAST(frp AS STRING) END",
          "acq_date": "acq_date", "confidence": "confidence", "type": "CASE WHEN id % 2 = 0 THEN '2' ELSE 'x' END"}


@query("thermal_feeds", "S4,S5", with_views(
    "SELECT satellite, acq_date, count(*) AS n, round(sum(frp), 3) AS frp, round(sum(brightness), 3) AS brightness, CAST(sum(type) AS BIGINT) AS types FROM (SELECT 'VIIRS-NPP' AS satellite, acq_date, CASE WHEN id % 11 = 0 THEN 0 ELSE frp END AS frp, brightness, CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS type FROM thermal WHERE id % 13 <> 0 "
    "UNION ALL SELECT 'MODIS-Aqua', acq_date, frp, brightness, 0 FROM thermal) GROUP BY 1, 2"))
def _(spark, d):
    rows = view(spark, d, THERMAL)
    a = readers.parse_thermal(rows.selectExpr(*[f"{e} AS {n}" for n, e in _RAW_A.items()]), "A")
    b = readers.parse_thermal(rows.selectExpr("CAST(latitude AS STRING) AS latitude", "CAST(longitude AS STRING) AS longitude",
                                              "CAST(brightness AS STRING) AS brightness", "CAST(frp AS STRING) AS frp", "acq_date"), "B")
    return readers.thermal_union(a, b).groupBy("satellite", "acq_date").agg(
        F.count("*").alias("n"), F.round(F.sum("frp"), 3).alias("frp"), F.round(F.sum("brightness"), 3).alias("brightness"),
        F.sum("type").alias("types"))


@query("incident_envelope", "S6,Q11", with_views(
    "SELECT id, title, country, city, lat, casualties_total, badge, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM incidents"))
def _(spark, d):
    one = ("named_struct('id', id, 'title', title, 'source', source, 'published', CAST(published AS STRING), 'type', type, 'location', "
           "named_struct('name', city, 'country', country, 'lat', lat, 'lng', lng), 'casualties', named_struct('total', casualties_total), "
           "'verification', named_struct('badge', badge))")
    docs = incidents(spark, d).selectExpr(
        f"CASE WHEN id % 2 = 0 THEN to_json(named_struct('generated_at', 'x', 'incidents', array({one}))) ELSE to_json(array({one})) END AS value")
    return readers.parse_incident_envelope(docs).select(
        "id", "title", "country", "city", "lat", "casualties_total", "badge",
        F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("price_charts", "S7,P37", with_views(
    "SELECT seq, symbol, round(price, 4) AS price, round(price * 0.5, 4) AS prev_close FROM prices WHERE seq % 9 <> 0 AND seq % 10 <> 0"))
def _(spark, d):
    docs = view(spark, d, PRICES).selectExpr(
        "seq", "symbol", "CASE WHEN seq % 10 = 0 THEN '{\"chart\":{\"result\":null}}' ELSE to_json(named_struct('chart', named_struct('result', array(named_struct('meta', "
        "named_struct('regularMarketPrice', CASE WHEN seq % 9 = 0 THEN NULL ELSE price END, 'chartPreviousClose', price * CAST(0.5 AS DOUBLE))))))) END AS body")
    return readers.parse_price_charts(docs).select("seq", "symbol", F.round("price", 4).alias("price"), F.round("prev_close", 4).alias("prev_close"))


@query("notam_snapshot", "S8", with_views("SELECT CAST(id AS STRING) AS id, icao, severity, strftime(valid_until, '%Y-%m-%d %H:%M:%S') AS valid_until FROM notams"))
def _(spark, d):
    docs = view(spark, d, NOTAMS).selectExpr("to_json(named_struct('notams', array(named_struct('id', CAST(id AS STRING), 'icao', icao, 'severity', severity, 'valid_from', CAST(valid_from AS STRING), 'valid_until', CAST(valid_until AS STRING))))) AS body")
    parsed = docs.select(F.from_json("body", f"notams array<struct<{readers._fields(readers.NOTAM_SCHEMA)}>>").alias("p")).select("p.notams")
    return readers.parse_notams(parsed).select("id", "icao", "severity", F.date_format("valid_until", "yyyy-MM-dd HH:mm:ss").alias("valid_until"))


_STATE = ("array(array(lower(hex(id)), CASE WHEN id % 4 = 0 THEN '  ' ELSE 'CS' || id END, country, CAST(unix_seconds(CAST(published AS TIMESTAMP)) AS STRING), NULL, CAST(lng AS STRING), "
          "CASE WHEN id % 8 = 0 THEN NULL ELSE CAST(lat * CASE WHEN id % 10 = 0 THEN 9 ELSE 1 END AS STRING) END, CAST(value * 10 AS STRING), 'false', CAST(value AS STRING)))")


def _aircraft(spark, d):
    from vigilake.operators.filters import filter_valid_coords

    docs = incidents(spark, d).selectExpr(f"to_json(named_struct('time', 0, 'states', {_STATE}), map('ignoreNullFields', 'false')) AS body")
    return filter_valid_coords(readers.parse_aircraft_states(docs), "lat", "lon")


@query("aircraft_states", "S9,P40,F7", with_views(
    "SELECT lower(hex(id)) AS icao24, CASE WHEN id % 4 = 0 THEN lower(hex(id)) ELSE 'CS' || id END AS label, coalesce(country, 'Unknown') AS origin, round(lat * CASE WHEN id % 10 = 0 THEN 9 ELSE 1 END, 6) AS lat, CAST(floor(value * 10 + 0.5) AS BIGINT) AS altitude_m, "
    "CAST(floor(value * CAST(3.6 AS DOUBLE) + 0.5) AS BIGINT) AS speed_kmh FROM incidents WHERE id % 8 <> 0 AND lat * CASE WHEN id % 10 = 0 THEN 9 ELSE 1 END BETWEEN -90 AND 90"))
def _(spark, d):
    return markets.aircraft_view(_aircraft(spark, d)).select(
        "icao24", "label", "origin", F.round("lat", 6).alias("lat"), "altitude_m", "speed_kmh")


@query("report_store", "S10", with_views("SELECT incident_id, reason, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM reports GROUP BY 1, 2"))
def _(spark, d):
    docs = view(spark, d, REPORTS).selectExpr("map(incident_id, array(named_struct('timestamp', CAST(ts AS STRING), 'reason', reason, 'details', details, 'fingerprint', ip))) AS reports")
    return readers.parse_reports(docs).groupBy("incident_id", "reason").agg(
        F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@query("element_lines", "S11", with_views(
    "SELECT id, e.norad_id, CAST(trim(substring(line2, 53, 11)) AS DOUBLE) AS mean_motion, CAST(trim(substring(line2, 9, 8)) AS DOUBLE) AS inclination, CAST('0.' || substring(line2, 27, 7) AS DOUBLE) AS eccentricity, "
    f"CAST(trim(substring(line1, 21, 12)) AS DOUBLE) AS epoch_day FROM incidents JOIN {values_sql(dims.ranked(dims.ELEMENTS), 'e', ['name', 'norad_id', 'kind', 'line1', 'line2', 'pos'])} ON e.pos = id % 10"))
def _(spark, d):
    from vigilake.operators.orbit import parse_elements

    lines = dims.seed_table(spark, dims.ranked(dims.ELEMENTS), ["name", "norad_id", "kind", "line1", "line2", "pos"])
    landed = incidents(spark, d).select("id", (F.col("id") % 10).alias("pos")).join(lines, "pos")
    return parse_elements(landed).select("id", "norad_id", "mean_motion", "inclination", "eccentricity", "epoch_day")


# --- sinks ------------------------------------------------------------------

_CONFIDENCE = CHECKS["article_confidence"]
_FULL_SIGNATURE = ("substring(md5(" + label_sql("lower(title)", lex.EVENT_TYPES, "incident") + " || ':' || CASE WHEN len(f) = 0 THEN 'unknown' ELSE array_to_string(f, ',') END || ':' || "
                   "strftime(published, '%Y-%m-%dT%H:%M:%S.%f')), 1, 16)")


@query("stored_incidents", "K1", (
    f"SELECT v.seq, {_FULL_SIGNATURE} AS signature, c.confidence, strftime(i.published, '%Y-%m-%d') AS day FROM ({ordered_sql('seq')}) v JOIN "
    "(SELECT *, list_filter(" + list_sql(sorted(lex.SIGNATURE_PLACES)) + f", lambda w: contains(lower(concat_ws(', ', city, country)), w)) AS f FROM ({sql_view(INCIDENTS)})) i ON i.seq = v.seq "
    f"JOIN ({_CONFIDENCE}) c ON c.id = i.id WHERE v.status = 'accepted'"))
def _(spark, d):
    from vigilake.operators import screening

    verdicts = cut(screening.screen_articles(articles(spark, d), metric="levenshtein"))
    path = fresh_path(spark, "incidents")
    writers.write_incidents(screening.accepted_articles(verdicts, AS_OF), screening.rejected_articles(verdicts), path)
    return spark.read.parquet(f"{path}/incidents").select("seq", "signature", "confidence", F.col("published_date").cast("string").alias("day"))


@query("stored_groups", "K2", groups_sql("SELECT group_id, badge, CAST(score AS INT) AS score, members, num_sources FROM groups"))
def _(spark, d):
    members = cut(grouped(spark, d, "levenshtein"))
    path = fresh_path(spark, "groups")
    writers.write_groups(verify.build_groups(members), members, path)
    return spark.read.schema("group_id bigint, badge string, score int, members bigint, num_sources bigint").json(f"{path}/groups")


@query("stored_regional_stats", "K4", f"SELECT scope, label, incidents, casualties_total, missiles_launched FROM ({CHECKS['regional_stats']})")
def _(spark, d):
    path = fresh_path(spark, "regional")
    writers.write_regional_stats(stats_rows(spark, d), path)
    return spark.read.schema("scope string, label string, incidents bigint, casualties_total bigint, missiles_launched bigint").json(f"{path}/regional")


@query("stored_threats", "K5", with_views(THREAT_SQL))
def _(spark, d):
    path = fresh_path(spark, "threats")
    writers.write_threats(enrich.threat_indicators(_posts(spark, d)), path)
    stored = spark.read.schema("post_id bigint, account_name string, threat_indicators array<string>, threat_severity string").json(f"{path}/threats")
    return stored.select("post_id", "account_name", F.array_join("threat_indicators", "|").alias("indicators"), "threat_severity")


@query("stored_prices", "K7", with_views(
    f"SELECT symbol, day, round((price - prev_close) / prev_close * 100, 2) AS change FROM ({CLOSE_SQL}) WHERE price <> 0 AND prev_close <> 0"))
def _(spark, d):
    path = fresh_path(spark, "prices")
    writers.write_prices(markets.price_change(markets.previous_close(view(spark, d, PRICES))), path)
    return spark.read.schema("symbol string, day string, change double").json(path)


@query("stored_notams", "K8", with_views("SELECT severity, count(*) AS n FROM notams GROUP BY 1"))
def _(spark, d):
    path = fresh_path(spark, "notams")
    writers.write_notams(view(spark, d, NOTAMS), path)
    return spark.read.schema("severity string, n bigint").json(f"{path}/counts")


@query("stored_report_status", "K6", with_views(
    "SELECT incident_id, count(*) AS reports, count(*) >= 5 AS is_hidden FROM acc GROUP BY 1", fr=_FIRST_REPORTS,
    acc=f"SELECT * FROM ({VERDICT_SQL}) WHERE starts_with(verdict, 'accepted')"))
def _(spark, d):
    path = fresh_path(spark, "report-status")
    writers.write_report_status(moderation.accepted_reports(_judged(spark, d)), path)
    return spark.read.schema("incident_id string, reports bigint, is_hidden boolean").json(path)


@query("csv_export", "K9", with_views(
    "SELECT id, concat_ws(',', CAST(id AS STRING), '\"' || replace(title, '\"', '\"\"') || '\"', coalesce(country, 'Unknown'), type, " + SEVERITY_SQL
    + ", strftime(published, '%Y-%m-%dT%H:%M:%S'), source, CAST(lat AS STRING), CAST(lng AS STRING), CAST(casualties_total AS STRING)) AS line FROM incidents"))
def _(spark, d):
    return writers.csv_lines(incidents(spark, d))


@query("geojson_export", "K10", with_views(
    "SELECT id, CAST(to_json({'type': 'Feature', 'properties': {'id': id, 'title': title, 'country': country, 'type': type, 'severity': " + SEVERITY_SQL
    + ", 'published': strftime(published, '%Y-%m-%dT%H:%M:%S'), 'source': source}, 'geometry': {'type': 'Point', 'coordinates': [lng, lat]}}) AS VARCHAR) AS feature FROM incidents WHERE lat <> 0 AND lng <> 0"))
def _(spark, d):
    return writers.geojson_features(incidents(spark, d))


@query("json_export", "K11", with_views("SELECT id, title, casualties_total FROM incidents"))
def _(spark, d):
    path = fresh_path(spark, "json")
    writers.export_json(incidents(spark, d), path)
    return spark.read.schema("id bigint, title string, casualties_total int").json(path)


# --- streams ----------------------------------------------------------------

def stream(spark, d, columns):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = streams.read_table_stream(spark, f"{d}/events.parquet")
    return events.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


@query("streamed_recent", "T1", with_views("SELECT id, type FROM incidents"))
def _(spark, d):
    rows = streams.with_event_time(stream(spark, d, INCIDENTS)).select("id", "type")
    return streams.run_to_parquet(rows, "recent")


@query("streamed_signatures", "T2", with_views(
    "SELECT DISTINCT signature FROM (SELECT " + "substring(md5(" + label_sql("lower(title)", lex.EVENT_TYPES, "incident")
    + " || ':' || CASE WHEN len(f) = 0 THEN 'unknown' ELSE array_to_string(f, ',') END || ':' || strftime(published, '%Y-%m-%d')), 1, 16) AS signature FROM (SELECT *, list_filter("
    + list_sql(sorted(lex.SIGNATURE_PLACES)) + ", lambda w: contains(lower(concat_ws(', ', city, country)), w)) AS f FROM incidents))"))
def _(spark, d):
    rows = stream(spark, d, INCIDENTS).withColumn("location", F.concat_ws(", ", "city", "country")).withColumn(
        "date", F.date_format("published", "yyyy-MM-dd"))
    return streams.run_to_parquet(streams.distinct_signatures(rows).select("signature"), "signatures")


@query("streamed_screening", "T3", ordered_sql("seq"))
def _(spark, d):
    rows = stream(spark, d, INCIDENTS).select(
        "seq", "title", F.concat_ws(", ", "city", "country").alias("location"),
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date"), "source", F.col("description").alias("content"), "published")
    return streams.screen_stream(rows, metric="levenshtein").select("seq", "status", "matched_seq")


def _closed(width_hours: int) -> str:
    return f"(SELECT max(published) - INTERVAL '{72 + width_hours}' HOUR FROM incidents)"


@query("streamed_daily_severity", "T4", with_views(
    "SELECT strftime(day, '%Y-%m-%d') AS day, severity_level, n FROM (SELECT date_trunc('day', published) AS day, coalesce(severity, 'medium') AS severity_level, count(*) AS n FROM incidents GROUP BY 1, 2) WHERE day <= "
    + _closed(24)))
def _(spark, d):
    out = streams.run_to_parquet(streams.tumbling_counts(stream(spark, d, INCIDENTS)), "daily")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "severity_level", "n")


_ARRIVALS = "SELECT *, id % 2 AS arrival, CASE WHEN id % 14 = 1 THEN published - INTERVAL '480' HOUR ELSE published END AS moved FROM incidents"


@query("streamed_late_rows", "T1,T4", with_views(
    "SELECT strftime(day, '%Y-%m-%d') AS day, severity_level, count(*) AS n FROM (SELECT arrival, date_trunc('day', moved) AS day, coalesce(severity, 'medium') AS severity_level FROM p), "
    "(SELECT max(moved) FILTER (arrival = 0) - INTERVAL '72' HOUR AS closed, max(moved) - INTERVAL '72' HOUR AS done FROM p) "
    "WHERE (arrival = 0 OR day + INTERVAL '24' HOUR > closed) AND day + INTERVAL '24' HOUR <= done GROUP BY 1, 2", p=_ARRIVALS))
def _(spark, d):
    rows = incidents(spark, d).selectExpr(
        "id % 2 AS arrival", "severity", "CASE WHEN id % 14 = 1 THEN published - INTERVAL '480' HOUR ELSE published END AS published")
    parts = [rows.filter(f"arrival = {k}").drop("arrival") for k in (0, 1)]
    out = streams.run_arrivals(parts, streams.tumbling_counts, "late")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "severity_level", "n")


@query("streamed_sliding_types", "T5", with_views(
    "SELECT strftime(h, '%Y-%m-%d %H:%M') AS window_start, type, count(*) AS n FROM (SELECT type, date_trunc('hour', published) - INTERVAL '1' HOUR * k AS h FROM incidents, (SELECT unnest(range(0, 24)) AS k)) WHERE h <= "
    + _closed(24) + " GROUP BY 1, 2"))
def _(spark, d):
    out = streams.run_to_parquet(streams.sliding_counts(stream(spark, d, INCIDENTS)), "sliding")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "type", "n")


@query("streamed_sessions", "T6", with_views(
    f"SELECT user_id AS visitor, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, visits FROM (SELECT user_id, min(published) AS started, max(published) AS ended, count(*) AS visits FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY published, id) AS sid FROM "
    "(SELECT *, CASE WHEN published - lag(published) OVER (PARTITION BY user_id ORDER BY published, id) < INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM incidents)) GROUP BY user_id, sid) "
    "WHERE ended + INTERVAL '30' MINUTE <= (SELECT max(published) - INTERVAL '72' HOUR FROM incidents)"))
def _(spark, d):
    visits = stream(spark, d, {"user_id": "user_id", "ts": "ts"})
    out = streams.run_to_parquet(streams.session_counts(visits), "sessions")
    return out.select("visitor", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "visits")


@query("streamed_moderation", "T7", with_views(f"SELECT seq, incident_id, verdict FROM ({VERDICT_SQL})", fr=_FIRST_REPORTS))
def _(spark, d):
    return streams.run_to_parquet(streams.moderate(stream(spark, d, REPORTS)), "moderation").select("seq", "incident_id", "verdict")


# all incidents walk their reports side by side; releasing lifts the flag, not the count
_RELEASES = (f"SELECT seq, incident_id, {_FP} AS fp, reason IN ({_REASONS}) AS valid, seq % 50 = 0 AS unhide, "
             "row_number() OVER (PARTITION BY incident_id ORDER BY ts, seq) AS rn FROM reports")
_RELEASE_VERDICT = ("CASE WHEN r.unhide THEN CASE WHEN w.hidden THEN 'released' ELSE 'not_hidden' END WHEN NOT r.valid THEN 'invalid_reason' "
                    "WHEN w.hidden THEN 'under_review' WHEN list_contains(w.devices, r.fp) THEN 'already_reported' "
                    "WHEN w.n + 1 >= 5 THEN 'accepted_hidden' ELSE 'accepted' END")


@query("streamed_moderation_with_release", "T8", (
    "WITH RECURSIVE " + with_views("", reports_in="SELECT * FROM reports").removeprefix("WITH ").strip() + f", r AS MATERIALIZED ({_RELEASES}), "
    "walk(incident_id, i, n, hidden, devices, seq, verdict) AS (SELECT DISTINCT incident_id, 0::BIGINT, 0, false, []::VARCHAR[], NULL::BIGINT, NULL::VARCHAR FROM r UNION ALL "
    "SELECT incident_id, i + 1, CASE WHEN starts_with(v, 'accepted') THEN n + 1 ELSE n END, CASE WHEN unhide THEN false ELSE hidden OR v = 'accepted_hidden' END, "
    "CASE WHEN starts_with(v, 'accepted') THEN list_append(devices, fp) ELSE devices END, seq, v FROM "
    f"(SELECT w.incident_id, w.i, w.n, w.hidden, w.devices, r.seq, r.fp, r.unhide, {_RELEASE_VERDICT} AS v FROM walk w JOIN r ON r.incident_id = w.incident_id AND r.rn = w.i + 1)) "
    "SELECT seq, incident_id, verdict, n AS reports, hidden AS is_hidden FROM walk WHERE i > 0"))
def _(spark, d):
    rows = stream(spark, d, REPORTS).withColumn("action", F.when(F.col("seq") % 50 == 0, "unhide").otherwise("report"))
    return streams.run_to_parquet(streams.moderate(rows), "release").select("seq", "incident_id", "verdict", "reports", "is_hidden")


@query("streamed_latest_positions", "T9", with_views(
    "SELECT user_id AS icao24, round(max_by(lat, (published, id)), 6) AS lat, round(max_by(lng, (published, id)), 6) AS lon FROM incidents GROUP BY 1"))
def _(spark, d):
    rows = stream(spark, d, INCIDENTS).select(F.col("user_id").alias("icao24"), "lat", F.col("lng").alias("lon"), F.col("published").alias("ts"))
    out = streams.run_upserts(streams.latest_positions(rows), "positions", "icao24")
    return out.select("icao24", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("streamed_active_notams", "T10", with_views(
    "SELECT id, icao FROM notams WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00' < valid_until"))
def _(spark, d):
    rows = streams.active_notices(stream(spark, d, NOTAMS), "2024-01-15 12:00:00").select("id", "icao")
    return streams.run_to_parquet(rows, "notams")
