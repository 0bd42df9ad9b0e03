"""Queries over row filters, projections and dimension joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.functions import dims, lexicons as lex
from vigilake.operators import enrich, filters, geo, markets, thermal, weather
from vigilake.plans.adapter import (AS_OF, NOTAMS, REPORTS, THERMAL, WEATHER, incidents, table, view, with_views)
from vigilake.plans.registry import (any_sql, count_sql, first_sql, label_sql, list_sql, map_sql, q, query,
                                     values_sql)

_T = f"TIMESTAMP '{AS_OF}'"
SEVERITY_SQL = (f"CASE WHEN badge = 'CRITICAL' THEN 'critical' WHEN {any_sql('lower(title)', lex.HIGH_SEVERITY_WORDS)} "
                f"THEN 'high' WHEN {any_sql('lower(title)', lex.MEDIUM_SEVERITY_WORDS)} THEN 'medium' ELSE 'low' END")
CODE_SQL = map_sql("lower(country)", dict(dims.COUNTRY_ALIASES), "'unknown'")


# --- filters ----------------------------------------------------------------

@query("relevant_documents", "F1", f"SELECT doc_id, source FROM documents WHERE {any_sql('lower(text)', lex.RELEVANCE_WORDS)}")
def _(spark, d):
    return filters.filter_relevant(table(spark, d, "documents"), col="text").select("doc_id", "source")


@query("relevant_by_lexicon_table", "F1,J5",
       f"SELECT doc_id AS id FROM documents WHERE {any_sql('lower(text)', lex.RELEVANCE_WORDS)}")
def _(spark, d):
    words = dims.seed_table(spark, lex.RELEVANCE_WORDS, ["keyword"])
    return filters.filter_relevant(table(spark, d, "documents"), words, col="text").select(F.col("doc_id").alias("id"))


@query("relevant_by_long_lexicon", "F1,J5",
       f"SELECT doc_id AS id FROM documents WHERE {any_sql('lower(text)', lex.RELEVANCE_WORDS)}")
def _(spark, d):
    words = dims.seed_table(spark, lex.RELEVANCE_WORDS, ["keyword"])
    return filters.holding_any(table(spark, d, "documents"), words, "text").select(F.col("doc_id").alias("id"))


@query("recent_incidents", "F2", with_views(f"SELECT id FROM incidents WHERE published >= {_T} - INTERVAL '72' HOUR"))
def _(spark, d):
    return filters.filter_recent(incidents(spark, d), AS_OF, 72).select("id")


@query("last_fourteen_days", "F5", with_views(f"SELECT id FROM incidents WHERE published >= {_T} - INTERVAL '336' HOUR"))
def _(spark, d):
    return filters.filter_days(incidents(spark, d), AS_OF, 14).select("id")


@query("head_per_feed", "F3,W4", with_views(
    "SELECT source, id, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn "
    "FROM incidents) WHERE rn <= 20"))
def _(spark, d):
    return filters.head_per_key(incidents(spark, d), "source", [F.asc("seq")], 20).select("source", "id", "rn")


@query("facet_filter", "F4", with_views(
    f"SELECT id, title FROM incidents WHERE {CODE_SQL} IN ('iran', 'israel', 'uae') AND {SEVERITY_SQL} IN ('high', 'medium') "
    f"AND lower(type) IN ('missile', 'attack', 'drone') AND published >= {_T} - INTERVAL '168' HOUR "
    "AND (contains(lower(title), 'drone') OR contains(lower(source), 'drone') OR contains(lower(country), 'drone'))"))
def _(spark, d):
    return filters.facet_filter(
        incidents(spark, d), AS_OF, country=["iran", "israel", "uae"], severity=["high", "medium"],
        type=["missile", "attack", "drone"], time="7d", search="drone").select("id", "title")


@query("facet_by_credibility", "F17", with_views(
    f"SELECT id, credibility FROM incidents WHERE credibility >= 90 AND {CODE_SQL} IN ('uae')"))
def _(spark, d):
    return filters.facet_filter(incidents(spark, d), AS_OF, country=["uae"], min_credibility=90).select("id", "credibility")


@query("critical_events", "F6", with_views("SELECT id FROM incidents WHERE severity = 'critical' ORDER BY seq LIMIT 5"))
def _(spark, d):
    return filters.critical_events(incidents(spark, d)).select("id")


@query("valid_coordinates", "F7", with_views(
    "SELECT id FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'n/a' WHEN id % 7 = 0 THEN CAST(lat * 9 AS STRING) ELSE CAST(lat AS STRING) END AS la, "
    "CAST(lng AS STRING) AS lo FROM incidents) WHERE TRY_CAST(la AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(lo AS DOUBLE) BETWEEN -180 AND 180"))
def _(spark, d):
    raw = incidents(spark, d).selectExpr(
        "id", "CASE WHEN id % 5 = 0 THEN 'n/a' WHEN id % 7 = 0 THEN CAST(lat * 9 AS STRING) ELSE CAST(lat AS STRING) END AS la",
        "CAST(lng AS STRING) AS lo")
    return filters.filter_valid_coords(raw, "la", "lo").select("id")


@query("inside_box", "F8", with_views("SELECT id FROM incidents WHERE lat BETWEEN 12 AND 35 AND lng BETWEEN 34 AND 60"))
def _(spark, d):
    return filters.filter_bbox(incidents(spark, d), "thermal").select("id")


@query("notams_by_severity", "F9", with_views("SELECT id, icao FROM notams WHERE severity = 'CRITICAL'"))
def _(spark, d):
    return filters.filter_notams(view(spark, d, NOTAMS), "CRITICAL").select("id", "icao")


@query("active_notams", "T10", with_views(
    "SELECT id, icao FROM notams WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00' < valid_until"))
def _(spark, d):
    return filters.active_notams(view(spark, d, NOTAMS), "2024-01-15 12:00:00").select("id", "icao")


DEFENSE_SQL = (f"SELECT *, {CODE_SQL} AS country_code FROM incidents WHERE (lower(type) IN ('missile', 'air_defense', 'drone', 'attack') "
               f"OR {any_sql('lower(title)', lex.DEFENSE_WORDS)}) AND {CODE_SQL} <> 'unknown'")


@query("defense_relevant", "F11", with_views(f"SELECT id, country_code FROM ({DEFENSE_SQL})"))
def _(spark, d):
    return filters.defense_relevant(incidents(spark, d)).select("id", "country_code")


@query("airspace_alerts", "F13", with_views(
    "SELECT id, type FROM incidents WHERE type IN ('air_defense', 'alert') AND coalesce(lat, 0) <> 0 AND coalesce(lng, 0) <> 0"))
def _(spark, d):
    return filters.airspace_alerts(incidents(spark, d)).select("id", "type")


ISO_SQL = map_sql("lower(country)", {n.lower(): c for c, n in dims.ISO_NAMES}, "NULL")


def _with_countries(df):
    return df.withColumn("countries", F.array_compact(F.array(enrich.iso2(F.col("country")))))


@query("incidents_of_country", "F14", with_views(f"SELECT id FROM incidents WHERE {ISO_SQL} = 'IL'"))
def _(spark, d):
    return filters.filter_country(_with_countries(incidents(spark, d)), "IL").select("id")


@query("arabic_titles", "F15", "SELECT doc_id, false AS has_arabic FROM documents")
def _(spark, d):
    return filters.flag_arabic(table(spark, d, "documents"), "text").select("doc_id", "has_arabic")


@query("arabic_documents", "F15", "SELECT doc_id, doc_id % 3 = 0 AND text IS NOT NULL AS has_arabic FROM documents")
def _(spark, d):
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" \u062e\u0628\u0631"))).otherwise(F.col("text"))
    return filters.flag_arabic(table(spark, d, "documents").withColumn("text", marked), "text").select("doc_id", "has_arabic")


@query("hot_detections", "F12", with_views("SELECT id, round(frp, 4) AS frp FROM thermal WHERE frp > 50 ORDER BY id LIMIT 5"))
def _(spark, d):
    return filters.new_hotspots(view(spark, d, THERMAL)).select("id", F.round("frp", 4).alias("frp"))


# --- classification and text ------------------------------------------------

for _name, _ids, _lexicon, _default in (
    ("event_type", "P1", lex.EVENT_TYPES, "incident"), ("grouping_type", "P1", lex.GROUPING_TYPES, "incident"),
    ("ingest_type", "P2", lex.INGEST_TYPES, "security"), ("report_status_words", "P4", lex.STATUS_WORDS, "unconfirmed"),
):
    def _classified(spark, d, lexicon=_lexicon, default=_default):
        return enrich.classify(incidents(spark, d), lexicon, "title", default).select("id", "label")

    query(_name, _ids, with_views(f"SELECT id, {label_sql('lower(title)', _lexicon, _default)} AS label FROM incidents"))(_classified)


@query("document_event_type", "P1", f"SELECT label, count(*) AS n FROM (SELECT {label_sql('lower(text)', lex.EVENT_TYPES, 'incident')} AS label FROM documents) GROUP BY 1")
def _(spark, d):
    return enrich.classify(table(spark, d, "documents"), lex.EVENT_TYPES, "text", "incident").groupBy("label").agg(
        F.count("*").alias("n"))


_TEXT = "lower(title || ' ' || description)"


@query("stats_type", "P3", with_views(
    f"SELECT id, stats_type, CAST({map_sql('stats_type', lex.STATS_TYPE_CONFIDENCE, '0.5')} AS DOUBLE) AS stats_confidence FROM "
    f"(SELECT id, {label_sql(_TEXT, lex.STATS_TYPES, 'general')} AS stats_type FROM incidents)"))
def _(spark, d):
    return enrich.classify_with_confidence(incidents(spark, d), "title", "description").select(
        "id", "stats_type", "stats_confidence")


@query("place_keywords", "P5", with_views(
    f"SELECT id, CASE WHEN len(found) = 0 THEN 'unknown' ELSE array_to_string(found, ',') END AS places FROM "
    f"(SELECT id, list_filter({list_sql(sorted(lex.SIGNATURE_PLACES))}, lambda w: contains(lower(title || ' ' || coalesce(country, '')), w)) AS found FROM incidents)"))
def _(spark, d):
    text = F.lower(F.concat_ws(" ", "title", F.coalesce("country", F.lit(""))))
    return incidents(spark, d).select("id", enrich.place_keywords(text).alias("places"))


_city = first_sql("lower(title)", [r[0] for r in dims.INGEST_CITIES])
_land = first_sql("lower(title)", [r[0] for r in dims.INGEST_COUNTRIES])


@query("extracted_location", "P6,J5", with_views(
    "SELECT id, coalesce(c.name, l.name, 'Unknown') AS loc_name, CASE WHEN c.name IS NULL AND l.name IS NULL THEN coalesce(country, 'none') "
    "ELSE coalesce(c.country2, l.country2) END AS loc_country, CAST(coalesce(c.lat2, l.lat2, 25.0) AS DOUBLE) AS loc_lat, "
    "CAST(coalesce(c.lng2, l.lng2, 45.0) AS DOUBLE) AS loc_lng FROM "
    f"(SELECT *, {_city} AS ck, {_land} AS lk FROM incidents) i "
    f"LEFT JOIN {values_sql(dims.INGEST_CITIES, 'c', ['key', 'name', 'country2', 'lat2', 'lng2'])} ON c.key = ck "
    f"LEFT JOIN {values_sql(dims.INGEST_COUNTRIES, 'l', ['key', 'name', 'country2', 'lat2', 'lng2'])} ON l.key = lk"))
def _(spark, d):
    rows = incidents(spark, d).withColumn("feed_country", F.coalesce("country", F.lit("none")))
    return enrich.extract_location(rows).select("id", "loc_name", "loc_country", "loc_lat", "loc_lng")


_pt = "lower(title || ' ' || description)"
_scores = ", ".join(f"{{'s': {count_sql(_pt, ws)}, 'r': {-i}, 'c': {q(c)}}}" for i, (c, ws) in enumerate(lex.COUNTRY_MENTIONS.items()))
_boxes = "CASE " + " ".join(f"WHEN lat > {a} AND lat < {b} AND lng > {c} AND lng < {e} THEN {q(n)}" for n, a, b, c, e in lex.COUNTRY_BOXES) + " ELSE 'unknown' END"


@query("dominant_country", "P8,J6", with_views(
    f"SELECT id, CASE WHEN best.s > 0 THEN best.c ELSE {_boxes} END AS stats_country FROM "
    f"(SELECT *, list_max([{_scores}]) AS best FROM incidents)"))
def _(spark, d):
    text = F.concat_ws(" ", "title", "description")
    return enrich.dominant_country(incidents(spark, d), text, F.col("lat"), F.col("lng")).select("id", "stats_country")


def _found_sql(text: str, patterns) -> str:
    return "list_concat(" * (len(patterns) - 1) + f"regexp_extract_all({text}, {q(patterns[0])}, 1)" + "".join(
        f", regexp_extract_all({text}, {q(p)}, 1))" for p in patterns[1:])


def _context_sql(text: str, m: str, reach: int) -> str:
    pos = f"(strpos({text}, {m}) - 1)"
    return f"substring({text}, greatest(0, {pos} - {reach}) + 1, {pos} + {reach} - greatest(0, {pos} - {reach}))"


def casualties_sql(source: str, key: str, text: str, mode: str) -> str:
    if mode == "max":
        mil = any_sql(_context_sql("t", "found[-1]", 150), lex.MILITARY_CONTEXT_MAX)
        return (f"SELECT {key}, total, CASE WHEN mil THEN num ELSE 0 END AS military, CASE WHEN num = 0 THEN total WHEN mil THEN 0 ELSE num END AS civilian "
                f"FROM (SELECT {key}, coalesce(list_max(list_transform(found, lambda m: CAST(m AS BIGINT))), 0) AS total, coalesce(CAST(found[-1] AS BIGINT), 0) AS num, "
                f"coalesce({mil}, false) AS mil FROM (SELECT {key}, t, list_filter({_found_sql('t', lex.CASUALTY_PATTERNS_MAX)}, lambda m: TRY_CAST(m AS BIGINT) IS NOT NULL) AS found "
                f"FROM (SELECT {key}, lower({text}) AS t FROM {source})))")
    mil = any_sql(_context_sql("t", "m", 100), lex.MILITARY_CONTEXT_SUM)
    return (f"SELECT {key}, total, military, total - military AS civilian FROM (SELECT {key}, "
            f"CAST(coalesce(list_sum(list_transform(found, lambda m: CAST(m AS BIGINT))), 0) AS BIGINT) AS total, "
            f"CAST(coalesce(list_sum(list_transform(found, lambda m: CASE WHEN {mil} THEN CAST(m AS BIGINT) ELSE 0 END)), 0) AS BIGINT) AS military FROM "
            f"(SELECT {key}, t, list_filter({_found_sql('t', lex.CASUALTY_PATTERNS_SUM)}, lambda m: TRY_CAST(m AS BIGINT) IS NOT NULL) AS found FROM (SELECT {key}, lower({text}) AS t FROM {source})))")


@query("casualties_max", "P9,Q18", with_views(casualties_sql("incidents", "id", "title", "max")))
def _(spark, d):
    return enrich.casualties(incidents(spark, d), F.col("title"), "max", "c").select(
        "id", F.col("c_total").alias("total"), F.col("c_military").alias("military"), F.col("c_civilian").alias("civilian"))


@query("casualties_sum", "P10,Q18", with_views(casualties_sql("incidents", "id", "title || ' ' || description", "sum")))
def _(spark, d):
    return enrich.casualties(incidents(spark, d), F.concat_ws(" ", "title", "description"), "sum", "c").select(
        "id", F.col("c_total").alias("total"), F.col("c_military").alias("military"), F.col("c_civilian").alias("civilian"))


@query("publish_time", "P11", with_views(
    "SELECT id, strftime(coalesce(TRY_CAST(nullif(regexp_extract(u, '/(\\d{4})/(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/(\\d{1,2})/', 1), '') || '-01-' || "
    "lpad(regexp_extract(u, '/(\\d{4})/(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/(\\d{1,2})/', 3), 2, '0') AS TIMESTAMP), "
    "TRY_CAST(nullif(regexp_extract(u, '/(\\d{4})/(\\d{2})/(\\d{2})/', 1), '') || '-' || regexp_extract(u, '/(\\d{4})/(\\d{2})/(\\d{2})/', 2) || '-' || "
    "regexp_extract(u, '/(\\d{4})/(\\d{2})/(\\d{2})/', 3) AS TIMESTAMP), published), '%Y-%m-%d %H:%M:%S') AS published_at FROM (SELECT id, published, lower(source_url) AS u FROM incidents)"))
def _(spark, d):
    return enrich.publish_ts(incidents(spark, d), AS_OF).select(
        "id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


def recap_sql(text: str) -> str:
    parts = [f"CASE WHEN contains({text}, {q(w)}) THEN CAST({v} AS DOUBLE) ELSE 0 END" for w, v in lex.RECAP_PHRASES]
    parts.append(f"CASE WHEN {count_sql(text, lex.SIGNATURE_PLACES)} > 3 THEN CAST(1.5 AS DOUBLE) ELSE 0 END")
    parts += [f"CASE WHEN regexp_matches({text}, {q(p)}) THEN CAST(1 AS DOUBLE) ELSE 0 END" for p in lex.RECAP_PATTERNS]
    return "(" + " + ".join(parts) + ")"


@query("recap_score", "P12,Q2", with_views(
    "SELECT id, s AS recap_score, s >= 2.5 AS is_recap, s > 3.0 AS recap_dropped, round(least(s / 5.0, CAST(1 AS DOUBLE)), 4) AS recap_confidence FROM "
    f"(SELECT id, {recap_sql('t')} AS s FROM (SELECT id, lower(title || ' ' || description) AS t FROM incidents))"))
def _(spark, d):
    return enrich.recap_score(incidents(spark, d), "title", "description").select(
        "id", "recap_score", "is_recap", "recap_dropped", F.round("recap_confidence", 4).alias("recap_confidence"))


@query("document_recap_score", "P12", f"SELECT doc_id, {recap_sql('t')} AS recap_score FROM (SELECT doc_id, lower(source || ' ' || text) AS t FROM documents)")
def _(spark, d):
    return enrich.recap_score(table(spark, d, "documents"), "source", "text").select("doc_id", "recap_score")


_points = " + ".join(f"CASE WHEN {any_sql(f'lower({c})', ws)} THEN {n} ELSE 0 END" for n, c, ws in lex.CONFIDENCE_POINTS)


@query("article_confidence", "P13,Q1", with_views(
    "SELECT id, p AS confidence_points, CASE WHEN p >= 70 THEN 'VERIFIED' WHEN p >= 50 THEN 'LIKELY' WHEN p >= 30 THEN 'PARTIAL' ELSE 'OSINT' END AS confidence FROM "
    f"(SELECT id, CAST({_points} + CASE WHEN s < 21600 THEN 10 WHEN s < 86400 THEN 5 ELSE 0 END AS INT) AS p FROM "
    f"(SELECT *, (epoch_us({_T}) - epoch_us(published)) // 1000000 AS s FROM incidents))"))
def _(spark, d):
    return enrich.confidence(incidents(spark, d), AS_OF).select("id", "confidence_points", "confidence")


def _signed(spark, d):
    rows = incidents(spark, d).withColumn("location", F.concat_ws(", ", "city", "country")).withColumn(
        "date", F.date_format("published", "yyyy-MM-dd"))
    return enrich.signature(rows)


SIGNATURE_SQL = (
    f"SELECT id, seq, substring(md5({label_sql('lower(title)', lex.EVENT_TYPES, 'incident')} || ':' || "
    f"CASE WHEN len(f) = 0 THEN 'unknown' ELSE array_to_string(f, ',') END || ':' || strftime(published, '%Y-%m-%d')), 1, 16) AS signature "
    f"FROM (SELECT *, list_filter({list_sql(sorted(lex.SIGNATURE_PLACES))}, lambda w: contains(lower(concat_ws(', ', city, country)), w)) AS f FROM incidents)")


@query("event_signature", "P14", with_views(f"SELECT id, signature FROM ({SIGNATURE_SQL})"))
def _(spark, d):
    return _signed(spark, d).select("id", "signature")


@query("stable_ids", "P15")
def _(spark, d):
    return enrich.event_ids(enrich.with_ids(incidents(spark, d)), AS_OF).select("id", "incident_id", "event_id")


@query("event_id_numbers", "P15", with_views(
    f"SELECT id, 'EV-' || CAST(epoch_ms(CAST({q(AS_OF)} AS TIMESTAMP)) AS VARCHAR) || '-' || "
    "CASE WHEN length(CAST(seq AS VARCHAR)) >= 4 THEN CAST(seq AS VARCHAR) ELSE lpad(CAST(seq AS VARCHAR), 4, '0') END AS event_id FROM incidents"))
def _(spark, d):
    return enrich.event_ids(incidents(spark, d), AS_OF).select("id", "event_id")


@query("normalized_text", "P16", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', '', 'g'))) AS unicode_form, "
       "md5(trim(replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '  ', ' '))) AS ascii_form FROM documents")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(enrich.normalize_text(t).cast("binary")).alias("unicode_form"),
        F.md5(enrich.normalize_name(t).cast("binary")).alias("ascii_form"))


@query("location_key", "P17,Q13", with_views(
    "SELECT id, CASE WHEN country IS NULL THEN coalesce(" + first_sql("lower(title)", lex.GROUPING_PLACES)
    + ", lower(city) || '_') ELSE lower(city) || '_' || lower(country) END AS location_key FROM incidents"))
def _(spark, d):
    return incidents(spark, d).select("id", enrich.location_key(F.col("country"), F.col("city"), F.col("title")).alias("location_key"))


TIER_SQL = (f"CASE WHEN is_government THEN 'government' WHEN {any_sql('lower(source)', lex.MAJOR_NEWS)} THEN 'major_news' "
            f"WHEN {any_sql('lower(source)', lex.REGIONAL_NEWS)} THEN 'regional_news' ELSE 'social' END")


@query("source_tier", "P18", with_views(
    f"SELECT id, {TIER_SQL} AS tier, {label_sql('lower(source)', lex.RELIABILITY_GROUPS, 'Other')} AS reliability_group FROM incidents"))
def _(spark, d):
    return incidents(spark, d).select("id", enrich.source_tier(F.col("source"), F.col("is_government")).alias("tier"),
                                      enrich.reliability_group(F.col("source")).alias("reliability_group"))


@query("ui_severity", "P19,Q17", with_views(f"SELECT id, {SEVERITY_SQL} AS level FROM incidents"))
def _(spark, d):
    return incidents(spark, d).select("id", enrich.ui_severity(F.col("title"), F.col("badge")).alias("level"))


_flags = {r[0]: r[3] for r in dims.COUNTRIES}


@query("canonical_country", "P20", with_views(
    f"SELECT id, country_code, CASE WHEN country_code = 'unknown' THEN 'UNKNOWN' ELSE {map_sql('country_code', dict(dims.DISPLAY_NAMES), 'upper(country_code)')} END AS display_name, "
    f"{map_sql('country_code', _flags, q('🌍'))} AS flag FROM (SELECT id, {CODE_SQL} AS country_code FROM incidents)"))
def _(spark, d):
    return enrich.canonical_country(incidents(spark, d)).select("id", "country_code", "display_name", "flag")


@query("age_bucket", "P21", with_views(
    "SELECT id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age_label, "
    "CASE WHEN s < 300 THEN 'under 5m' WHEN s < 1800 THEN '5-30m' WHEN s < 3600 THEN '30-60m' ELSE 'over 1h' END AS freshness FROM "
    f"(SELECT id, (epoch_us({_T}) - epoch_us(published)) // 1000000 AS s FROM incidents)"))
def _(spark, d):
    return enrich.age_bucket(incidents(spark, d), AS_OF).select("id", "age_label", "freshness")


def sentiment_sql(source: str, key: str, text: str) -> str:
    def terms(words):
        return f"list_filter({list_sql(sorted(words))}, lambda w: list_contains(tk, w))"
    return (f"SELECT {key}, round(raw, 1) AS sentiment_score, CASE WHEN raw > 10 THEN 'positive' WHEN raw < -10 THEN 'negative' ELSE 'neutral' END AS sentiment, "
            f"CAST(least(100, 10 * len(ct)) AS INT) AS critical_score, array_to_string(pt, ' ') AS positive_terms, array_to_string(nt, ' ') AS negative_terms, array_to_string(ct, ' ') AS critical_terms "
            f"FROM (SELECT *, CAST(len(pt) - len(nt) AS DOUBLE) / greatest(1, len(tk)) * CAST(100 AS DOUBLE) AS raw FROM (SELECT *, {terms(lex.POSITIVE_WORDS)} AS pt, "
            f"{terms(lex.NEGATIVE_WORDS)} AS nt, {terms(lex.CRITICAL_WORDS)} AS ct FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda t: t <> '')) AS tk FROM {source})))")


def _sentiment_rows(df, key, col):
    return enrich.sentiment(df, col).select(
        key, "sentiment_score", "sentiment", "critical_score",
        *[F.array_join(c, " ").alias(c) for c in ("positive_terms", "negative_terms", "critical_terms")])


@query("title_sentiment", "P22,Q28", with_views(sentiment_sql("incidents", "id", "title")))
def _(spark, d):
    return _sentiment_rows(incidents(spark, d), "id", "title")


@query("document_sentiment", "P22", sentiment_sql("documents", "doc_id", "text"))
def _(spark, d):
    return _sentiment_rows(table(spark, d, "documents"), "doc_id", "text")


@query("critical_alerts", "F6", with_views(
    "SELECT id, sentiment, critical_score FROM (SELECT * FROM (" + sentiment_sql("incidents", "id", "title || ' ' || description")
    + ") WHERE critical_score > 10 ORDER BY id LIMIT 10) WHERE sentiment = 'negative'"))
def _(spark, d):
    rows = incidents(spark, d).withColumn("t", F.concat_ws(" ", "title", "description"))
    return filters.alerts(enrich.sentiment(rows, "t"), 10, 10, "negative").select("id", "sentiment", "critical_score")


@query("hashtags", "P23", "SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '#(\\w+)', 1)) AS tag FROM documents) GROUP BY 1, 2")
def _(spark, d):
    return enrich.hashtags(table(spark, d, "documents"), "text").groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


#: A landed post marks its long words with a hash sign.
_TAGGED = r"(^| )(\w{9,})"


@query("tagged_posts", "P23", "SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(post, '#(\\w+)', 1)) AS tag FROM "
       f"(SELECT doc_id, regexp_replace(text, {q(_TAGGED)}, '\\1#\\2', 'g') AS post FROM documents)) GROUP BY 1, 2")
def _(spark, d):
    posts = table(spark, d, "documents").withColumn("post", F.regexp_replace("text", _TAGGED, "$1#$2"))
    return enrich.hashtags(posts, "post").groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query("source_profile", "P24", with_views(
    "SELECT id, coalesce(p.reliability, 0.5) AS reliability, coalesce(p.bias, 'unknown') AS bias, coalesce(p.c, 'unknown') AS source_country FROM incidents LEFT JOIN "
    f"(SELECT name, c, CAST(reliability AS DOUBLE) AS reliability, bias FROM {values_sql(dims.SOURCE_PROFILES, 'v', ['name', 'c', 'reliability', 'bias'])}) p ON p.name = source"))
def _(spark, d):
    return enrich.source_profile(incidents(spark, d)).select("id", "reliability", "bias", "source_country")


ENTITY_SQL = (
    f"SELECT id, 'country_' || code AS entity_id, {map_sql('code', dict(dims.ISO_NAMES), 'code')} AS entity_name, 'nation' AS entity_type, "
    f"{map_sql('code', dict(dims.ISO_NAMES), 'code')} AS alias1, code AS alias2 FROM (SELECT id, {ISO_SQL} AS code FROM incidents) WHERE code IS NOT NULL "
    f"UNION ALL SELECT id, 'org_' || lower(o.code), o.name, 'organization', o.code, o.name FROM incidents JOIN {values_sql(dims.ORGANIZATIONS, 'o', ['code', 'name'])} ON contains(lower(title), lower(o.code))")


def entity_mentions(spark, d):
    return enrich.extract_entities(_with_countries(incidents(spark, d)))


@query("entity_mentions", "P25,J5", with_views(f"SELECT id, entity_id, entity_name, entity_type FROM ({ENTITY_SQL})"))
def _(spark, d):
    return entity_mentions(spark, d).select("id", "entity_id", "entity_name", "entity_type")


ACTOR_SQL = (f"SELECT *, CASE WHEN ac IS NOT NULL THEN a END AS actor, CASE WHEN a IS NOT NULL THEN ac END AS action FROM "
             f"(SELECT *, {label_sql('lower(title)', lex.ACTORS, None)} AS a, {label_sql('lower(title)', lex.ACTIONS, None)} AS ac FROM incidents)")


@query("actor_action", "P26", with_views(f"SELECT id, actor, action FROM ({ACTOR_SQL})"))
def _(spark, d):
    return enrich.actor_action(incidents(spark, d)).select("id", "actor", "action")


def _posts(spark, d):
    handles = [a[0] for a in dims.ACCOUNTS]
    pick = "split_part('" + "|".join(handles) + f"', '|', CAST(user_id % {len(handles)} AS INT) + 1)"
    return incidents(spark, d).selectExpr("id AS post_id", "title || ' ' || description AS content", f"{pick} AS account")


_handle = "split_part('" + "|".join(a[0] for a in dims.ACCOUNTS) + f"', '|', CAST(user_id % {len(dims.ACCOUNTS)} AS INT) + 1)"
THREAT_SQL = (
    f"SELECT id AS post_id, a.name AS account_name, array_to_string(k, '|') AS indicators, CASE WHEN len(k) >= 2 THEN 'high' ELSE 'medium' END AS threat_severity FROM "
    f"(SELECT id, {_handle} AS handle, list_filter({list_sql(lex.THREAT_WORDS)}, lambda w: contains(lower(title || ' ' || description), w)) AS k FROM incidents) p "
    f"JOIN {values_sql(dims.ACCOUNTS, 'a', ['handle', 'name', 'country', 'cred'])} USING (handle) WHERE len(k) > 0")


@query("threat_posts", "P27", with_views(THREAT_SQL))
def _(spark, d):
    return enrich.threat_indicators(_posts(spark, d)).select(
        "post_id", "account_name", F.array_join("threat_indicators", "|").alias("indicators"), "threat_severity")


# --- thermal, weather, places ----------------------------------------------

FIRE_SQL = (
    "SELECT *, CASE WHEN frp > 100 THEN 'industrial_large' WHEN frp > 50 THEN 'industrial_medium' WHEN brightness > 350 THEN 'gas_flare' WHEN frp > 20 THEN 'wildfire' ELSE 'controlled_burn' END AS fire_type, "
    "CASE confidence WHEN 'high' THEN CASE WHEN base = 'low' THEN 'medium' ELSE 'high' END WHEN 'low' THEN CASE WHEN base = 'high' THEN 'medium' ELSE 'low' END ELSE base END AS risk_level, brightness > 320 AS is_thermal_anomaly "
    "FROM (SELECT *, CASE WHEN frp > 100 THEN 'high' WHEN frp > 50 OR brightness > 350 OR frp > 20 THEN 'medium' ELSE 'low' END AS base FROM thermal)")


@query("fire_classes", "P28", with_views(f"SELECT id, fire_type, risk_level, is_thermal_anomaly FROM ({FIRE_SQL})"))
def _(spark, d):
    return thermal.classify_fires(view(spark, d, THERMAL)).select("id", "fire_type", "risk_level", "is_thermal_anomaly")


REGION_SQL = "CASE " + " ".join(f"WHEN latitude BETWEEN {a} AND {b} AND longitude BETWEEN {c} AND {e} THEN {q(n)}" for n, a, b, c, e in dims.THERMAL_REGIONS) + " ELSE 'Other' END"


@query("thermal_region", "P29", with_views(f"SELECT id, {REGION_SQL} AS region FROM thermal"))
def _(spark, d):
    return view(spark, d, THERMAL).select("id", thermal.region_of(F.col("latitude"), F.col("longitude")).alias("region"))


@query("region_join", "J6", with_views(f"SELECT id, {REGION_SQL} AS region FROM thermal"))
def _(spark, d):
    boxes = dims.seed_table(spark, dims.ranked(dims.THERMAL_REGIONS),
                            ["region", "lat_min", "lat_max", "lng_min", "lng_max", "priority"])
    return thermal.region_join(view(spark, d, THERMAL), boxes).select("id", "region")


def _ladder(col: str, how: str, rules, pick: int, default: str) -> str:
    op = {"lt": "<", "gt": ">", "eq": "="}[how]
    return "CASE " + " ".join(f"WHEN {col} {op} {q(r[0]) if isinstance(r[0], str) else r[0]} THEN {q(r[pick]) if isinstance(r[pick], str) else r[pick]}" for r in rules) + f" ELSE {default} END"


IMPACT_SQL = (
    "SELECT *, CASE WHEN raw >= 80 THEN 'severe' WHEN raw >= 50 THEN 'high' WHEN raw >= 25 THEN 'moderate' ELSE 'minimal' END AS impact_level, least(100, raw) AS impact_score FROM (SELECT *, "
    + " + ".join(_ladder(c, h, r, 1, "0") for c, h, r in weather.IMPACT_RULES) + " AS raw, list_filter(["
    + ", ".join(_ladder(c, h, r, 2, "NULL") for c, h, r in weather.IMPACT_RULES) + "], lambda x: x IS NOT NULL) AS factors FROM {source})")


@query("weather_impact", "P30", with_views(
    "SELECT id, impact_level, CAST(impact_score AS INT) AS impact_score, array_to_string(factors, '; ') AS factors, "
    + map_sql("impact_level", weather.RECOMMENDATIONS, "NULL") + f" AS recommendation FROM ({IMPACT_SQL.format(source='weather')})"))
def _(spark, d):
    return weather.weather_impact(view(spark, d, WEATHER)).select(
        "id", "impact_level", "impact_score", F.array_join("factors", "; ").alias("factors"), "recommendation")


@query("sea_state", "P31", with_views("SELECT id, CASE WHEN wind_speed < 3 THEN 1 WHEN wind_speed < 5 THEN 2 WHEN wind_speed < 7 THEN 3 ELSE 4 END AS sea_state FROM weather"))
def _(spark, d):
    return weather.sea_state(view(spark, d, WEATHER)).select("id", "sea_state")


# --- the rest ---------------------------------------------------------------

FLAGS_SQL = (
    "SELECT *, ({hit}) AS is_intercepted, NOT ({hit}) AND (lower(type) IN ('missile', 'attack') OR {imp}) AS is_impacted FROM {source}").replace(
    "{hit}", any_sql("lower(title)", lex.INTERCEPTION_WORDS) + " OR lower(type) = 'air_defense'").replace(
    "{imp}", any_sql("lower(title)", lex.IMPACT_WORDS))


@query("interception_flags", "P39", with_views(f"SELECT id, is_intercepted, is_impacted FROM ({FLAGS_SQL.replace('{source}', 'incidents')})"))
def _(spark, d):
    return enrich.interception_flags(incidents(spark, d)).select("id", "is_intercepted", "is_impacted")


@query("time_keys", "P41", with_views(
    "SELECT id, strftime(published, '%Y-%m-%d %H:00') AS hour_key, strftime(published, '%Y-%m-%d') AS day_key, strftime(published, '%Y-W%U') AS week_key FROM incidents"))
def _(spark, d):
    return incidents(spark, d).select("id", *[enrich.time_key(F.col("published"), b).alias(f"{b}_key") for b in ("hour", "day", "week")])


_url = "trim(source_url)"
SAFE_SQL = (
    "SELECT *, replace(replace(replace(replace(replace(t0, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS safe_text, "
    "CASE WHEN " + " OR ".join(f"starts_with(lower({_url}), {q(s)})" for s in lex.DANGEROUS_SCHEMES)
    + f" THEN '#' WHEN NOT contains({_url}, '://') AND starts_with({_url}, '/') THEN {_url} WHEN NOT contains({_url}, '://') THEN 'https://' || {_url} WHEN NOT ("
    + " OR ".join(f"starts_with(lower({_url}), {q(s)})" for s in lex.ALLOWED_SCHEMES) + f") THEN '#' ELSE {_url} END AS safe_url, "
    "substring(regexp_replace(raw_id, '[^a-zA-Z0-9\\-_]', '', 'g'), 1, 100) AS safe_id FROM "
    "(SELECT *, title || CASE WHEN id % 4 = 0 THEN ' <b>\"x\" & ''y''</b>' ELSE '' END AS t0, CASE WHEN id % 5 = 0 THEN 'inc<' || id || '>' ELSE 'inc-' || id END AS raw_id, "
    f"CASE WHEN id % 6 = 0 THEN 'I1' ELSE coalesce({ISO_SQL}, 'ZZZ') END AS country_iso FROM incidents)")


def _dirty(spark, d):
    return incidents(spark, d).selectExpr(
        "*", "title || CASE WHEN id % 4 = 0 THEN ' <b>\"x\" & \\'y\\'</b>' ELSE '' END AS t0",
        "CASE WHEN id % 5 = 0 THEN 'inc<' || id || '>' ELSE 'inc-' || id END AS raw_id").withColumn(
        "country_iso", F.when(F.col("id") % 6 == 0, "I1").otherwise(F.coalesce(enrich.iso2(F.col("country")), F.lit("ZZZ"))))


@query("sanitized_rows", "P42", with_views(f"SELECT id, safe_text, safe_url, safe_id FROM ({SAFE_SQL})"))
def _(spark, d):
    return enrich.sanitize(_dirty(spark, d), "t0").select("id", "safe_text", "safe_url", "safe_id")


@query("sanitize_violations", "P42", with_views(
    "SELECT source, count(*) AS rows, count(*) FILTER (safe_text <> t0) AS text_changed, count(*) FILTER (safe_url = '#') AS url_refused, "
    f"count(*) FILTER (safe_id <> raw_id) AS id_changed, count(*) FILTER (NOT regexp_matches(country_iso, '^[a-zA-Z]{{2}}$')) AS code_invalid FROM ({SAFE_SQL}) GROUP BY source"))
def _(spark, d):
    return enrich.violations(enrich.sanitize(_dirty(spark, d), "t0"))


@query("device_fingerprint", "P43,Q29", with_views(
    "SELECT seq, substring(sha256(incident_id || ':' || user_agent || ':' || CASE WHEN ip = '' THEN 'no-ip' ELSE substring(sha256(ip), 1, 16) END), 1, 16) AS fingerprint FROM reports"))
def _(spark, d):
    return enrich.fingerprint(view(spark, d, REPORTS)).select("seq", "fingerprint")


@query("display_labels", "P44", with_views(
    f"SELECT id, substring(title, 1, 100) AS title_100, {map_sql('type', dims.TYPE_NAMES, 'type')} AS type_name, "
    f"{map_sql('type', dims.TYPE_SHORT_LABELS, 'substring(upper(type), 1, 3)')} AS type_short FROM incidents"))
def _(spark, d):
    return enrich.display_labels(incidents(spark, d)).select("id", "title_100", "type_name", "type_short")


_nn = "trim(replace(regexp_replace(lower({c}), '[^a-z0-9\\s]', '', 'g'), '  ', ' '))"


@query("name_similarity", "P45,Q8", with_views(
    "SELECT id, round(CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE greatest(0.0, 1.0 - CAST(greatest(length(a), length(b)) - least(length(a), length(b)) AS DOUBLE) / greatest(length(a), length(b)) * 0.5) END, 6) AS sim "
    f"FROM (SELECT id, {_nn.format(c='source')} AS a, {_nn.format(c='city')} AS b FROM incidents)"))
def _(spark, d):
    return incidents(spark, d).select("id", F.round(enrich.name_similarity(F.col("source"), F.col("city")), 6).alias("sim"))


@query("feed_registry_join", "J1", with_views(
    f"SELECT id, f.country AS feed_country, f.cred AS feed_credibility, f.gov AS feed_government FROM incidents JOIN {values_sql(dims.FEEDS, 'f', ['name', 'country', 'cred', 'gov'])} ON f.name = source"))
def _(spark, d):
    return enrich.enrich_source(incidents(spark, d)).select("id", "feed_country", "feed_credibility", "feed_government")


@query("notam_airports", "J3,P38", with_views(
    f"SELECT id, a.name AS airport, a.country AS airport_country, {map_sql('category', dims.NOTAM_RADIUS_KM, '5')} AS radius_km, {map_sql('severity', dims.NOTAM_COLORS, q(dims.NOTAM_DEFAULT_COLOR))} AS color "
    f"FROM notams JOIN {values_sql(dims.AIRPORTS, 'a', ['icao', 'name', 'country', 'lat', 'lng'])} USING (icao)"))
def _(spark, d):
    return markets.notam_style(markets.notams_with_airports(view(spark, d, NOTAMS))).select(
        "id", "airport", "airport_country", "radius_km", "color")


# --- geocoding --------------------------------------------------------------

def _geo_rows(spark, d):
    return incidents(spark, d).selectExpr(
        "id", "title", "CASE WHEN id % 4 = 0 THEN country WHEN id % 4 = 1 THEN city WHEN id % 4 = 2 THEN '' ELSE 'Strait of Hormuz' END AS location",
        "CASE WHEN id % 9 = 0 THEN 'seen at lat ' || CAST(lat AS STRING) || ', lng ' || CAST(lng * CASE WHEN id % 2 = 0 THEN 1 ELSE 9 END AS STRING) ELSE description END AS content")


def _geocode_sql() -> str:
    cities = [r[0] for r in dims.GEO_CITIES]

    def city(t):
        return f"CASE WHEN {t} IN ({', '.join(q(c) for c in cities)}) THEN {t} ELSE {first_sql(t, cities)} END"

    def area(t):
        return (f"coalesce('country_center:' || {first_sql(t, [r[0] for r in dims.GEO_COUNTRIES])}, "
                f"'region:' || {first_sql(t, [r[0] for r in dims.GEO_REGIONS])})")

    points = []
    for p in dims.COORDINATE_PATTERNS:
        la, lo = (f"TRY_CAST(regexp_extract(t, {q(p)}, {g}) AS DOUBLE)" for g in (1, 2))
        points.append(f"CASE WHEN {la} BETWEEN -90 AND 90 AND {lo} BETWEEN -180 AND 180 THEN {{'lat': {la}, 'lng': {lo}}} END")
    places = ([(f"city_lookup:{k}", a, b) for k, a, b, _ in dims.GEO_CITIES] + [(f"country_center:{k}", a, b) for k, a, b in dims.GEO_COUNTRIES]
              + [(f"region:{k}", a, b) for k, a, b in dims.GEO_REGIONS])
    return with_views(
        "SELECT id, src AS geo_source, round(CAST(coalesce(pt.lat, p.lat, 29.0) AS DOUBLE), 4) AS geo_lat, round(CAST(coalesce(pt.lng, p.lng, 48.0) AS DOUBLE), 4) AS geo_lng, "
        "NOT starts_with(src, 'city_lookup') AND src <> 'extracted_from_text' AS geo_approximate FROM (SELECT *, CASE WHEN pt IS NOT NULL THEN 'extracted_from_text' ELSE "
        f"coalesce('city_lookup:' || {city('l')}, 'city_lookup:' || {city('ti')}, {area('l')}, {area('ti')}, 'gulf_region_center') END AS src FROM "
        f"(SELECT *, coalesce({', '.join(points)}) AS pt FROM (SELECT id, lower(title || ' ' || content) AS t, lower(coalesce(location, '')) AS l, lower(title) AS ti FROM geo_rows))) "
        f"LEFT JOIN {values_sql(places, 'p', ['key', 'lat', 'lng'])} ON p.key = src",
        geo_rows="SELECT id, title, CASE WHEN id % 4 = 0 THEN country WHEN id % 4 = 1 THEN city WHEN id % 4 = 2 THEN '' ELSE 'Strait of Hormuz' END AS location, "
        "CASE WHEN id % 9 = 0 THEN 'seen at lat ' || CAST(lat AS STRING) || ', lng ' || CAST(lng * CASE WHEN id % 2 = 0 THEN 1 ELSE 9 END AS STRING) ELSE description END AS content FROM incidents")


@query("geocode", "P7", _geocode_sql())
def _(spark, d):
    return geo.geocode(_geo_rows(spark, d), fuzzy=False).select(
        "id", "geo_source", F.round("geo_lat", 4).alias("geo_lat"), F.round("geo_lng", 4).alias("geo_lng"), "geo_approximate")


@query("geocode_with_near_names", "P7,J9")
def _(spark, d):
    misspelt = _geo_rows(spark, d).withColumn("location", F.when(
        F.col("id") % 3 == 0, F.translate(F.coalesce("location", F.lit("")), "e", "ee")).otherwise(
        F.regexp_replace(F.coalesce("location", F.lit("")), "a", "")))
    return geo.geocode(misspelt).select("id", "geo_source", "geo_lat", "geo_lng", "geo_country", "geo_approximate")


@query("nearest_place_names", "J9")
def _(spark, d):
    tokens = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("token")).filter("token <> ''")
    names = dims.seed_table(spark, [r[0] for r in dims.GEO_CITIES], ["name"])
    return geo.nearest_name(tokens, names)
