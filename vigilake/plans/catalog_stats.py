"""Queries over aggregations, windows, sequences, scenarios and moderation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.functions import dims, lexicons as lex
from vigilake.operators import (discourse, enrich, entities, filters, markets, moderation, orbit, patterns, response,
                                stats, temporal, thermal, weather)
from vigilake.plans.adapter import (AS_OF, INCIDENTS, NOTAMS, PRICES, REPORTS, THERMAL, WEATHER, incidents, table, view, with_views)
from vigilake.plans.catalog_enrich import (ACTOR_SQL, CODE_SQL, DEFENSE_SQL, ENTITY_SQL, FIRE_SQL, FLAGS_SQL, IMPACT_SQL,
                                           ISO_SQL, REGION_SQL, SEVERITY_SQL, THREAT_SQL, _posts, _with_countries,
                                           _boxes, _scores, casualties_sql, entity_mentions, sentiment_sql)
from vigilake.plans.registry import any_sql, label_sql, list_sql, map_sql, q, query, values_sql

_T = f"TIMESTAMP '{AS_OF}'"
_BAD = "coalesce(verification_status, 'UNCONFIRMED')"


# --- regional and country statistics ---------------------------------------

def stats_rows(spark, d):
    return stats.stats_facts(incidents(spark, d).withColumn("content", F.col("description")))


_pt = "lower(title || ' ' || description)"
FACTS_SQL = (
    f"SELECT i.*, {label_sql(_pt, lex.STATS_TYPES, 'general')} AS stats_type, CASE WHEN best.s > 0 THEN best.c ELSE {_boxes} END AS stats_country, c.total AS cas_total, c.military AS cas_military, c.civilian AS cas_civilian "
    f"FROM (SELECT *, list_max([{_scores}]) AS best FROM incidents) i JOIN ({casualties_sql('incidents', 'id', chr(116) + 'itle || ' + q(' ') + ' || description', 'sum')}) c USING (id)")
_MEASURE_SQL = (
    "count(*) AS incidents, CAST(sum(cas_total) AS BIGINT) AS casualties_total, CAST(sum(cas_military) AS BIGINT) AS casualties_military, CAST(sum(cas_civilian) AS BIGINT) AS casualties_civilian, "
    "count(*) FILTER (stats_type = 'missile') AS missiles_launched, "
    "count(*) FILTER (stats_type = 'missile' AND (contains(lower(title), 'intercept') OR contains(lower(title), 'shot down'))) AS missiles_intercepted, "
    "count(*) FILTER (stats_type = 'missile' AND NOT (contains(lower(title), 'intercept') OR contains(lower(title), 'shot down'))) AS missiles_landed, "
    "count(*) FILTER (stats_type = 'airstrike') AS airstrikes, count(*) FILTER (stats_type = 'drone') AS drones, "
    "count(*) FILTER (stats_type = 'drone' AND (contains(lower(title), 'downed') OR contains(lower(title), 'shot down'))) AS drones_downed")


@query("regional_stats", "A1,Q15", with_views(
    f"SELECT 'total' AS scope, 'all' AS label, {_MEASURE_SQL} FROM facts UNION ALL SELECT 'type', stats_type, {_MEASURE_SQL} FROM facts GROUP BY stats_type "
    f"UNION ALL SELECT 'country', stats_country, {_MEASURE_SQL} FROM facts WHERE stats_country <> 'unknown' GROUP BY stats_country", facts=FACTS_SQL))
def _(spark, d):
    return stats.regional_stats(stats_rows(spark, d))


RECENT_SQL = ("SELECT stats_country, id, title, stats_type, cas_total, row_number() OVER (PARTITION BY stats_country ORDER BY seq) AS position, count(*) OVER (PARTITION BY stats_country) AS n FROM "
              "(SELECT *, row_number() OVER (PARTITION BY stats_country ORDER BY seq DESC) AS rn FROM facts WHERE stats_country <> 'unknown') WHERE rn <= 10")
TREND_SQL = (f"SELECT stats_country, max(n) AS recent_incidents, CASE WHEN max(n) < 3 THEN 'stable' WHEN b > a * 1.2 THEN 'increasing' WHEN b < a * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM "
             f"(SELECT stats_country, max(n) AS n, count(*) FILTER (position <= n // 2 AND cas_total > 0) AS a, count(*) FILTER (position > n // 2 AND cas_total > 0) AS b FROM ({RECENT_SQL}) GROUP BY 1) GROUP BY stats_country, a, b")


@query("recent_per_country", "W1", with_views(f"SELECT stats_country, id, CAST(position AS INT) AS position, cas_total FROM ({RECENT_SQL})", facts=FACTS_SQL))
def _(spark, d):
    return stats.recent_per_country(stats_rows(spark, d)).select("stats_country", "id", "position", "cas_total")


@query("country_trend", "W2", with_views(TREND_SQL, facts=FACTS_SQL))
def _(spark, d):
    return stats.country_trend(stats.recent_per_country(stats_rows(spark, d))).select("stats_country", "recent_incidents", "trend")


_meas = ["incidents", "casualties_total", "casualties_military", "casualties_civilian", "missiles_launched",
         "missiles_intercepted", "missiles_landed", "airstrikes", "drones", "drones_downed"]


@query("country_stats", "A2,J12,Q23", with_views(
    "SELECT c.code, c.name, c.flag, " + ", ".join(f"coalesce(m.{m}, 0) AS {m}" for m in _meas) + ", coalesce(t.recent_incidents, 0) AS recent_incidents, coalesce(t.trend, 'stable') AS trend "
    f"FROM {values_sql(dims.COUNTRIES, 'c', ['code', 'name', 'iso', 'flag'])} LEFT JOIN (SELECT stats_country, {_MEASURE_SQL} FROM facts GROUP BY 1) m ON m.stats_country = c.code "
    f"LEFT JOIN ({TREND_SQL}) t ON t.stats_country = c.code", facts=FACTS_SQL))
def _(spark, d):
    return stats.country_stats(stats_rows(spark, d))


# --- entities and threat ----------------------------------------------------

@query("canonical_entities", "A7", with_views(
    "SELECT e.entity_id, min(entity_name) AS entity_name, min(entity_type) AS entity_type, count(*) AS event_count, any_value(al.aliases) AS aliases FROM mentions e JOIN "
    "(SELECT entity_id, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases FROM (SELECT entity_id, alias1 AS a FROM mentions UNION ALL SELECT entity_id, alias2 FROM mentions) GROUP BY 1) al USING (entity_id) GROUP BY 1", mentions=ENTITY_SQL))
def _(spark, d):
    return entities.canonical_entities(entity_mentions(spark, d)).withColumn("aliases", F.array_join("aliases", "|"))


THREAT_SCORE_SQL = (
    "SELECT *, CASE WHEN threat_score >= 80 THEN 'critical' WHEN threat_score >= 60 THEN 'high' WHEN threat_score >= 40 THEN 'medium' ELSE 'low' END AS threat_level FROM "
    "(SELECT g.code, g.events, CASE WHEN c > 2 THEN 'increasing' ELSE 'stable' END AS trend, least(100, coalesce(b.score, 30) + 5 * c + 2 * h) AS threat_score, coalesce(b.level, 'low') AS base_level, "
    f"{map_sql('g.code', dict(dims.ISO_NAMES), 'g.code')} AS name FROM (SELECT {ISO_SQL} AS code, count(*) AS events, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h "
    f"FROM src WHERE {ISO_SQL} IS NOT NULL GROUP BY 1) g LEFT JOIN {values_sql([r[:3] for r in dims.THREAT_BASELINE], 'b', ['code', 'score', 'level'])} ON b.code = g.code)")


@query("country_threat", "A8,J10", with_views(f"SELECT code, name, events, threat_score, threat_level, trend, base_level FROM ({THREAT_SCORE_SQL})", src="SELECT * FROM incidents"))
def _(spark, d):
    return entities.country_threat(_with_countries(incidents(spark, d))).select(
        "code", "name", "events", "threat_score", "threat_level", "trend", "base_level")


@query("daily_country_threat", "A8", with_views(
    "SELECT day, code, least(100, coalesce(b.score, 30) + 5 * c + 2 * h) AS threat_score FROM "
    f"(SELECT strftime(published, '%Y-%m-%d') AS day, {ISO_SQL} AS code, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM incidents WHERE {ISO_SQL} IS NOT NULL GROUP BY 1, 2) "
    f"LEFT JOIN {values_sql([r[:2] for r in dims.THREAT_BASELINE], 'b', ['code', 'score'])} USING (code)"))
def _(spark, d):
    rows = _with_countries(incidents(spark, d)).withColumn("code", F.explode("countries"))
    daily = rows.groupBy(F.date_format("published", "yyyy-MM-dd").alias("day"), "code").agg(
        F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "high").alias("h"))
    return entities.threat_baseline(daily).select(
        "day", "code", F.least(F.lit(100), F.col("base_score") + 5 * F.col("c") + 2 * F.col("h")).alias("threat_score"))


@query("threat_summary", "A9", with_views(
    f"SELECT (SELECT count(DISTINCT entity_id) FROM mentions) AS total_entities, count(*) AS total_countries, count(*) FILTER (threat_level = 'critical') AS critical_threats FROM (SELECT * FROM ({THREAT_SCORE_SQL}) ORDER BY threat_score DESC, code LIMIT 10)",
    src="SELECT * FROM incidents", mentions=ENTITY_SQL))
def _(spark, d):
    threats = entities.top_threats(entities.country_threat(_with_countries(incidents(spark, d))))
    return entities.threat_summary(entities.canonical_entities(entity_mentions(spark, d)), threats)


# --- discourse --------------------------------------------------------------

@query("sentiment_distribution", "A10", with_views(
    "SELECT count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral FROM (" + sentiment_sql("incidents", "id", "title") + ")"))
def _(spark, d):
    return discourse.sentiment_distribution(enrich.sentiment(incidents(spark, d)))


@query("top_sources", "A11", with_views("SELECT source, count(*) AS n FROM incidents GROUP BY 1 ORDER BY n DESC, source LIMIT 10"))
def _(spark, d):
    return discourse.top_counts(incidents(spark, d), "source", 10)


@query("trending_hashtags", "A11", with_views(
    "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(description, '#(\\w+)', 1)) AS tag FROM incidents) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10"))
def _(spark, d):
    return discourse.trending_hashtags(incidents(spark, d), "description")


_TREND_WORDS = ("SELECT keyword, n, CASE WHEN n > 5 THEN 'accelerating' ELSE 'stable' END AS velocity FROM (SELECT keyword, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: length(w) > 4)) AS keyword FROM {t}) "
                "GROUP BY 1 ORDER BY n DESC, keyword LIMIT 20) WHERE n >= 2 ORDER BY n DESC, keyword LIMIT 10")


@query("trending_words", "A12", with_views(_TREND_WORDS.format(c="title", t="incidents")))
def _(spark, d):
    return discourse.trending(incidents(spark, d))


@query("trending_document_words", "A12", _TREND_WORDS.format(c="text", t="documents"))
def _(spark, d):
    return discourse.trending(table(spark, d, "documents"), "text")


# --- time -------------------------------------------------------------------

_KEYS = {"hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "week": "%Y-W%U"}
for _bucket, _fmt in _KEYS.items():
    def _counts(spark, d, bucket=_bucket):
        return temporal.time_counts(incidents(spark, d), bucket)

    query(f"counts_per_{_bucket}", "A13", with_views(
        f"SELECT strftime(published, '{_fmt}') AS bucket, count(*) AS n FROM incidents GROUP BY 1"))(_counts)

SERIES_SQL = ("SELECT strftime(published, '%Y-%m-%d') AS day, count(*) AS total, " + ", ".join(
    f"count(*) FILTER (coalesce(severity, 'medium') = '{s}') AS {s}" for s in temporal.SEVERITIES)
    + f" FROM incidents WHERE published >= {_T} - INTERVAL '720' HOUR GROUP BY 1")


@query("severity_series", "A14,Q10", with_views(SERIES_SQL))
def _(spark, d):
    return temporal.severity_series(incidents(spark, d), AS_OF)


@query("series_last_days", "W8", with_views(f"SELECT day, total FROM ({SERIES_SQL}) ORDER BY day DESC LIMIT 14"))
def _(spark, d):
    return temporal.last_days(temporal.severity_series(incidents(spark, d), AS_OF), 14).select("day", "total")


ANOMALY_SQL = ("SELECT day, n, round((n - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 2) AS z_score, CASE WHEN abs((n - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END) > 3 THEN 'critical' ELSE 'high' END AS severity FROM "
               "(SELECT *, avg(n) OVER () AS m, stddev_pop(n) OVER () AS sd FROM (SELECT strftime(published, '%Y-%m-%d') AS day, count(*) AS n FROM incidents GROUP BY 1)) WHERE abs((n - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END) > {t}")


@query("daily_anomalies", "A15,W7,Q9", with_views(ANOMALY_SQL.format(t=1.2)))
def _(spark, d):
    return temporal.anomalies(incidents(spark, d), 1.2)


@query("severity_trend", "A16,Q10", with_views(
    "SELECT recent_count, older_count, critical_recent, round(x, 1) AS severity_trend_pct, CASE WHEN x > 10 THEN 'increasing' WHEN x < -10 THEN 'decreasing' ELSE 'stable' END AS direction FROM (SELECT *, CASE WHEN o > 0 THEN CAST(critical_recent - o AS DOUBLE) / o * 100 WHEN critical_recent > 0 THEN 100.0 ELSE 0.0 END AS x FROM "
    f"(SELECT count(*) FILTER (published >= c) AS recent_count, count(*) FILTER (published < c) AS older_count, count(*) FILTER (published >= c AND severity = 'critical') AS critical_recent, count(*) FILTER (published < c AND severity = 'critical') AS o FROM (SELECT *, {_T} - INTERVAL '168' HOUR AS c FROM incidents)))"))
def _(spark, d):
    return temporal.severity_trend(incidents(spark, d), AS_OF)


@query("temporal_summary", "A17", with_views(
    f"SELECT CAST(sum(n) AS BIGINT) AS total_events, min(day) AS first_day, max(day) AS last_day, (SELECT day FROM days ORDER BY n DESC, day LIMIT 1) AS peak_day, (SELECT count(*) FROM ({ANOMALY_SQL.format(t=2.0)})) AS anomaly_days FROM days",
    days="SELECT strftime(published, '%Y-%m-%d') AS day, count(*) AS n FROM incidents GROUP BY 1"))
def _(spark, d):
    return temporal.temporal_summary(incidents(spark, d))


_SPLIT = "2024-01-16 00:00:00"


def _periods(spark, d):
    rows = view(spark, d, THERMAL)
    cut = filters.at(_SPLIT)
    return rows.filter(F.col("ts") >= cut), rows.filter(F.col("ts") < cut)


CELL_SQL = ("SELECT cell_lat, cell_lng, CASE WHEN now AND old THEN 'unchanged' WHEN now THEN 'new' ELSE 'removed' END AS status FROM (SELECT round(latitude, 1) AS cell_lat, round(longitude, 1) AS cell_lng, "
            f"bool_or(ts >= TIMESTAMP '{_SPLIT}') AS now, bool_or(ts < TIMESTAMP '{_SPLIT}') AS old FROM thermal GROUP BY 1, 2) WHERE cell_lat <> 0 AND cell_lng <> 0")
CHANGE_SQL = ("SELECT n AS new_cells, r AS removed_cells, u AS unchanged_cells, round(CAST(n + r AS DOUBLE) / greatest(1, n + r + u), 3) AS change_ratio, CASE WHEN CAST(n + r AS DOUBLE) / greatest(1, n + r + u) > 0.2 THEN 'significant' ELSE 'minor' END AS magnitude FROM "
              f"(SELECT count(*) FILTER (status = 'new') AS n, count(*) FILTER (status = 'removed') AS r, count(*) FILTER (status = 'unchanged') AS u FROM ({CELL_SQL}))")


@query("cell_changes", "J13", with_views(CELL_SQL))
def _(spark, d):
    return temporal.cell_changes(*_periods(spark, d))


@query("change_summary", "A18", with_views(CHANGE_SQL))
def _(spark, d):
    return temporal.change_summary(temporal.cell_changes(*_periods(spark, d)))


@query("new_cells", "A18", with_views(f"SELECT cell_lat, cell_lng FROM ({CELL_SQL}) WHERE status = 'new' ORDER BY 1, 2 LIMIT 10"))
def _(spark, d):
    return temporal.changed_cells(temporal.cell_changes(*_periods(spark, d)))


@query("thermal_change", "A19,Q30", with_views(
    f"SELECT c.*, cn AS current_count, pn AS previous_count, round(CASE WHEN p > 0 THEN (a - p) / greatest(1.0, p) * 100 ELSE 100.0 END, 1) AS intensity_change_pct FROM ({CHANGE_SQL}) c, "
    f"(SELECT count(*) AS cn, sum(frp) / greatest(1, count(*)) AS a FROM thermal WHERE ts >= TIMESTAMP '{_SPLIT}'), (SELECT count(*) AS pn, sum(frp) / greatest(1, count(*)) AS p FROM thermal WHERE ts < TIMESTAMP '{_SPLIT}')"))
def _(spark, d):
    return temporal.thermal_change(*_periods(spark, d))


@query("thermal_analysis", "A20", with_views(
    "SELECT 'total' AS scope, 'all' AS label, count(*) AS detections, round(sum(frp), 1) AS total_frp FROM f UNION ALL SELECT 'type', fire_type, count(*), round(sum(frp), 1) FROM f GROUP BY fire_type "
    "UNION ALL SELECT 'region', region, count(*), round(sum(frp), 1) FROM f GROUP BY region", f=f"SELECT *, {REGION_SQL} AS region FROM ({FIRE_SQL})"))
def _(spark, d):
    return thermal.analyze_thermal(view(spark, d, THERMAL))


@query("thermal_hotspots", "A20", with_views(f"SELECT id, round(frp, 4) AS frp, fire_type FROM ({FIRE_SQL}) ORDER BY frp DESC, id LIMIT 10"))
def _(spark, d):
    return thermal.hotspots(view(spark, d, THERMAL)).select("id", F.round("frp", 4).alias("frp"), "fire_type")


@query("weather_summary", "A21", with_views(
    "SELECT round(avg(impact_score), 1) AS overall_risk_score, count(*) FILTER (impact_level = 'severe') AS severe_regions, count(*) FILTER (impact_level = 'high') AS high_risk_regions, "
    f"CASE WHEN count(*) FILTER (impact_level = 'severe') > 2 THEN 'degraded' ELSE 'normal' END AS readiness FROM ({IMPACT_SQL.format(source='latest')})",
    latest="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts DESC, id DESC) AS rn FROM weather) WHERE rn = 1"))
def _(spark, d):
    return weather.weather_summary(weather.weather_impact(weather.latest_per_region(view(spark, d, WEATHER))))


@query("weather_by_region", "A21", with_views(
    f"SELECT region, round(avg(impact_score), 1) AS overall_risk_score, count(*) FILTER (impact_level = 'severe') AS severe FROM ({IMPACT_SQL.format(source='weather')}) GROUP BY 1"))
def _(spark, d):
    return weather.weather_impact(view(spark, d, WEATHER)).groupBy("region").agg(
        F.round(F.avg("impact_score"), 1).alias("overall_risk_score"), F.count_if(F.col("impact_level") == "severe").alias("severe"))


# --- dashboards -------------------------------------------------------------

@query("defense_stats", "A25", with_views(
    "SELECT s.scope, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in (
        "detected", "intercepted", "impacted", "ballistic_detected", "ballistic_intercepted", "drone_detected", "drone_intercepted", "last24h_detected", "last24h_intercepted"))
    + ", CASE WHEN coalesce(intercepted + impacted, 0) > 0 THEN CAST(floor(intercepted * 100.0 / (intercepted + impacted) + 0.5) AS BIGINT) ELSE 0 END AS success_pct "
    f"FROM {values_sql([(s,) for s in ['all', *dims.DEFENSE_COUNTRIES]], 's', ['scope'])} LEFT JOIN (SELECT scope, count(*) AS detected, count(*) FILTER (h) AS intercepted, count(*) FILTER (is_impacted) AS impacted, "
    "count(*) FILTER (b) AS ballistic_detected, count(*) FILTER (b AND h) AS ballistic_intercepted, count(*) FILTER (NOT b AND dr) AS drone_detected, count(*) FILTER (NOT b AND dr AND h) AS drone_intercepted, "
    "count(*) FILTER (r) AS last24h_detected, count(*) FILTER (r AND h) AS last24h_intercepted FROM (SELECT unnest(['all', country_code]) AS scope, is_intercepted AS h, is_impacted, "
    f"lower(type) = 'missile' OR {any_sql('lower(title)', lex.BALLISTIC_WORDS)} AS b, lower(type) = 'drone' OR {any_sql('lower(title)', lex.DRONE_WORDS)} AS dr, published >= {_T} - INTERVAL '24' HOUR AS r FROM ({FLAGS_SQL.replace('{source}', 'relevant')})) GROUP BY 1) g USING (scope)",
    relevant=DEFENSE_SQL))
def _(spark, d):
    return stats.defense_stats(incidents(spark, d), AS_OF)


@query("defense_stats_one_country", "A25", with_views(
    "SELECT 'all' AS scope, count(*) AS detected, count(*) FILTER (is_intercepted) AS intercepted, count(*) FILTER (is_impacted) AS impacted "
    f"FROM ({FLAGS_SQL.replace('{source}', 'relevant')}) WHERE country_code = 'iran'", relevant=DEFENSE_SQL))
def _(spark, d):
    return stats.defense_stats(incidents(spark, d), AS_OF, "iran").filter("scope = 'all'").select(
        "scope", "detected", "intercepted", "impacted")


_REL = "CAST(floor(count(*) FILTER ({v}) * 100.0 / count(*) + 0.5) AS BIGINT) AS reliability".format(v=f"{_BAD} = 'VERIFIED'")


@query("source_reliability", "A26", with_views(
    f"SELECT source, count(*) AS reports, count(*) FILTER ({_BAD} = 'VERIFIED') AS verified, {_REL} FROM incidents GROUP BY 1 ORDER BY reports DESC, source LIMIT 5"))
def _(spark, d):
    return stats.source_reliability(incidents(spark, d))


@query("reliability_by_group", "A27", with_views(
    f"SELECT source_group, reports, sources, verified, reliability, CASE WHEN reliability >= 80 THEN 'High' WHEN reliability >= 50 THEN 'Medium' ELSE 'Low' END AS label FROM (SELECT {label_sql('lower(source)', lex.RELIABILITY_GROUPS, 'Other')} AS source_group, "
    f"count(*) AS reports, count(DISTINCT source) AS sources, count(*) FILTER ({_BAD} = 'VERIFIED') AS verified, {_REL} FROM incidents GROUP BY 1)"))
def _(spark, d):
    return stats.reliability_by_group(incidents(spark, d))


@query("severity_distribution", "A28", with_views(
    f"SELECT s.severity_level, coalesce(n, 0) AS n, CAST(floor(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM incidents) + 0.5) AS BIGINT) AS share_pct FROM {values_sql([(s,) for s in temporal.SEVERITIES], 's', ['severity_level'])} "
    f"LEFT JOIN (SELECT {SEVERITY_SQL} AS severity_level, count(*) AS n FROM incidents GROUP BY 1) USING (severity_level)"))
def _(spark, d):
    return stats.severity_distribution(incidents(spark, d))


@query("intensity_index", "A29", with_views(
    "SELECT intensity, incidents, score, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'ELEVATED' ELSE 'LOW' END AS status FROM (SELECT *, least(100, CAST(floor(intensity / greatest(incidents * 12.0 * 0.3, 1.0) * 100 + 0.5) AS BIGINT)) AS score FROM "
    f"(SELECT CAST(sum({map_sql('lower(type)', lex.INTENSITY_WEIGHTS, '1')} * {map_sql('(' + SEVERITY_SQL + ')', lex.SEVERITY_MULTIPLIERS, '1.0')}) AS DOUBLE) AS intensity, count(*) AS incidents FROM incidents))"))
def _(spark, d):
    return stats.intensity_index(incidents(spark, d))


@query("top_types", "A29", with_views("SELECT upper(replace(type, '_', ' ')) AS type_label, count(*) AS n FROM incidents GROUP BY 1 ORDER BY n DESC, type_label LIMIT 4"))
def _(spark, d):
    return stats.top_types(incidents(spark, d))


@query("timeline", "A30,W8", with_views(
    f"SELECT strftime(published, '%Y-%m-%d') AS day, count(*) AS n FROM incidents WHERE published >= {_T} - INTERVAL '720' HOUR GROUP BY 1 ORDER BY day DESC LIMIT 14"))
def _(spark, d):
    return stats.timeline(incidents(spark, d), AS_OF)


@query("country_heat", "A31,J12", with_views(
    f"SELECT s.country_code, coalesce(n, 0) AS n, CAST(row_number() OVER (ORDER BY coalesce(n, 0) DESC, s.country_code) AS INT) AS rank FROM {values_sql([(s,) for s in dims.HEAT_COUNTRIES], 's', ['country_code'])} LEFT JOIN (SELECT {CODE_SQL} AS country_code, count(*) AS n FROM incidents GROUP BY 1) USING (country_code)"))
def _(spark, d):
    return stats.country_heat(incidents(spark, d))


@query("casualty_totals", "A32", with_views(
    "SELECT " + ", ".join(f"CAST(sum(casualties_{k}) AS BIGINT) AS {k}" for k in ("total", "military", "civilian", "injured")) + " FROM incidents"))
def _(spark, d):
    return stats.casualty_totals(incidents(spark, d))


@query("validation_counts", "A6", with_views(
    f"SELECT count(*) FILTER ({_BAD} = 'VERIFIED') AS validated, count(*) FILTER ({_BAD} NOT IN ('VERIFIED', 'DISPUTED')) AS pending, count(*) FILTER ({_BAD} = 'DISPUTED') AS disputed FROM incidents"))
def _(spark, d):
    return stats.validation_counts(incidents(spark, d))


@query("badge_summary", "A6", with_views(
    "SELECT b.badge, count(i.id) AS n FROM (VALUES ('VERIFIED'), ('LIKELY'), ('PARTIAL'), ('UNCONFIRMED')) b(badge) LEFT JOIN incidents i USING (badge) GROUP BY 1"))
def _(spark, d):
    return stats.badge_summary(incidents(spark, d))


@query("notam_counts", "A33", with_views("SELECT severity, count(*) AS n FROM notams GROUP BY 1"))
def _(spark, d):
    return stats.notam_counts(view(spark, d, NOTAMS))


@query("airspace_status", "A36", with_views(
    "SELECT n AS alerts, CASE WHEN n > 0 THEN 'warning' ELSE 'normal' END AS status, CASE WHEN n > 0 THEN n || ' Active Alerts' ELSE 'Clear' END AS label FROM (SELECT count(*) AS n FROM incidents WHERE type IN ('air_defense', 'alert'))"))
def _(spark, d):
    return stats.airspace_status(incidents(spark, d))


@query("threat_post_summary", "A35", with_views(f"SELECT count(*) AS threats_found, {len(dims.ACCOUNTS)} AS accounts_monitored FROM ({THREAT_SQL})"))
def _(spark, d):
    return stats.threat_post_summary(enrich.threat_indicators(_posts(spark, d)))


@query("threat_alerts", "A35", with_views(
    f"SELECT post_id, account_name, indicators, threat_severity FROM ({THREAT_SQL}) ORDER BY post_id LIMIT 5"))
def _(spark, d):
    return stats.first_threats(enrich.threat_indicators(_posts(spark, d))).select(
        "post_id", "account_name", F.array_join("threat_indicators", "|").alias("indicators"), "threat_severity")


@query("newest_first", "sorts", with_views("SELECT id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM incidents ORDER BY incidents.published DESC, id LIMIT 25"))
def _(spark, d):
    return stats.top_k(incidents(spark, d), [F.desc("published"), F.asc("id")], 25).select(
        "id", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


# --- sequences and scenarios ------------------------------------------------

_CTRY = "coalesce(country, 'Unknown')"


@query("actor_action_patterns", "A23", with_views(f"SELECT actor, action, {_CTRY} AS country, count(*) AS n FROM ({ACTOR_SQL}) WHERE actor IS NOT NULL GROUP BY 1, 2, 3"))
def _(spark, d):
    return patterns.actor_action_patterns(incidents(spark, d))


@query("country_patterns", "A23,Q19", with_views(
    f"SELECT country, 'total' AS facet, 'all' AS label, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT country, 'type', type, count(*) FROM x GROUP BY 1, 3 UNION ALL SELECT country, 'severity', severity, count(*) FROM x GROUP BY 1, 3",
    x=f"SELECT {_CTRY} AS country, type, coalesce(severity, 'low') AS severity FROM incidents"))
def _(spark, d):
    return patterns.country_patterns(incidents(spark, d))


def _followups_sql(source: str, frames) -> str:
    """Self-join form of the follow-up counts."""
    ev = f"(SELECT id, type, published, {_CTRY} AS country FROM {source})"
    body = " UNION ALL ".join(
        f"SELECT a.country, a.type AS trigger_type, b.type AS next_type, '{f}' AS frame, count(*) AS followups FROM {ev} a JOIN {ev} b ON a.country = b.country AND "
        f"(b.published > a.published OR (b.published = a.published AND b.id > a.id)) AND b.published - a.published <= INTERVAL '{s // 3600}' HOUR GROUP BY 1, 2, 3" for f, s in frames)
    return (f"SELECT f.*, t.triggers, CAST(floor(followups * 100.0 / triggers + 0.5) AS BIGINT) AS followups_per_trigger_pct FROM ({body}) f JOIN "
            f"(SELECT country, type AS trigger_type, count(*) AS triggers FROM {ev} GROUP BY 1, 2) t USING (country, trigger_type)")


@query("followup_outcomes", "A24,J7,Q20", with_views(_followups_sql("incidents", dims.FRAME_SECONDS.items())))
def _(spark, d):
    return patterns.followup_outcomes(incidents(spark, d))


@query("followup_pairs", "J7", with_views(
    f"SELECT a.id AS a_id, b.id AS b_id FROM (SELECT *, {_CTRY} AS c FROM incidents) a JOIN (SELECT *, {_CTRY} AS c FROM incidents) b ON a.c = b.c AND "
    "(b.published > a.published OR (b.published = a.published AND b.id > a.id)) AND b.published - a.published <= INTERVAL '24' HOUR"))
def _(spark, d):
    return patterns.followups(incidents(spark, d), "24h").select("a_id", "b_id")


_LAST14 = f"SELECT * FROM incidents WHERE published >= {_T} - INTERVAL '336' HOUR"
_ESC = ("SELECT CAST(sum(n) AS BIGINT) AS incidents, CAST(count(*) AS INT) AS days, CASE WHEN count(*) >= 6 AND sum(n) FILTER (a <= 3) > 0 THEN "
        "round((sum(n) FILTER (z <= 3) - sum(n) FILTER (a <= 3)) * 100.0 / sum(n) FILTER (a <= 3), 1) ELSE 0.0 END AS escalation_pct FROM "
        "(SELECT *, row_number() OVER (ORDER BY day) AS a, row_number() OVER (ORDER BY day DESC) AS z FROM (SELECT strftime(published, '%Y-%m-%d') AS day, count(*) AS n FROM {src} GROUP BY 1))")


@query("escalation", "W3", with_views(_ESC.format(src="recent"), recent=_LAST14))
def _(spark, d):
    return patterns.escalation(filters.filter_days(incidents(spark, d), AS_OF))


@query("activity_trends", "A22", with_views(
    f"SELECT e.*, (SELECT actor FROM ({ACTOR_SQL.replace('FROM incidents', 'FROM recent')}) WHERE actor IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, actor LIMIT 1) AS most_active_actor, "
    f"(SELECT {_CTRY} AS c FROM recent GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 1) AS most_targeted_country, (SELECT type FROM recent GROUP BY 1 ORDER BY count(*) DESC, type LIMIT 1) AS dominant_type, "
    f"round(e.incidents / CAST(14 AS DOUBLE), 1) AS daily_avg FROM ({_ESC.format(src='recent')}) e", recent=_LAST14))
def _(spark, d):
    return patterns.activity_trends(filters.filter_days(incidents(spark, d), AS_OF))


_RULE_ROWS = [(*r, 100 + i) for i, r in enumerate(dims.ACTION_RULES)]
_FALL_ROWS = [(*r, 100 + i) for i, r in enumerate(dims.FALLBACK_RULES)]
_rule_cols = ["category", "outcome", "probability", "timeframe", "confidence", "pos"]


@query("scenario_predictions", "R1,R2,J14,D8", with_views(
    "SELECT scenario_id, category, outcome, CAST(probability AS DOUBLE) AS probability, timeframe, confidence, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY probability DESC, pos) AS rank FROM "
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, category, outcome ORDER BY probability DESC, pos) AS d FROM (SELECT scenario_id, category, outcome, CAST(probability AS DOUBLE) AS probability, timeframe, confidence, pos FROM alln)) WHERE d = 1)) WHERE rank <= 6",
    recent=_LAST14,
    esc=_ESC.format(src="recent"),
    pat=f"SELECT actor, action, country, count(*) AS n FROM (SELECT actor, action, {_CTRY} AS country FROM ({ACTOR_SQL.replace('FROM incidents', 'FROM recent')}) WHERE actor IS NOT NULL) GROUP BY 1, 2, 3",
    scen="SELECT actor || '|' || action || '|' || country AS scenario_id, actor, action, country FROM pat",
    fol=_followups_sql("recent", dims.FRAME_SECONDS.items()),
    alln="SELECT scenario_id, 'Escalation Alert' AS category, 'Activity up ' || CAST(escalation_pct AS DOUBLE) || '% in last 3 days' AS outcome, least(50 + escalation_pct, 90) AS probability, 'Next 48-72 hours' AS timeframe, 'Based on ' || incidents || ' recent incidents' AS confidence, 0 AS pos FROM scen, esc WHERE escalation_pct > 10 "
    "UNION ALL SELECT scenario_id, 'Regional Response', 'Escalation likely in ' || cs, least(60 + top_n * 5, 95), '24-72 hours', 'Based on historical patterns', 1 FROM scen JOIN (SELECT actor, action, max(n) AS top_n, string_agg(upper(country), ', ' ORDER BY rn) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY actor, action ORDER BY n DESC, country) AS rn FROM pat) WHERE rn <= 3 GROUP BY 1, 2) USING (actor, action) "
    f"UNION ALL SELECT scenario_id, 'Follow-up Event', {map_sql('next_type', dims.TYPE_NAMES, 'next_type')} || ' activity', followups_per_trigger_pct, {map_sql('frame', dims.FRAME_NAMES, 'NULL')}, followups || ' of ' || triggers || ' similar events', 10 + 2 * {map_sql('frame', {f: i for i, f in enumerate(dims.FRAME_SECONDS)}, '0')} + rn FROM scen s JOIN "
    "(SELECT *, row_number() OVER (PARTITION BY country, trigger_type, frame ORDER BY followups DESC, next_type) AS rn FROM fol) f ON f.country = s.country AND f.trigger_type = s.action WHERE rn <= 2 "
    f"UNION ALL SELECT scenario_id, r.category, r.outcome, r.probability, r.timeframe, r.confidence, r.pos FROM scen JOIN {values_sql(_RULE_ROWS, 'r', ['action', *_rule_cols])} USING (action) "
    f"UNION ALL SELECT scenario_id, r.category, r.outcome, r.probability, r.timeframe, r.confidence, r.pos FROM scen, {values_sql(_FALL_ROWS, 'r', _rule_cols)} WHERE action NOT IN ({', '.join(sorted({q(r[0]) for r in dims.ACTION_RULES}))})"))
def _(spark, d):
    recent = filters.filter_days(incidents(spark, d), AS_OF)
    return patterns.predict(patterns.scenarios_seen(recent), recent)


@query("scenario_dimensions", "R3", with_views(
    f"SELECT s.actor, a.name AS actor_name, s.action, b.name AS action_name, n FROM (SELECT actor, action, count(*) AS n FROM ({ACTOR_SQL}) WHERE actor IS NOT NULL GROUP BY 1, 2) s "
    f"JOIN {values_sql(dims.SCENARIO_ACTORS, 'a', ['actor', 'name', 'region'])} USING (actor) JOIN {values_sql(dims.SCENARIO_ACTIONS, 'b', ['action', 'name'])} USING (action)"))
def _(spark, d):
    actors = dims.seed_table(spark, dims.SCENARIO_ACTORS, ["actor", "actor_name", "actor_region"])
    actions = dims.seed_table(spark, dims.SCENARIO_ACTIONS, ["action", "action_name"])
    seen = patterns.actor_action_patterns(incidents(spark, d)).groupBy("actor", "action").agg(F.sum("n").alias("n"))
    return seen.join(actors, "actor").join(actions, "action").select("actor", "actor_name", "action", "action_name", "n")


@query("scenario_countries", "R3", with_views(
    "SELECT s.key AS country, s.name, t.target, t.target_name, coalesce(n, 0) AS incidents FROM "
    f"{values_sql(dims.SCENARIO_COUNTRIES, 's', ['key', 'name'])} CROSS JOIN {values_sql(dims.SCENARIO_TARGETS, 't', ['target', 'target_name'])} "
    "LEFT JOIN (SELECT lower(replace(country, ' Arabia', '')) AS key, count(*) AS n FROM incidents GROUP BY 1) c ON c.key = s.key"))
def _(spark, d):
    listed = dims.seed_table(spark, dims.SCENARIO_COUNTRIES, ["country", "name"])
    targets = dims.seed_table(spark, dims.SCENARIO_TARGETS, ["target", "target_name"])
    return patterns.scenario_places(incidents(spark, d), listed, targets)


# --- response timelines -----------------------------------------------------

def _pattern_case(text: str, rules) -> str:
    out, default = "CASE", "CAST(1 AS DOUBLE)"
    for pattern, value in rules:
        lit = q(value) if isinstance(value, str) else f"CAST({value} AS DOUBLE)"
        if pattern is None:
            default = lit
        else:
            out += f" WHEN regexp_matches({text}, {q(pattern)}) THEN {lit}"
    return out + f" ELSE {default} END"


_bases = {p: map_sql("lvl", {k: v[p] for k, v in lex.PHASE_BASES.items()}, "NULL") for p in lex.PHASES}
PHASE_SQL = (
    "SELECT *, observe + orient + decide + act AS total_minutes FROM (SELECT *, " + ", ".join(f"CAST(floor(CAST({_bases[p]} AS DOUBLE) * am * tm + 0.5) AS BIGINT) AS {p}" for p in lex.PHASES)
    + f" FROM (SELECT *, CASE WHEN severity IN ('critical', 'high') THEN 'high' WHEN severity = 'low' THEN 'low' ELSE 'medium' END AS lvl, {_pattern_case('lower(title)', lex.ACTOR_MODIFIERS)} AS am, "
    f"{_pattern_case('lower(type || chr(32) || title)', lex.THREAT_MODIFIERS)} AS tm FROM incidents))")


@query("response_phases", "P32,Q26", with_views(f"SELECT id, observe, orient, decide, act, total_minutes FROM ({PHASE_SQL})"))
def _(spark, d):
    return response.response_phases(incidents(spark, d)).select("id", *lex.PHASES, "total_minutes")


def _bottle(spark, d):
    return response.bottlenecks(response.response_phases(incidents(spark, d)))


_necks = []
for _pos, (_phase, _nm, _cuts, _issue, _advice) in enumerate(response.BOTTLENECK_RULES):
    _sev = "CASE " + " ".join(f"WHEN {_phase} > {c} THEN '{s}'" for c, s in _cuts) + " END"
    _necks.append(f"SELECT id, source, '{_phase}' AS phase, {_sev} AS severity, {_phase} AS minutes, CASE {_sev} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END * 10 + {_pos} AS rk FROM p WHERE {_phase} > {_cuts[-1][0]}")
NECK_SQL = " UNION ALL ".join(_necks)


@query("response_bottlenecks", "P33", with_views(
    f"SELECT id, string_agg(phase || ':' || severity || ':' || minutes, ',' ORDER BY rk) AS chain FROM ({NECK_SQL}) GROUP BY 1", p=PHASE_SQL))
def _(spark, d):
    rows = _bottle(spark, d).filter(F.size("bottlenecks") > 0)
    return rows.select("id", F.array_join(F.transform("bottlenecks", lambda b: F.concat_ws(
        ":", b["phase"], b["severity"], b["minutes"].cast("string"))), ",").alias("chain"))


SUMMARY_SQL = (
    "SELECT p.*, CASE WHEN total_minutes > 0 AND floor(decide * 100.0 / total_minutes + 0.5) > 40 THEN 'DECIDE_PHASE' ELSE 'SEQUENTIAL' END AS critical_path, "
    "CASE WHEN total_minutes > 0 THEN least(100, CAST(floor(CAST(27 AS DOUBLE) / total_minutes * 100 + 0.5) AS BIGINT)) ELSE 100 END AS efficiency, coalesce(k.n, 0) AS bottleneck_count, k.phase AS worst_phase, k.severity AS worst_severity "
    f"FROM p LEFT JOIN (SELECT id, CAST(count(*) AS INT) AS n, min_by(phase, rk) AS phase, min_by(severity, rk) AS severity FROM ({NECK_SQL}) GROUP BY 1) k USING (id)")


@query("response_summary", "P34", with_views(f"SELECT id, critical_path, efficiency, bottleneck_count, worst_phase, worst_severity FROM ({SUMMARY_SQL})", p=PHASE_SQL))
def _(spark, d):
    return response.response_summary(_bottle(spark, d)).select(
        "id", "critical_path", "efficiency", "bottleneck_count", "worst_phase", "worst_severity")


def _people_sql(phase: str) -> str:
    cells = [q(f"{w} ({r})") if p is None else f"CASE WHEN regexp_matches(lower(title), {q(p)}) THEN {q(f'{w} ({r})')} END"
             for w, r, p in response.PARTICIPANTS[phase]]
    return f"array_to_string(list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL), '; ')"


_stage_text = {
    "observe": _pattern_case("lower(title) || lower(type)", response.DETECTION_TEXTS),
    "orient": _pattern_case("lower(title)", response.CLASSIFICATION_TEXTS),
    "decide": map_sql("severity", response.DECISION_TEXTS, q(response.DECISION_DEFAULT)),
    "act": _pattern_case("lower(title) || lower(type)", response.ACTION_TEXTS),
}


@query("response_stages", "P35", with_views(" UNION ALL ".join(
    f"SELECT id, {n} AS stage_no, '{s}' AS stage, {p} AS minutes, {_stage_text[p]} AS description, {_people_sql(p)} AS participants, "
    + ("CASE WHEN verification_status = 'VERIFIED' THEN 95 ELSE 72 END" if p == "observe" else "NULL") + " AS detect_confidence, "
    + ("CASE WHEN severity = 'critical' THEN 'Immediate' ELSE 'Standard' END" if p == "decide" else "NULL") + " AS approval_level FROM p"
    for n, (s, p) in enumerate(response.STAGES, 1)), p=PHASE_SQL))
def _(spark, d):
    return response.response_stages(response.response_phases(incidents(spark, d))).select(
        "id", "stage_no", "stage", "minutes", "description", F.array_join("participants", "; ").alias("participants"),
        "detect_confidence", "approval_level")


def _pairs(df):
    return df.select(F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"))


@query("response_comparison", "P36", with_views(
    "SELECT a.id AS a_id, b.id AS b_id, " + ", ".join(f"a.{c} - b.{c} AS delta_{c}" for c in [*lex.PHASES, "total_minutes", "efficiency"]) + " FROM s a JOIN s b ON b.id = a.id + 1",
    p=PHASE_SQL, s=SUMMARY_SQL))
def _(spark, d):
    summaries = response.response_summary(_bottle(spark, d))
    return response.compare_responses(summaries, _pairs(incidents(spark, d)))


@query("pair_bottlenecks", "set operations", with_views(
    "SELECT a.id AS a_id, b.id AS b_id, side, phase, k.severity, minutes FROM incidents a JOIN incidents b ON b.id = a.id + 1 JOIN (SELECT 'a' AS side, * FROM k UNION ALL SELECT 'b', * FROM k) k ON k.id = CASE side WHEN 'a' THEN a.id ELSE b.id END",
    p=PHASE_SQL, k=NECK_SQL))
def _(spark, d):
    return response.pair_bottlenecks(_bottle(spark, d), incidents(spark, d).alias("a").join(
        incidents(spark, d).select(F.col("id").alias("b_id")), F.col("b_id") == F.col("a.id") + 1).select(
        F.col("a.id").alias("a_id"), "b_id"))


@query("response_profile", "A37", with_views(
    "SELECT source, count(*) AS incidents, round(avg(total_minutes), 4) AS mean_minutes, round(avg(efficiency), 4) AS mean_efficiency FROM s GROUP BY 1", p=PHASE_SQL, s=SUMMARY_SQL))
def _(spark, d):
    return response.response_profile(response.response_summary(_bottle(spark, d)), "source").drop("p50_minutes", "p90_minutes")


@query("response_percentiles", "A37")
def _(spark, d):
    return response.response_profile(response.response_summary(_bottle(spark, d)), "type")


@query("bottleneck_frequency", "A37", with_views(f"SELECT phase, severity, count(*) AS n, round(avg(minutes), 4) AS mean_minutes FROM ({NECK_SQL}) GROUP BY 1, 2", p=PHASE_SQL))
def _(spark, d):
    return response.bottleneck_frequency(_bottle(spark, d))


# --- moderation -------------------------------------------------------------

_FP = "substring(sha256(incident_id || ':' || user_agent || ':' || CASE WHEN ip = '' THEN 'no-ip' ELSE substring(sha256(ip), 1, 16) END), 1, 16)"
_REASONS = ", ".join(q(r) for r in lex.REPORT_REASONS)
VERDICT_SQL = (
    "SELECT r.*, CASE WHEN NOT valid THEN 'invalid_reason' WHEN h.moment IS NOT NULL AND r.moment > h.moment THEN 'under_review' WHEN r.moment = f.moment THEN CASE WHEN f.rk = 5 THEN 'accepted_hidden' ELSE 'accepted' END ELSE 'already_reported' END AS verdict FROM "
    f"(SELECT *, {_FP} AS fp, reason IN ({_REASONS}) AS valid, (ts, seq) AS moment FROM reports) r LEFT JOIN fr f ON f.incident_id = r.incident_id AND f.fp = r.fp LEFT JOIN (SELECT incident_id, moment FROM fr WHERE rk = 5) h ON h.incident_id = r.incident_id")
_FIRST_REPORTS = (f"SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY moment) AS rk FROM (SELECT incident_id, {_FP} AS fp, min((ts, seq)) AS moment FROM reports WHERE reason IN ({_REASONS}) GROUP BY 1, 2)")


def _judged(spark, d):
    return moderation.judge_reports(view(spark, d, REPORTS))


@query("report_verdicts", "T7", with_views(f"SELECT seq, incident_id, verdict FROM ({VERDICT_SQL})", fr=_FIRST_REPORTS))
def _(spark, d):
    return _judged(spark, d).select("seq", "incident_id", "verdict")


_ACC = f"SELECT * FROM ({VERDICT_SQL}) WHERE starts_with(verdict, 'accepted')"


@query("report_status", "K6,A34", with_views(
    "SELECT incident_id, count(*) AS reports, count(*) >= 5 AS is_hidden, greatest(0, 5 - count(*)) AS until_hidden FROM acc GROUP BY 1", fr=_FIRST_REPORTS, acc=_ACC))
def _(spark, d):
    return moderation.report_status(moderation.accepted_reports(_judged(spark, d)))


@query("report_reasons", "A34", with_views(
    "SELECT coalesce(incident_id, '*') AS incident_id, coalesce(reason, '*') AS reason, count(*) AS n FROM acc GROUP BY GROUPING SETS ((), (incident_id), (reason), (incident_id, reason))", fr=_FIRST_REPORTS, acc=_ACC))
def _(spark, d):
    return moderation.report_reasons(moderation.accepted_reports(_judged(spark, d)))


@query("visible_incidents", "F10,J11,Q22", with_views(
    "SELECT id FROM incidents WHERE CAST(id AS STRING) NOT IN (SELECT incident_id FROM acc GROUP BY 1 HAVING count(*) >= 5)", fr=_FIRST_REPORTS, acc=_ACC))
def _(spark, d):
    hidden = moderation.hidden_ids(moderation.accepted_reports(_judged(spark, d)))
    rows = incidents(spark, d).withColumn("incident_id", F.col("id").cast("string"))
    return moderation.drop_hidden(rows, hidden).select("id")


@query("newest_reports", "sorts", with_views(
    f"SELECT seq, {map_sql('reason', lex.REPORT_REASONS, 'reason')} AS reason_label FROM (SELECT * FROM reports ORDER BY ts DESC, seq DESC LIMIT 10)"))
def _(spark, d):
    return moderation.newest_reports(view(spark, d, REPORTS)).select("seq", "reason_label")


# --- prices, sessions -------------------------------------------------------

CLOSE_SQL = ("SELECT symbol, day, price, lag(price) OVER (PARTITION BY symbol ORDER BY day) AS prev_close FROM (SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, max_by(price, (ts, seq)) AS price FROM prices GROUP BY 1, 2)")


@query("previous_close", "W6", with_views(f"SELECT symbol, day, round(price, 4) AS price, round(prev_close, 4) AS prev_close FROM ({CLOSE_SQL})"))
def _(spark, d):
    return markets.previous_close(view(spark, d, PRICES)).select(
        "symbol", "day", F.round("price", 4).alias("price"), F.round("prev_close", 4).alias("prev_close"))


_fmt = "CASE symbol " + " ".join(f"WHEN '{k}' THEN '$' || format('{{:{',' if th else ''}.{dec}f}}', round(price, {dec}))" for k, _, dec, th in dims.PRICE_SYMBOLS) + " END"


@query("price_change", "P37,W6", with_views(
    "SELECT symbol, day, round((price - prev_close) / prev_close * 100, 2) AS change, " + _fmt + " AS formatted_price, "
    "CASE WHEN round((price - prev_close) / prev_close * 100, 2) >= 0 THEN '+' ELSE '' END || format('{:.2f}', round((price - prev_close) / prev_close * 100, 2)) || '%' AS formatted_change "
    f"FROM (SELECT symbol, day, round(price, 2) AS price, round(prev_close, 2) AS prev_close FROM ({CLOSE_SQL})) WHERE price <> 0 AND prev_close <> 0"))
def _(spark, d):
    closes = markets.previous_close(view(spark, d, PRICES)).withColumns(
        {c: F.round(c, 2) for c in ("price", "prev_close")})
    return markets.price_change(closes).select("symbol", "day", "change", "formatted_price", "formatted_change")


SESSION_SQL = ("SELECT user_id, min(published) AS started, count(*) AS visits FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY published, id) AS sid FROM (SELECT *, CASE WHEN published - lag(published) OVER (PARTITION BY user_id ORDER BY published, id) < INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM incidents)) GROUP BY user_id, sid")


@query("visitor_sessions", "W10,T6", with_views(
    f"SELECT user_id AS visitor, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, visits FROM ({SESSION_SQL})"))
def _(spark, d):
    return markets.sessions(incidents(spark, d), "user_id", "published").withColumn(
        "started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


@query("visit_counts", "W10", with_views(f"SELECT user_id AS visitor, count(*) AS sessions, CAST(sum(visits) AS BIGINT) AS visits FROM ({SESSION_SQL}) GROUP BY 1"))
def _(spark, d):
    return markets.visit_counts(markets.sessions(incidents(spark, d), "user_id", "published"))


# --- orbits -----------------------------------------------------------------

STEP_S = 600


def _observations(spark, d):
    """One observer per user at the user's place, looking at every ten-minute
    mark the events fall into."""
    rows = table(spark, d, "events").selectExpr(
        "user_id AS obs_id", f"{INCIDENTS['lng']} AS obs_lon", "CAST(120 + user_id * 7 % 230 AS DOUBLE) / CAST(10 AS DOUBLE) AS obs_lat",
        f"CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / {STEP_S * 1_000_000}) AS BIGINT) * {STEP_S} AS at_s")
    return rows.distinct()


def _elements(spark):
    cols = ["name", "norad_id", "kind", "line1", "line2"]
    return orbit.parse_elements(dims.seed_table(spark, dims.ELEMENTS, cols))


_OBS_SQL = (f"SELECT DISTINCT user_id AS obs_id, {INCIDENTS['lng']} AS obs_lon, CAST(120 + user_id * 7 % 230 AS DOUBLE) / CAST(10 AS DOUBLE) AS obs_lat, "
            f"CAST(floor(epoch_us(ts) / {STEP_S * 1_000_000}) AS BIGINT) * {STEP_S} AS at_s FROM events")


def _f(line: str, a: int, b: int) -> str:
    return f"CAST(trim(substring({line}, {a + 1}, {b - a})) AS DOUBLE)"


_ELEM_SQL = (
    f"SELECT norad_id, kind, epoch(make_timestamp(2000 + CAST(substring(line1, 19, 2) AS INT), 1, 1, 0, 0, 0.0)) + floor(({_f('line1', 20, 32)} - 1) * 86400) AS epoch_s, {_f('line2', 8, 16)} AS inc, {_f('line2', 17, 25)} AS raan, "
    f"CAST('0.' || substring(line2, 27, 7) AS DOUBLE) AS ecc, {_f('line2', 34, 42)} AS argp, {_f('line2', 43, 51)} AS ma, {_f('line2', 52, 63)} AS mm FROM {values_sql(dims.ELEMENTS, 'e', ['name', 'norad_id', 'kind', 'line1', 'line2'])}")
_TRACK_SQL = (
    "SELECT at_s, norad_id, kind, degrees(atan2(ez, sqrt(ex * ex + ey * ey))) AS sat_lat, CASE WHEN lon < -180 THEN lon + 360 ELSE lon END AS sat_lon, sqrt(ex * ex + ey * ey + ez * ez) - 6378.135 AS alt FROM (SELECT *, degrees(atan2(ey, ex)) - gmst AS lon FROM "
    "(SELECT *, (cos(o) * cos(w) - sin(o) * sin(w) * cos(i)) * x + (-cos(o) * sin(w) - sin(o) * cos(w) * cos(i)) * y AS ex, (sin(o) * cos(w) + cos(o) * sin(w) * cos(i)) * x + (-sin(o) * sin(w) + cos(o) * cos(w) * cos(i)) * y AS ey, "
    "sin(i) * sin(w) * x + sin(i) * cos(w) * y AS ez FROM (SELECT *, r * cos(m) AS x, r * sin(m) AS y, ((g % 360) + 360) % 360 AS gmst FROM (SELECT *, a * (1 - ecc * ecc) / (1 + ecc * cos(m)) AS r FROM "
    "(SELECT s.at_s, e.*, radians(raan) AS o, radians(inc) AS i, radians(argp) AS w, radians((ma + 360 * ((at_s - epoch_s) / 60.0::DOUBLE) / (1440 / mm)) % 360) AS m, pow(398600.8::DOUBLE * pow(86400 / (2 * pi() * mm), 2), 1.0::DOUBLE / 3) AS a, "
    "280.46061837::DOUBLE + 360.98564736629::DOUBLE * (at_s / 86400.0::DOUBLE + (2440587.5::DOUBLE - 2451545.0)) + 0.000387933::DOUBLE * pow((at_s / 86400.0::DOUBLE + (2440587.5::DOUBLE - 2451545.0)) / 36525, 2) - pow((at_s / 86400.0::DOUBLE + (2440587.5::DOUBLE - 2451545.0)) / 36525, 3) / 38710000 AS g "
    "FROM (SELECT DISTINCT at_s FROM obs) s, elem e)))))")
_VIS_SQL = (
    "SELECT *, degrees(asin(alt / sqrt(gd * gd + alt * alt))) AS elevation FROM (SELECT *, 2 * 6378.135 * atan2(sqrt(h), sqrt(1 - h)) AS gd FROM (SELECT *, pow(sin(radians(sat_lon - obs_lon) / 2), 2) + cos(radians(obs_lat)) * cos(radians(sat_lat)) * pow(sin(radians(sat_lat - obs_lat) / 2), 2) AS h FROM obs JOIN track USING (at_s)))")


@query("satellite_positions", "J8", with_views(
    "SELECT at_s, norad_id, round(sat_lat, 3) AS sat_lat, round(sat_lon, 3) AS sat_lon, round(alt, 2) AS altitude_km FROM track", obs=_OBS_SQL, elem=_ELEM_SQL, track=_TRACK_SQL))
def _(spark, d):
    seconds = _observations(spark, d).select("at_s").distinct()
    return orbit.positions(seconds.join(F.broadcast(_elements(spark)))).select(
        "at_s", "norad_id", F.round("sat_lat", 3).alias("sat_lat"), F.round("sat_lon", 3).alias("sat_lon"),
        F.round("altitude_km", 2).alias("altitude_km"))


@query("visible_satellites", "J8,F16", with_views(
    "SELECT obs_id, at_s, norad_id, round(elevation, 2) AS elevation FROM (" + _VIS_SQL + ") WHERE elevation >= 10", obs=_OBS_SQL, elem=_ELEM_SQL, track=_TRACK_SQL))
def _(spark, d):
    rows = filters.visible(orbit.visibility(_elements(spark), _observations(spark, d)))
    return rows.select("obs_id", "at_s", "norad_id", F.round("elevation", 2).alias("elevation"))


_PASS_SQL = (f"SELECT obs_id, norad_id, kind, min(at_s) AS rise_s, max(at_s) AS set_s, count(*) AS samples, max(elevation) AS top FROM (SELECT *, sum(fresh) OVER (PARTITION BY obs_id, norad_id ORDER BY at_s) AS pass FROM "
             f"(SELECT *, CASE WHEN at_s - lag(at_s) OVER (PARTITION BY obs_id, norad_id ORDER BY at_s) <= {STEP_S} THEN 0 ELSE 1 END AS fresh FROM ({_VIS_SQL}) WHERE elevation >= 10)) GROUP BY obs_id, norad_id, kind, pass")


@query("satellite_passes", "W9", with_views(f"SELECT obs_id, norad_id, rise_s, set_s, samples FROM ({_PASS_SQL})", obs=_OBS_SQL, elem=_ELEM_SQL, track=_TRACK_SQL))
def _(spark, d):
    rows = filters.visible(orbit.visibility(_elements(spark), _observations(spark, d)))
    return orbit.passes(rows, STEP_S).select("obs_id", "norad_id", "rise_s", "set_s", "samples")


@query("pass_coverage", "A38", with_views(
    f"SELECT kind, count(*) AS passes, count(DISTINCT norad_id) AS satellites, CAST(sum(samples) AS BIGINT) AS samples FROM ({_PASS_SQL}) GROUP BY 1", obs=_OBS_SQL, elem=_ELEM_SQL, track=_TRACK_SQL))
def _(spark, d):
    rows = filters.visible(orbit.visibility(_elements(spark), _observations(spark, d)))
    return orbit.pass_coverage(orbit.passes(rows, STEP_S)).drop("max_elevation")


@query("satellites_over_region", "F8,A38", with_views(
    "SELECT at_s, norad_id FROM track WHERE sat_lat BETWEEN 10 AND 40 AND sat_lon BETWEEN 30 AND 65", obs=_OBS_SQL, elem=_ELEM_SQL, track=_TRACK_SQL))
def _(spark, d):
    seconds = _observations(spark, d).select("at_s").distinct()
    return orbit.over_region(orbit.positions(seconds.join(F.broadcast(_elements(spark))))).select("at_s", "norad_id")
