"""Incident, thermal, weather, airspace and report views over the given tables.

The tables hold generic events; each view below is one list of SQL expressions
over ``events`` that Spark and DuckDB both accept, so a query and its check
start from identical rows. Nothing is filtered: every event becomes one row.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.match import once

AS_OF = "2024-01-31 00:00:00"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _pick(options: list[str], index: str) -> str:
    joined = "|".join(options).replace("'", "''")
    return f"split_part('{joined}', '|', CAST(({index}) % {len(options)} AS INT) + 1)"


_ACTORS = ["Houthi", "Israeli", "Iranian", "Saudi", "Emirati", "American", "British",
           "Hezbollah", "Hamas", "Local"]
_PLACES = ["Tehran", "Tel Aviv", "Riyadh", "Dubai", "Doha", "Manama", "Kuwait City",
           "Muscat", "Beirut", "Gaza", "Baghdad", "Sanaa", "Abu Dhabi", "Jerusalem",
           "Damascus", "Isfahan", "Red Sea", "Amman", "border post", "Haifa"]
_COUNTRIES = ["Iran", "Israel", "Saudi Arabia", "UAE", "Qatar", "Bahrain", "Kuwait",
              "Oman", "Lebanon", "Palestine", "Iraq", "Yemen", "UAE", "Israel",
              "Syria", "Iran", "", "Jordan", "", "Israel"]
_PHRASES = {
    "error": ["missile strike hits base in", "ballistic missile launch reported near",
              "rocket fire intercepted over", "missile lands outside"],
    "purchase": ["drone attack reported in", "UAV shot down over", "drone downed near",
                 "suicide drone strikes depot in"],
    "click": ["airstrike kills civilians in", "bombing reported in",
              "naval vessel attacked off", "troops clash near"],
    "view": ["siren alert sounds in", "air defense battery activated in",
             "warning issued by officials in", "cyberattack disrupts power in"],
    "signup": ["security deal agreement signed in", "weekly roundup: death toll rises in",
               "military drill update over the past 3 days in",
               "sanctions announced against firms in"],
}
_SOURCES = ["BBC Middle East", "Al Jazeera", "Gulf News", "Khaleej Times",
            "Times of Israel", "Saudi Civil Defense", "Israel Defense Forces",
            "UAE Ministry of Interior", "Arab News", "Haaretz", "Telegram"]

_phrase = "CASE event_type " + " ".join(
    f"WHEN '{t}' THEN {_pick(p, 'event_id')}" for t, p in _PHRASES.items()
) + " ELSE 'incident reported in' END"
_place = _pick(_PLACES, "user_id")
_number = "CAST(CAST(floor(value) AS INT) % 13 AS STRING)"
_title = (
    f"{_pick(_ACTORS, 'user_id')} || ' ' || {_phrase} || ' ' || {_place} || "
    f"CASE WHEN event_type IN ('error', 'click') AND CAST(floor(value) AS INT) % 4 = 0 "
    f"THEN ', ' || {_number} || ' killed' "
    f"WHEN event_type IN ('error', 'click') AND CAST(floor(value) AS INT) % 4 = 1 "
    f"THEN ', ' || {_number} || ' soldiers wounded' ELSE '' END"
)
_badge = ("CASE event_id % 7 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'LIKELY' WHEN 2 THEN 'PARTIAL' "
          "WHEN 3 THEN 'DISPUTED' WHEN 4 THEN NULL ELSE 'UNCONFIRMED' END")
# a third of all rows share one source
_source = f"CASE WHEN event_id % 3 = 0 THEN 'Reuters Middle East' ELSE {_pick(_SOURCES, 'event_id')} END"

INCIDENTS = {
    "id": "event_id",
    "seq": "event_id",
    "title": _title,
    "source": _source,
    "source_url": ("CASE event_id % 5 WHEN 0 THEN 'https://news.example.com/' || CAST(event_id AS STRING) "
                   "WHEN 1 THEN 'news.example.com/2024/jan/' || CAST(1 + event_id % 28 AS STRING) || '/x' "
                   "WHEN 2 THEN 'http://feed.example.com/2024/01/' || CAST(10 + event_id % 18 AS STRING) || '/y' "
                   "WHEN 3 THEN 'javascript:alert(' || CAST(event_id AS STRING) || ')' "
                   "ELSE '/local/' || CAST(event_id AS STRING) END"),
    "published": "ts",
    "type": ("CASE event_type WHEN 'error' THEN 'missile' WHEN 'purchase' THEN 'drone' "
             "WHEN 'click' THEN 'attack' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'alert' "
             "ELSE 'air_defense' END ELSE 'security' END"),
    "status": "CASE event_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'reported' ELSE 'unconfirmed' END",
    "city": _place,
    "country": f"nullif({_pick(_COUNTRIES, 'user_id')}, '')",
    "lat": "CAST(120 + event_id * 7 % 230 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "lng": "CAST(340 + user_id * 11 % 260 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "credibility": "CAST(55 + event_id % 45 AS INT)",
    "is_government": ("CASE WHEN event_id % 3 = 0 THEN false ELSE event_id % 11 IN (5, 6, 7) END"),
    "casualties_total": "CAST(floor(value) AS INT) % 13",
    "casualties_military": "CAST(floor(value) AS INT) % 13 % 4",
    "casualties_civilian": "CAST(floor(value) AS INT) % 13 - CAST(floor(value) AS INT) % 13 % 4",
    "casualties_injured": "CAST(floor(value) AS INT) % 5",
    "badge": _badge,
    "verification_status": _badge,
    "severity": ("CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' "
                 "WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' END"),
    "description": f"'Reported #' || replace({_place}, ' ', '') || ' #' || event_type",
    "user_id": "user_id",
    "value": "value",
}
THERMAL = {
    "id": "event_id",
    "latitude": INCIDENTS["lat"],
    "longitude": INCIDENTS["lng"],
    "brightness": "CAST(270 AS DOUBLE) + CAST(CAST(floor(value * 7) AS INT) % 130 AS DOUBLE)",
    "frp": "CASE WHEN event_id % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE value END",
    "acq_date": "substring(CAST(ts AS STRING), 1, 10)",
    "confidence": _pick(["low", "nominal", "high", "medium"], "event_id"),
    "ts": "ts",
}
WEATHER = {
    "id": "event_id",
    "region": _pick(["gulf_north", "gulf_central", "gulf_south", "red_sea", "levant", "iraq", "yemen"], "user_id"),
    "temperature": "CAST(20 + event_id % 30 AS DOUBLE)",
    "wind_speed": "CAST(CAST(floor(value) AS INT) % 40 AS DOUBLE)",
    "visibility": "CAST((event_id * 7 + user_id) % 20 AS DOUBLE)",
    "condition": _pick(["clear", "dust", "partly_cloudy", "sandstorm", "fog"], "event_id + user_id"),
    "ts": "ts",
}
NOTAMS = {
    "id": "event_id",
    "icao": _pick(["OMDB", "OMAA", "OERK", "OEJN", "OTHH", "OKBK", "OBBI", "OOMS", "ORBI",
                   "OIIE", "LLBG", "OLBA", "ZZZZ"], "user_id"),
    "category": _pick(["AIRSPACE", "HAZARD", "CONFLICT", "AIRPORT", "NAVIGATION", "OTHER"], "event_id"),
    "severity": _pick(["CRITICAL", "WARNING", "ELEVATED", "INFORMATION"], "event_id + user_id"),
    "content": f"upper({_title})",
    "valid_from": "ts",
    "valid_until": "ts + INTERVAL '8' HOUR",
}
REPORTS = {
    "seq": "event_id",
    "incident_id": "CAST(event_id * 31 % 997 AS STRING)",
    "ts": "ts",
    "reason": _pick(["false_info", "wrong_location", "outdated", "duplicate", "wrong_title", "spam"], "event_id"),
    "details": "event_type",
    "user_agent": "'agent-' || CAST(user_id % 40 AS STRING)",
    "ip": "CASE WHEN user_id % 6 = 0 THEN '' ELSE '10.0.0.' || CAST(user_id % 25 AS STRING) END",
}
PRICES = {
    "seq": "event_id",
    "symbol": _pick(["brent", "gas", "gold", "bitcoin", "iron", "copper"], "user_id"),
    "ts": "ts",
    "price": "value * CAST(10 AS DOUBLE)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        *[f"{expr} AS {name}" for name, expr in columns.items()]
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incident view with its title built once per row, as a stored column
    would be, instead of in every expression that mentions it."""
    rows = once(table(spark, sf_dir, "events"), title=F.expr(_title))
    return rows.selectExpr(*[name if name == "title" else f"{expr} AS {name}" for name, expr in INCIDENTS.items()])


def sql_view(columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM events"


def with_views(body: str, **extra: str) -> str:
    """Check SQL: the views the body names, then the body."""
    known = {"incidents": INCIDENTS, "thermal": THERMAL, "weather": WEATHER,
             "notams": NOTAMS, "reports": REPORTS, "prices": PRICES}
    parts = [f"{name} AS ({sql_view(cols)})" for name, cols in known.items() if name in body
             or any(name in e for e in extra.values())]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
