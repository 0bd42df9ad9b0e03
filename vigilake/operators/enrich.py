"""Column projections over articles and incidents.

Each function takes and returns columns or DataFrames and stays inside Catalyst
expressions: no shuffle, no Python per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import dims, lexicons as lex
from vigilake.functions.match import (any_of, count_hits, first_label, first_word, has_any,
                                      hit_words, lookup, once, steps, weighted_hits)


# --- classification ---------------------------------------------------------

def classify(df: DataFrame, lexicon: Mapping[str, Sequence[str]], col: str, default: str,
             out: str = "label", match: str = "substring") -> DataFrame:
    lowered = once(df, _text=F.lower(F.coalesce(F.col(col), F.lit(""))))
    return once(lowered, **{out: first_label(F.col("_text"), lexicon, default, match)}).drop("_text")


def classify_with_confidence(df: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """Statistics type and its fixed confidence, from title and content together."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    typed = once(once(df, _text=text), stats_type=first_label(F.col("_text"), lex.STATS_TYPES, "general"))
    return typed.withColumn(
        "stats_confidence", lookup(F.col("stats_type"), lex.STATS_TYPE_CONFIDENCE, 0.5)
    ).drop("_text")


# --- places -----------------------------------------------------------------

def place_keywords(text: Column, places: Sequence[str] = tuple(lex.SIGNATURE_PLACES)) -> Column:
    """Known places found in the (lower-case) text, sorted and comma-joined."""
    found = hit_words(text, sorted(places))
    return F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise(F.lit("unknown"))


def extract_location(df: DataFrame, col: str = "title", fallback_country: str = "feed_country") -> DataFrame:
    """First city named in the text, else first country, else the feed's country
    at the default point."""
    spark = df.sparkSession
    columns = ["_place", "loc_name", "loc_country", "loc_lat", "loc_lng"]
    places = dims.seed_table(
        spark,
        [("city:" + r[0], *r[1:]) for r in dims.INGEST_CITIES]
        + [("country:" + r[0], *r[1:]) for r in dims.INGEST_COUNTRIES],
        columns,
    )
    text = F.lower(F.coalesce(F.col(col), F.lit("")))
    keyed = once(df, _text=text).withColumn("_place", F.coalesce(
        F.concat(F.lit("city:"), first_word(F.col("_text"), [r[0] for r in dims.INGEST_CITIES])),
        F.concat(F.lit("country:"), first_word(F.col("_text"), [r[0] for r in dims.INGEST_COUNTRIES])),
    )).drop("_text")
    name, lat, lng = dims.INGEST_FALLBACK
    return (
        keyed.join(places, "_place", "left").drop("_place")
        .withColumn("loc_country", F.when(F.col("loc_name").isNull(), F.col(fallback_country))
                    .otherwise(F.col("loc_country")))
        .withColumn("loc_lat", F.coalesce("loc_lat", F.lit(lat)))
        .withColumn("loc_lng", F.coalesce("loc_lng", F.lit(lng)))
        .withColumn("loc_name", F.coalesce("loc_name", F.lit(name)))
    )


def dominant_country(df: DataFrame, text: Column, lat: Column | None = None, lng: Column | None = None,
                     out: str = "stats_country") -> DataFrame:
    """Country with the most keyword mentions, list order breaking ties; without
    any mention the coordinates decide by box."""
    lowered = once(df, _text=F.lower(text))
    scored = F.array(*[
        F.struct(count_hits(F.col("_text"), words).alias("score"), F.lit(-i).alias("rank"),
                 F.lit(code).alias("code"))
        for i, (code, words) in enumerate(lex.COUNTRY_MENTIONS.items())
    ])
    best = once(lowered, _best=F.array_max(scored))
    by_box = F.lit("unknown")
    if lat is not None and lng is not None:
        boxed = None
        for code, lat_lo, lat_hi, lng_lo, lng_hi in lex.COUNTRY_BOXES:
            inside = (lat > lat_lo) & (lat < lat_hi) & (lng > lng_lo) & (lng < lng_hi)
            boxed = F.when(inside, F.lit(code)) if boxed is None else boxed.when(inside, F.lit(code))
        by_box = boxed.otherwise(F.lit("unknown"))
    return once(best, **{
        out: F.when(F.col("_best.score") > 0, F.col("_best.code")).otherwise(by_box)
    }).drop("_text", "_best")


# --- casualties -------------------------------------------------------------

def _around(text: Column, number: Column, reach: int) -> Column:
    """``reach`` characters on both sides of the first place the number occurs."""
    pos = F.instr(text, number) - F.lit(1)
    start = F.greatest(F.lit(0), pos - F.lit(reach))
    return F.substr(text, start + F.lit(1), pos + F.lit(reach) - start)


def casualties(df: DataFrame, text: Column, mode: str = "max", prefix: str = "cas") -> DataFrame:
    """Casualty numbers in a text as ``<prefix>_total/_military/_civilian``.

    ``max``: the largest number is the total and the last match (pattern order,
    then text order) decides military or civilian. ``sum``: all matches add up,
    each into the class its own context names. Civilian is the default class.
    """
    total, mil, civ = (f"{prefix}_{n}" for n in ("total", "military", "civilian"))
    lowered = once(df, _text=F.lower(F.coalesce(text, F.lit(""))))
    patterns, reach, soldiers = {
        "max": (lex.CASUALTY_PATTERNS_MAX, 150, lex.MILITARY_CONTEXT_MAX),
        "sum": (lex.CASUALTY_PATTERNS_SUM, 100, lex.MILITARY_CONTEXT_SUM),
    }[mode]
    found = once(lowered, _found=F.filter(
        F.concat(*[F.regexp_extract_all("_text", F.lit(p), F.lit(1)) for p in patterns]),
        lambda m: m.try_cast("bigint").isNotNull(),
    ))
    if mode == "sum":
        rows = F.transform("_found", lambda m: F.struct(
            m.cast("bigint").alias("n"), has_any(_around(F.col("_text"), m, reach), soldiers).alias("mil")
        ))
        zero = F.lit(0).cast("bigint")
        sums = once(once(found, _rows=rows), **{
            total: F.aggregate("_rows", zero, lambda a, r: a + r["n"]),
            mil: F.aggregate("_rows", zero, lambda a, r: a + F.when(r["mil"], r["n"]).otherwise(0))})
        return (
            sums.withColumn(civ, F.col(total) - F.col(mil))
            .drop("_text", "_found", "_rows")
        )
    last = F.try_element_at("_found", F.lit(-1))
    number = F.coalesce(last.cast("bigint"), F.lit(0).cast("bigint"))
    is_mil = F.coalesce(has_any(_around(F.col("_text"), last, reach), soldiers), F.lit(False))
    counted = once(found, _number=number, _mil=is_mil, **{total: F.coalesce(
        F.array_max(F.transform("_found", lambda m: m.cast("bigint"))), F.lit(0).cast("bigint"))})
    return (
        counted.withColumn(mil, F.when(F.col("_mil"), F.col("_number")).otherwise(F.lit(0).cast("bigint")))
        .withColumn(civ, F.when((F.col("_number") == 0), F.col(total))
                    .when(F.col("_mil"), F.lit(0).cast("bigint")).otherwise(F.col("_number")))
        .drop("_text", "_found", "_number", "_mil")
    )


# --- dates ------------------------------------------------------------------

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def publish_ts(df: DataFrame, as_of: str, url: str = "source_url", published: str = "published",
               updated: str | None = None, out: str = "published_at") -> DataFrame:
    """Date in the URL path, else the published time, else updated, else ``as_of``.
    A path that spells an impossible date falls through to the next choice."""
    u = F.coalesce(F.col(url), F.lit(""))
    named = r"/(\d{4})/(" + "|".join(_MONTHS) + r")/(\d{1,2})/"
    numbered = r"/(\d{4})/(\d{2})/(\d{2})/"
    months = F.array(*[F.lit(m) for m in _MONTHS])

    def day(y: Column, m: Column, d: Column) -> Column:
        text = F.format_string("%s-%02d-%02d", y, m.cast("int"), d.try_cast("int"))
        return F.when(y != "", text.try_cast("date").cast("timestamp_ntz"))

    lowered = F.lower(u)
    month = F.array_position(months, F.regexp_extract(lowered, named, 2))
    by_name = day(F.regexp_extract(lowered, named, 1), month, F.regexp_extract(lowered, named, 3))
    by_number = day(F.regexp_extract(u, numbered, 1), F.regexp_extract(u, numbered, 2).try_cast("int"),
                    F.regexp_extract(u, numbered, 3))
    choices = [by_name, by_number, F.col(published)] + ([F.col(updated)] if updated else [])
    return df.withColumn(out, F.coalesce(*choices, F.lit(as_of).cast("timestamp_ntz")))


# --- recap, confidence, signature ------------------------------------------

def recap_score(df: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """Weighted recap score with its flag (score >= 2.5) and confidence; rows
    scoring above 3.0 are the ones screening drops."""
    text = F.lower(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(content), F.lit(""))))
    lowered = once(df, _text=text)
    places = F.greatest(count_hits(F.col("_text"), lex.SIGNATURE_PLACES), F.lit(1))
    score = weighted_hits(F.col("_text"), lex.RECAP_PHRASES) + F.when(
        places > lex.RECAP_MANY_PLACES, F.lit(lex.RECAP_MANY_PLACES_WEIGHT)).otherwise(F.lit(0.0))
    for pattern in lex.RECAP_PATTERNS:
        score = score + F.when(F.col("_text").rlike(pattern), F.lit(lex.RECAP_PATTERN_WEIGHT)).otherwise(F.lit(0.0))
    return (
        once(lowered, recap_score=score)
        .withColumn("is_recap", F.col("recap_score") >= lex.RECAP_FLAG_AT)
        .withColumn("recap_confidence", F.least(F.col("recap_score") / F.lit(5.0), F.lit(1.0)))
        .withColumn("recap_dropped", F.col("recap_score") > lex.RECAP_DROP_ABOVE)
        .drop("_text")
    )


def confidence(df: DataFrame, as_of: str, published: str = "published") -> DataFrame:
    """Confidence points and level; the recency bonus compares in UTC."""
    lowered = once(df, _source=F.lower(F.coalesce("source", F.lit(""))),
                   _title=F.lower(F.coalesce("title", F.lit(""))))
    points = sum(
        (F.when(has_any(F.col("_" + col), words), F.lit(n)).otherwise(F.lit(0))
         for n, col, words in lex.CONFIDENCE_POINTS), F.lit(0))
    seconds = F.timestamp_diff("SECOND", F.col(published), F.lit(as_of).cast("timestamp_ntz"))
    points = points + F.coalesce(steps(seconds, [(6 * 3600, 10), (24 * 3600, 5)], 0, "lt"), F.lit(0))
    return (
        once(lowered, confidence_points=points)
        .withColumn("confidence", steps(F.col("confidence_points"), lex.CONFIDENCE_LEVELS, "OSINT"))
        .drop("_source", "_title")
    )


def signature(df: DataFrame, title: str = "title", location: str = "location", date: str = "date") -> DataFrame:
    """Event type, known places of the location and the full date string, hashed."""
    lowered = once(df, _title=F.lower(F.coalesce(F.col(title), F.lit(""))),
                   _place=F.lower(F.coalesce(F.col(location), F.lit(""))))
    known = once(lowered, event_kind=first_label(F.col("_title"), lex.EVENT_TYPES, "incident"),
                 _places=place_keywords(F.col("_place")))
    places = F.col("_places")
    return known.withColumn("signature", F.substring(
        F.md5(F.concat_ws(":", F.col("event_kind"), places, F.coalesce(F.col(date), F.lit(""))).cast("binary")), 1, 16)).drop("_title", "_place", "_places")


def with_ids(df: DataFrame, title: str = "title", source: str = "source") -> DataFrame:
    """Stable incident id from title and source, all 64 bits of the hash."""
    return df.withColumn("incident_id", F.xxhash64(F.col(title), F.col(source)))


def event_ids(df: DataFrame, as_of: str, seq: str = "seq", prefix: str = "EV") -> DataFrame:
    """Readable event ids: prefix, run time in ms, running number. The number is
    the row's own arrival sequence, so no global sort is needed to assign it."""
    millis = F.unix_millis(F.lit(as_of).cast("timestamp"))
    return df.withColumn("event_id", F.concat(F.lit(f"{prefix}-"), millis.cast("string"), F.lit("-"),
                                              F.when(F.length(F.col(seq).cast("string")) >= 4,
                                                     F.col(seq).cast("string"))
                                              .otherwise(F.lpad(F.col(seq).cast("string"), 4, "0"))))


# --- names, places, sources -------------------------------------------------

def normalize_text(text: Column) -> Column:
    """Lower case without punctuation; letters of every script stay."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""))


def normalize_name(text: Column) -> Column:
    """Lower case, ASCII letters, digits and spaces only, double spaces halved."""
    return F.trim(F.replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), F.lit("  "), F.lit(" ")))


def location_key(country: Column, city: Column, title: Column) -> Column:
    """``city_country``, or the country, or the first known place in the title."""
    land = F.lower(F.coalesce(country, F.lit("")))
    town = F.lower(F.coalesce(city, F.lit("")))
    named = first_word(F.lower(F.coalesce(title, F.lit(""))), lex.GROUPING_PLACES)
    joined = F.when(town != "", F.concat(town, F.lit("_"), land)).otherwise(land)
    return F.when(land == "", F.coalesce(named, joined)).otherwise(joined)


def source_tier(source: Column, is_government: Column) -> Column:
    lowered = F.lower(F.coalesce(source, F.lit("")))
    return (F.when(F.coalesce(is_government, F.lit(False)), F.lit("government"))
            .when(has_any(lowered, lex.MAJOR_NEWS), F.lit("major_news"))
            .when(has_any(lowered, lex.REGIONAL_NEWS), F.lit("regional_news"))
            .otherwise(F.lit("social")))


def reliability_group(source: Column) -> Column:
    return first_label(F.lower(F.coalesce(source, F.lit("Unknown"))), lex.RELIABILITY_GROUPS, "Other")


def ui_severity(title: Column, badge: Column) -> Column:
    lowered = F.lower(F.coalesce(title, F.lit("")))
    return (F.when(badge == "CRITICAL", F.lit("critical"))
            .when(has_any(lowered, lex.HIGH_SEVERITY_WORDS), F.lit("high"))
            .when(has_any(lowered, lex.MEDIUM_SEVERITY_WORDS), F.lit("medium"))
            .otherwise(F.lit("low")))


def country_code(country: Column) -> Column:
    return F.coalesce(lookup(F.lower(country), dict(dims.COUNTRY_ALIASES), "unknown"), F.lit("unknown"))


def canonical_country(df: DataFrame, countries: DataFrame | None = None, col: str = "country") -> DataFrame:
    """Code, display name and flag of a country name, by join with the country
    tables; unknown names keep code ``unknown`` and the globe flag."""
    spark = df.sparkSession
    flags = dict((r[0], r[3]) for r in dims.COUNTRIES)
    shown = dict(dims.DISPLAY_NAMES)
    if countries is None:
        countries = dims.seed_table(
            spark, [(alias, code, shown.get(code, code.upper()), flags.get(code, "🌍"))
                    for alias, code in dims.COUNTRY_ALIASES],
            ["alias", "country_code", "display_name", "flag"])
    joined = df.join(countries, F.lower(F.col(col)) == F.col("alias"), "left").drop("alias")
    return (joined.withColumn("country_code", F.coalesce("country_code", F.lit("unknown")))
            .withColumn("display_name", F.coalesce("display_name", F.lit("UNKNOWN")))
            .withColumn("flag", F.coalesce("flag", F.lit("🌍"))))


def iso2(country: Column) -> Column:
    return lookup(F.lower(country), {n.lower(): c for c, n in dims.ISO_NAMES}, None)


def age_bucket(df: DataFrame, as_of: str, col: str = "published") -> DataFrame:
    """Age label (s/m/h/d ago) and freshness band."""
    age = F.timestamp_diff("SECOND", F.col(col), F.lit(as_of).cast("timestamp_ntz"))
    aged = df.withColumn("age_seconds", age)
    secs = F.col("age_seconds")

    def label(unit: int, suffix: str) -> Column:
        return F.concat(F.floor(secs / F.lit(unit)).cast("string"), F.lit(suffix))

    return (
        aged.withColumn("age_label", F.when(secs.isNull(), F.lit("Unknown"))
                        .when(secs < 60, label(1, "s ago")).when(secs < 3600, label(60, "m ago"))
                        .when(secs < 86400, label(3600, "h ago")).otherwise(label(86400, "d ago")))
        .withColumn("freshness", steps(secs, [(300, "under 5m"), (1800, "5-30m"), (3600, "30-60m")],
                                       "over 1h", "lt"))
    )


def source_profile(df: DataFrame, profiles: DataFrame | None = None, col: str = "source") -> DataFrame:
    if profiles is None:
        profiles = dims.seed_table(df.sparkSession, dims.SOURCE_PROFILES,
                                   ["profile", "source_country", "reliability", "bias"])
    return (
        df.join(profiles, F.col(col) == F.col("profile"), "left").drop("profile")
        .withColumn("source_country", F.coalesce("source_country", F.lit("unknown")))
        .withColumn("reliability", F.coalesce("reliability", F.lit(0.5)))
        .withColumn("bias", F.coalesce("bias", F.lit("unknown")))
    )


def enrich_source(df: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Entries joined with the feed registry on the feed name."""
    if registry is None:
        registry = dims.seed_table(df.sparkSession, dims.FEEDS,
                                   ["source", "feed_country", "feed_credibility", "feed_government"])
    return df.join(registry, "source", "inner")


# --- sentiment, entities, actors -------------------------------------------

def sentiment(df: DataFrame, col: str = "title", phrases: bool = False) -> DataFrame:
    """Distinct-token sentiment. Terms of two words never equal a token; with
    ``phrases=True`` they are searched in the text instead."""
    text = F.lower(F.coalesce(F.col(col), F.lit("")))
    tokens = F.filter(F.array_distinct(F.split(text, r"\s+")), lambda t: t != "")
    out = once(df, _text=text, _tokens=tokens)

    def terms(words: Sequence[str]) -> Column:
        hits = F.array_intersect(F.array(*[F.lit(w) for w in words]), F.col("_tokens"))
        if phrases:
            multi = [w for w in words if " " in w]
            if multi:
                hits = F.array_union(hits, hit_words(F.col("_text"), multi))
        return F.array_sort(hits)

    out = once(out, positive_terms=terms(lex.POSITIVE_WORDS), negative_terms=terms(lex.NEGATIVE_WORDS),
               critical_terms=terms(lex.CRITICAL_WORDS))
    raw = ((F.size("positive_terms") - F.size("negative_terms")).cast("double")
           / F.greatest(F.lit(1), F.size("_tokens")) * F.lit(100.0))
    return (
        out.withColumn("_raw", raw)
        .withColumn("sentiment_score", F.round("_raw", 1))
        .withColumn("sentiment", F.when(F.col("_raw") > 10, "positive")
                    .when(F.col("_raw") < -10, "negative").otherwise("neutral"))
        .withColumn("critical_score", F.least(F.lit(100), F.size("critical_terms") * 10))
        .drop("_text", "_tokens", "_raw")
    )


def hashtags(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("tag", F.explode(F.regexp_extract_all(F.col(col), F.lit(r"#(\w+)"), F.lit(1))))


def extract_entities(df: DataFrame, countries: str = "countries", title: str = "title") -> DataFrame:
    """One row per entity mention: the row's countries and the organisations its
    title names. Both lists are built in the row, so mentions cost no join."""
    names = F.create_map(*[F.lit(x) for pair in dims.ISO_NAMES for x in pair])
    lowered = F.lower(F.coalesce(F.col(title), F.lit("")))

    def entity(id_, name, kind, country, aliases):
        return F.struct(id_.alias("entity_id"), name.alias("entity_name"), F.lit(kind).alias("entity_type"),
                        country.alias("entity_country"), aliases.alias("aliases"))

    nation = F.transform(F.coalesce(F.col(countries), F.array().cast("array<string>")), lambda c: entity(
        F.concat(F.lit("country_"), c), F.coalesce(F.try_element_at(names, c), c), "nation", c,
        F.array(F.coalesce(F.try_element_at(names, c), c), c)))
    orgs = F.filter(F.array(*[
        F.when(lowered.contains(code.lower()), entity(
            F.lit("org_" + code.lower()), F.lit(name), "organization", F.lit(None).cast("string"),
            F.array(F.lit(code), F.lit(name))))
        for code, name in dims.ORGANIZATIONS]), lambda e: e.isNotNull())
    return df.withColumn("entity", F.explode(F.concat(nation, orgs))).select("*", "entity.*").drop("entity")


def actor_action(df: DataFrame, col: str = "title") -> DataFrame:
    """First actor and first action named; both null unless both are found."""
    lowered = once(df, _text=F.lower(F.coalesce(F.col(col), F.lit(""))))
    lowered = once(lowered, _actor=first_label(F.col("_text"), lex.ACTORS, None),
                   _action=first_label(F.col("_text"), lex.ACTIONS, None))
    both = F.col("_actor").isNotNull() & F.col("_action").isNotNull()
    return (lowered.withColumn("actor", F.when(both, F.col("_actor")))
            .withColumn("action", F.when(both, F.col("_action"))).drop("_text", "_actor", "_action"))


def threat_indicators(posts: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Posts of known accounts with at least one threat word."""
    if accounts is None:
        accounts = dims.seed_table(posts.sparkSession, dims.ACCOUNTS,
                                   ["account", "account_name", "account_country", "account_credibility"])
    return (
        once(once(posts, _text=F.lower("content")), threat_indicators=hit_words(F.col("_text"), lex.THREAT_WORDS))
        .filter(F.size("threat_indicators") > 0)
        .withColumn("threat_severity", F.when(F.size("threat_indicators") >= 2, "high").otherwise("medium"))
        .drop("_text").join(accounts, "account")
    )


def interception_flags(df: DataFrame) -> DataFrame:
    """``is_intercepted``, and ``is_impacted`` for what was not intercepted."""
    title = F.lower(F.coalesce("title", F.lit("")))
    kind = F.lower(F.coalesce("type", F.lit("")))
    out = once(df, _title=title, _kind=kind)
    return (
        once(out, is_intercepted=has_any(F.col("_title"), lex.INTERCEPTION_WORDS) | (F.col("_kind") == "air_defense"))
        .withColumn("is_impacted", ~F.col("is_intercepted") & (
            F.col("_kind").isin(lex.IMPACT_TYPES) | has_any(F.col("_title"), lex.IMPACT_WORDS)))
        .drop("_title", "_kind")
    )


def time_key(ts: Column, bucket: str = "day") -> Column:
    """Bucket label: hour, day or Sunday-based week of year."""
    if bucket == "hour":
        return F.date_format(ts, "yyyy-MM-dd HH:00")
    if bucket == "week":
        week = F.floor((F.dayofyear(ts) + F.lit(7) - F.dayofweek(ts)) / F.lit(7))
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM-dd")


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal normalised names, 0.8 when one holds the other, else by length."""
    na, nb = normalize_name(a), normalize_name(b)
    longer, shorter = F.greatest(F.length(na), F.length(nb)), F.least(F.length(na), F.length(nb))
    by_length = F.greatest(F.lit(0.0), F.lit(1.0) - (longer - shorter) / longer * F.lit(0.5))
    return (F.when(na == nb, F.lit(1.0)).when(na.contains(nb) | nb.contains(na), F.lit(0.8))
            .otherwise(by_length))


# --- cleansing --------------------------------------------------------------

def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def sanitize_url(url: Column, allow_relative: bool = False) -> Column:
    """Safe form of a URL: ``#`` for a script-like or unknown scheme, ``https://``
    put before one without a scheme."""
    clean = F.trim(F.coalesce(url, F.lit("")))
    lowered = F.lower(clean)
    decoded = lowered
    for entity, raw in (("&colon;", ":"), ("&#58;", ":"), ("&#x3a;", ":"), ("&tab;", "\t"),
                        ("&newline;", "\n"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(entity), F.lit(raw))
    bad = any_of(t.startswith(s) for t in (lowered, decoded) for s in lex.DANGEROUS_SCHEMES)
    out = F.when((clean == "") | bad, F.lit("#"))
    if allow_relative:
        out = out.when(~clean.contains("://") & clean.startswith("/"), clean)
    return (out.when(~clean.contains("://"), F.concat(F.lit("https://"), clean))
            .when(~any_of(lowered.startswith(s) for s in lex.ALLOWED_SCHEMES), F.lit("#"))
            .otherwise(clean))


def sanitize_id(value: Column) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^a-zA-Z0-9\-_]", ""), 1, 100)


def valid_country_code(code: Column) -> Column:
    return F.coalesce(code.rlike(r"^[a-zA-Z]{2}$"), F.lit(False))


def sanitize(df: DataFrame, text: str = "title", url: str = "source_url", id_col: str = "raw_id",
             code: str = "country_iso") -> DataFrame:
    """Cleansed columns plus one flag per rule that changed or refused a value."""
    return (
        df.withColumn("safe_text", escape_html(F.col(text)))
        .withColumn("safe_url", sanitize_url(F.col(url), allow_relative=True))
        .withColumn("safe_id", sanitize_id(F.col(id_col).cast("string")))
        .withColumn("text_changed", F.col("safe_text") != F.coalesce(F.col(text), F.lit("")))
        .withColumn("url_refused", F.col("safe_url") == "#")
        .withColumn("id_changed", F.col("safe_id") != F.coalesce(F.col(id_col).cast("string"), F.lit("")))
        .withColumn("code_invalid", ~valid_country_code(F.col(code)))
    )


def violations(sanitized: DataFrame, by: str = "source") -> DataFrame:
    flags = ("text_changed", "url_refused", "id_changed", "code_invalid")
    return sanitized.groupBy(by).agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def fingerprint(df: DataFrame, incident: str = "incident_id", agent: str = "user_agent", ip: str = "ip") -> DataFrame:
    """Device fingerprint; the address enters only as a hash."""
    address = F.coalesce(F.col(ip), F.lit(""))
    hashed = F.when(address == "", F.lit("no-ip")).otherwise(
        F.substring(F.sha2(address.cast("binary"), 256), 1, 16))
    return df.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws(
        ":", F.col(incident), F.coalesce(F.col(agent), F.lit("")), hashed).cast("binary"), 256), 1, 16))


def display_labels(df: DataFrame) -> DataFrame:
    """Short labels used by the exports: cut title, type name, short type."""
    pretty = F.initcap(F.replace(F.col("type"), F.lit("_"), F.lit(" ")))
    return (
        df.withColumn("title_100", F.substring("title", 1, 100))
        .withColumn("type_name", F.coalesce(lookup(F.col("type"), dims.TYPE_NAMES, None), pretty))
        .withColumn("type_short", F.coalesce(lookup(F.col("type"), dims.TYPE_SHORT_LABELS, None),
                                             F.substring(F.upper("type"), 1, 3)))
    )
