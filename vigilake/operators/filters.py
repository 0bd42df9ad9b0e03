"""Row filters. All of them are plain predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions import dims, lexicons as lex
from vigilake.functions.match import any_of, has_any, once
from vigilake.operators.enrich import country_code, ui_severity

TIME_FACETS_HOURS = {"24h": 24, "7d": 168, "30d": 720}


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def hours_before(as_of: str, hours: float) -> Column:
    return at(as_of) - F.expr(f"INTERVAL '{int(hours * 3600)}' SECOND")


#: Longest lexicon table that is read into a predicate.
PREDICATE_WORDS = 1000
GRAM = 3


def filter_relevant(df: DataFrame, words: Sequence[str] | DataFrame = None, col: str = "title",
                    most: int = PREDICATE_WORDS) -> DataFrame:
    """Keep rows whose text holds a keyword. A list, or a DataFrame with a
    ``keyword`` column of at most ``most`` rows, becomes one OR predicate; a longer
    lexicon is joined by ``holding_any``."""
    words = lex.RELEVANCE_WORDS if words is None else words
    if isinstance(words, DataFrame):
        head = [r["keyword"] for r in words.select("keyword").dropna().distinct().limit(most + 1).collect()]
        if len(head) > most:
            return holding_any(df, words, col)
        words = sorted(head)
    if not words:
        return df.limit(0)
    lowered = once(df, _text=F.lower(F.col(col)))  # else every keyword test lower-cases again
    return lowered.filter(has_any(F.col("_text"), words)).drop("_text")


def holding_any(df: DataFrame, words: DataFrame, col: str) -> DataFrame:
    """Rows whose lower-cased text holds a ``keyword`` of any number of them.

    A text that holds a keyword holds its first ``GRAM`` letters, so texts (equal
    ones once) and keywords meet by an equi join on those; only such pairs are
    tested. A keyword shorter than that is its own gram, an empty one is in every text.
    """
    lowered = once(df, _text=F.lower(F.col(col)))
    texts = lowered.select(F.md5("_text").alias("_key"), "_text").dropna().dropDuplicates(["_key"])
    # one scan per text, the letters at each place and behind it; a substring by number would count from the start each time
    longest = F.array_distinct(F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{1,{GRAM}}}))"), F.lit(1)))
    sizes = [F.array_distinct(F.transform("_long", lambda g: F.substring(g, 1, n))) for n in range(1, GRAM)]
    grams = once(texts, _long=longest).select("_key", F.explode(F.array_distinct(F.concat(
        F.array(F.lit("")), *sizes, F.col("_long")))).alias("_gram"))
    known = words.select("keyword").dropna().distinct().withColumn("_gram", F.substring("keyword", 1, GRAM))
    near = grams.join(known, "_gram").select("_key", "keyword").distinct()
    held = near.join(texts, "_key").filter(F.col("_text").contains(F.col("keyword"))).select("_key").distinct()
    return lowered.withColumn("_key", F.md5("_text")).join(held, "_key", "left_semi").select(
        *[F.col(f"`{c}`") for c in df.columns])


def filter_recent(df: DataFrame, as_of: str, hours: int = 72, col: str = "published") -> DataFrame:
    """Published no more than ``hours`` before ``as_of``; a missing date counts as now."""
    return df.filter(F.col(col).isNull() | (F.col(col) >= hours_before(as_of, hours)))


def filter_days(df: DataFrame, as_of: str, days: int = 14, col: str = "published") -> DataFrame:
    return df.filter(F.col(col) >= hours_before(as_of, 24 * days))


def head_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int,
                 salts: int = 32, id_col: str = "id") -> DataFrame:
    """First ``n`` rows per key. The first window runs on (key, salt), so a key
    that owns a third of the data is cut to ``n * salts`` rows before all of its
    survivors meet in one group."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)))
    inner = Window.partitionBy(key, "_salt").orderBy(*order)
    outer = Window.partitionBy(key).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(inner)).filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(outer)).filter(F.col("_rn") <= n)
        .drop("_salt").withColumnRenamed("_rn", "rn")
    )


def facet_filter(df: DataFrame, as_of: str, country: Sequence[str] | None = None,
                 severity: Sequence[str] | None = None, type: Sequence[str] | None = None,
                 time: str | None = None, search: str | None = None,
                 min_credibility: int | None = None) -> DataFrame:
    """Conjunction of the chosen facets; ``None`` means all."""
    tests = []
    if country is not None:
        tests.append(country_code(F.col("country")).isin(list(country)))
    if severity is not None:
        tests.append(ui_severity(F.col("title"), F.col("badge")).isin(list(severity)))
    if type is not None:
        tests.append(F.coalesce(F.lower("type"), F.lit("unknown")).isin(list(type)))
    if time is not None:
        tests.append(F.col("published") >= hours_before(as_of, TIME_FACETS_HOURS[time]))
    if min_credibility is not None:
        tests.append(F.col("credibility") >= min_credibility)
    if search:
        tests.append(any_of(
            F.coalesce(F.lower(F.col(c)), F.lit("")).contains(search.lower()) for c in ("title", "source", "country")
        ))
    for test in tests:
        df = df.filter(test)
    return df


def critical_events(df: DataFrame, n: int = 5) -> DataFrame:
    return df.filter(F.col("severity") == "critical").orderBy("seq").limit(n)


def alerts(df: DataFrame, min_score: int = 50, n: int = 10, sentiment: str | None = None) -> DataFrame:
    """First ``n`` rows (arrival order) whose critical score exceeds ``min_score``,
    then those of one sentiment if asked."""
    out = df.filter(F.col("critical_score") > min_score).orderBy("seq").limit(n)
    return out if sentiment is None else out.filter(F.col("sentiment") == sentiment)


def filter_valid_coords(df: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    return df.filter(
        F.col(lat).try_cast("double").between(-90, 90) & F.col(lng).try_cast("double").between(-180, 180)
    )


def filter_bbox(df: DataFrame, box: str | tuple, lat: str = "lat", lng: str = "lng") -> DataFrame:
    lat_min, lat_max, lng_min, lng_max = dims.BOXES[box] if isinstance(box, str) else box
    return df.filter(F.col(lat).between(lat_min, lat_max) & F.col(lng).between(lng_min, lng_max))


def filter_notams(df: DataFrame, severity: str = "all") -> DataFrame:
    return df if severity == "all" else df.filter(F.col("severity") == severity)


def active_notams(df: DataFrame, as_of: str) -> DataFrame:
    """Valid at ``as_of``: start included, end excluded."""
    return df.filter((F.col("valid_from") <= at(as_of)) & (at(as_of) < F.col("valid_until")))


def defense_relevant(df: DataFrame) -> DataFrame:
    """Interception-related rows with a known country (adds ``country_code``)."""
    marked = once(df, _title=F.lower(F.coalesce("title", F.lit(""))), country_code=country_code(F.col("country")))
    return (
        marked.filter(F.lower("type").isin(lex.DEFENSE_TYPES) | has_any(F.col("_title"), lex.DEFENSE_WORDS))
        .filter(F.col("country_code") != "unknown").drop("_title")
    )


def new_hotspots(df: DataFrame, min_frp: float = 50.0, n: int = 5) -> DataFrame:
    return df.filter(F.col("frp") > min_frp).orderBy("id").limit(n)


def airspace_alerts(df: DataFrame) -> DataFrame:
    located = (F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lng", F.lit(0.0)) != 0)
    return df.filter(F.col("type").isin("air_defense", "alert") & located)


def filter_country(df: DataFrame, code: str, col: str = "countries") -> DataFrame:
    return df.filter(F.array_contains(col, code))


def flag_arabic(df: DataFrame, col: str = "title") -> DataFrame:
    return df.withColumn("has_arabic", F.coalesce(F.col(col).rlike("[\\u0600-\\u06FF]"), F.lit(False)))


def visible(passes: DataFrame, min_elevation: float = 10.0) -> DataFrame:
    return passes.filter(F.col("elevation") >= min_elevation)
