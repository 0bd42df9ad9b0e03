"""Geocoding cascade: text coordinates, city, near-miss city name, country,
region, default point. Every tier records where the point came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import dims
from vigilake.functions.match import first_word, once
from vigilake.operators.similarity import ratio

_CITIES = [r[0] for r in dims.GEO_CITIES]


def text_coordinates(text: Column) -> Column:
    """First coordinate pattern whose numbers are in range, as struct(lat, lng)."""
    found = []
    for pattern in dims.COORDINATE_PATTERNS:
        lat = F.regexp_extract(text, pattern, 1).try_cast("double")
        lng = F.regexp_extract(text, pattern, 2).try_cast("double")
        found.append(F.when(lat.between(-90, 90) & lng.between(-180, 180),
                            F.struct(lat.alias("lat"), lng.alias("lng"))))
    return F.coalesce(*found)


def _city(text: Column) -> Column:
    return F.when(text.isin(_CITIES), text).otherwise(first_word(text, _CITIES))


def nearest_name(tokens: DataFrame, names: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """Best name for every distinct token with similarity >= ``cutoff``; equal
    scores go to the later name in alphabetical order. ``names`` is a gazetteer
    with column ``name``; lengths that cannot reach the cutoff never meet: each
    name is listed under every length it could match, an equi join."""
    reach = F.sequence(F.ceil(F.length("name") * F.lit(cutoff / (2 - cutoff)) - 1e-9).cast("int"),
                       F.floor(F.length("name") * F.lit((2 - cutoff) / cutoff) + 1e-9).cast("int"))
    by_length = names.select("name", F.explode(reach).alias("_len"))
    distinct = tokens.select("token").distinct().withColumn("_len", F.length("token"))
    # a pair at the cutoff is at most (1 - cutoff) x (total length) edits apart
    budget = F.floor((F.length("name") + F.length("token")) * F.lit(1 - cutoff) + 1e-9)
    close = distinct.join(by_length, "_len").filter(F.levenshtein("name", "token") <= budget)
    scored = close.withColumn("score", ratio(F.col("name"), F.col("token")))
    return scored.filter(F.col("score") >= cutoff).groupBy("token").agg(
        F.max(F.struct("score", "name")).alias("best")).select("token", F.col("best.name").alias("name"), "best.score")


def _fuzzy(rows: DataFrame, col: str, out: str, id_col: str) -> DataFrame:
    """First token of the text that is close to a city name, for rows that have
    one; other rows do not appear."""
    tokens = rows.select(id_col, F.posexplode(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"\s+"))
                         .alias("pos", "token")).filter(F.col("token") != "")
    names = dims.seed_table(rows.sparkSession, _CITIES, ["name"])
    return tokens.join(nearest_name(tokens, names), "token").groupBy(id_col).agg(
        F.min_by("name", "pos").alias(out))


def geocode(df: DataFrame, id_col: str = "id", title: str = "title", location: str = "location",
            content: str = "content", fuzzy: bool = True) -> DataFrame:
    """Adds geo_lat, geo_lng, geo_source, geo_approximate, geo_country. Each tier
    tries the location text before the title, as one unit with its fuzzy match."""
    text = F.lower(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(content), F.lit(""))))
    loc, ttl = F.lower(F.coalesce(F.col(location), F.lit(""))), F.lower(F.coalesce(F.col(title), F.lit("")))
    out = once(once(df, _text=text, _loc=loc, _ttl=ttl), _point=text_coordinates(F.col("_text")),
               _loc_city=_city(F.col("_loc")), _ttl_city=_city(F.col("_ttl")))
    if fuzzy:
        open_rows = out.filter(F.col("_point").isNull() & F.col("_loc_city").isNull())
        near_loc = _fuzzy(open_rows, "_loc", "_loc_near", id_col)
        near_ttl = _fuzzy(open_rows.filter(F.col("_ttl_city").isNull()), "_ttl", "_ttl_near", id_col)
        out = out.join(near_loc, id_col, "left").join(near_ttl, id_col, "left")
    else:
        out = out.withColumn("_loc_near", F.lit(None).cast("string")).withColumn(
            "_ttl_near", F.lit(None).cast("string"))
    lands, areas = [r[0] for r in dims.GEO_COUNTRIES], [r[0] for r in dims.GEO_REGIONS]

    def area(text_col: str) -> Column:
        return F.coalesce(F.concat(F.lit("country_center:"), first_word(F.col(text_col), lands)),
                          F.concat(F.lit("region:"), first_word(F.col(text_col), areas)))

    source = (
        F.when(F.col("_point").isNotNull(), F.lit("extracted_from_text")).otherwise(F.coalesce(
            F.concat(F.lit("city_lookup:"), F.col("_loc_city")), F.concat(F.lit("fuzzy_match:"), F.col("_loc_near")),
            F.concat(F.lit("city_lookup:"), F.col("_ttl_city")), F.concat(F.lit("fuzzy_match:"), F.col("_ttl_near")),
            area("_loc"), area("_ttl"), F.lit(dims.GEO_FALLBACK[2])))
    )
    places = dims.seed_table(
        df.sparkSession,
        [(f"{how}:{k}", lat, lng, country) for how in ("city_lookup", "fuzzy_match")
         for k, lat, lng, country in dims.GEO_CITIES]
        + [(f"country_center:{k}", lat, lng, None) for k, lat, lng in dims.GEO_COUNTRIES]
        + [(f"region:{k}", lat, lng, None) for k, lat, lng in dims.GEO_REGIONS],
        ["geo_source", "_lat", "_lng", "geo_country"])
    lat, lng, _ = dims.GEO_FALLBACK
    return (
        out.withColumn("geo_source", source).join(places, "geo_source", "left")
        .withColumn("geo_lat", F.coalesce("_point.lat", "_lat", F.lit(lat)))
        .withColumn("geo_lng", F.coalesce("_point.lng", "_lng", F.lit(lng)))
        .withColumn("geo_approximate", ~F.col("geo_source").startswith("city_lookup")
                    & ~F.col("geo_source").startswith("fuzzy_match")
                    & (F.col("geo_source") != "extracted_from_text"))
        .drop("_text", "_loc", "_ttl", "_point", "_loc_city", "_ttl_city", "_loc_near", "_ttl_near", "_lat", "_lng")
    )
