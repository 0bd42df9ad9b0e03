"""Aggregations over incidents: regional and country statistics, dashboards,
source reliability, casualty and severity summaries.

Every aggregate is one pass with map-side partial aggregation; several facets
over the same rows share that pass through grouping sets or ``count_if``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions import dims, lexicons as lex
from vigilake.functions.match import has_any, lookup, round_half_up, steps
from vigilake.operators.enrich import (casualties, classify_with_confidence, country_code,
                                       dominant_country, interception_flags, reliability_group,
                                       ui_severity)
from vigilake.operators.filters import defense_relevant, head_per_key, hours_before


def zero_fill(dimension: DataFrame, counts: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Every dimension row, with zeros where the aggregate has none."""
    out = dimension.join(counts, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


# --- regional and country statistics ---------------------------------------

_MEASURES = ["incidents", "casualties_total", "casualties_military", "casualties_civilian",
             "missiles_launched", "missiles_intercepted", "missiles_landed",
             "airstrikes", "drones", "drones_downed"]


def stats_facts(incidents: DataFrame) -> DataFrame:
    """Per-row facts behind the statistics: type, country, summed casualties."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    typed = classify_with_confidence(incidents)
    placed = dominant_country(typed, text, F.col("lat"), F.col("lng"))
    return casualties(placed, text, mode="sum", prefix="cas")


def _measures() -> list[Column]:
    kind, title = F.col("stats_type"), F.lower(F.coalesce("title", F.lit("")))
    missile, drone = kind == "missile", kind == "drone"
    stopped = title.contains("intercept") | title.contains("shot down")
    downed = title.contains("downed") | title.contains("shot down")
    return [
        F.count("*").alias("incidents"),
        F.sum("cas_total").alias("casualties_total"),
        F.sum("cas_military").alias("casualties_military"),
        F.sum("cas_civilian").alias("casualties_civilian"),
        F.count_if(missile).alias("missiles_launched"),
        F.count_if(missile & stopped).alias("missiles_intercepted"),
        F.count_if(missile & ~stopped).alias("missiles_landed"),
        F.count_if(kind == "airstrike").alias("airstrikes"),
        F.count_if(drone).alias("drones"),
        F.count_if(drone & downed).alias("drones_downed"),
    ]


def regional_stats(facts: DataFrame) -> DataFrame:
    """Totals, per type and per country in one pass. ``scope`` names the facet;
    rows without a known country count in the totals and types only."""
    sets = facts.groupingSets([[], ["stats_type"], ["stats_country"]], "stats_type", "stats_country")
    grouped = sets.agg(F.grouping_id().alias("_g"), *_measures())
    return (
        grouped.withColumn("scope", lookup(F.col("_g"), {3: "total", 1: "type", 2: "country"}, None))
        .withColumn("label", F.coalesce("stats_type", "stats_country", F.lit("all")))
        .filter(~((F.col("scope") == "country") & (F.col("label") == "unknown")))
        .select("scope", "label", *_MEASURES)
    )


def recent_per_country(facts: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` incidents per country in arrival order (position 1 = oldest kept)."""
    known = facts.filter(F.col("stats_country") != "unknown").select(
        "seq", "id", "stats_country", F.substring("title", 1, 100).alias("title"), "stats_type",
        "published", "cas_total")
    last = head_per_key(known, "stats_country", [F.col("seq").desc()], n)
    return last.withColumn("position", F.row_number().over(
        Window.partitionBy("stats_country").orderBy("seq"))).drop("rn")


def country_trend(recent: DataFrame) -> DataFrame:
    """Second half of the last incidents against the first, by rows with casualties."""
    sized = recent.withColumn("_n", F.count("*").over(Window.partitionBy("stats_country")))
    late = F.col("position") > F.floor(F.col("_n") / 2)
    counts = sized.groupBy("stats_country").agg(
        F.max("_n").alias("recent_incidents"),
        F.count_if(~late & (F.col("cas_total") > 0)).alias("first_half"),
        F.count_if(late & (F.col("cas_total") > 0)).alias("second_half"))
    return counts.withColumn(
        "trend", F.when(F.col("recent_incidents") < 3, "stable")
        .when(F.col("second_half") > F.col("first_half") * F.lit(1.2), "increasing")
        .when(F.col("second_half") < F.col("first_half") * F.lit(0.8), "decreasing")
        .otherwise("stable"))


def country_stats(facts: DataFrame) -> DataFrame:
    """One record per listed country, zero-filled, with its trend."""
    spark = facts.sparkSession
    listed = dims.seed_table(spark, dims.COUNTRIES, dims.COUNTRY_COLUMNS).select("code", "name", "flag")
    counts = facts.groupBy(F.col("stats_country").alias("code")).agg(*_measures())
    trend = country_trend(recent_per_country(facts)).select(
        F.col("stats_country").alias("code"), "recent_incidents", "trend")
    return (
        zero_fill(listed, counts.join(trend, "code", "left"), "code", [*_MEASURES, "recent_incidents"])
        .withColumn("trend", F.coalesce("trend", F.lit("stable")))
    )


# --- dashboards -------------------------------------------------------------

def casualty_totals(df: DataFrame) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(F.col(f"casualties_{k}")), F.lit(0)).alias(k)
                    for k in ("total", "military", "civilian", "injured")])


def validation_counts(df: DataFrame) -> DataFrame:
    status = F.coalesce("verification_status", F.lit("UNCONFIRMED"))
    return df.agg(
        F.count_if(status == "VERIFIED").alias("validated"),
        F.count_if(~status.isin("VERIFIED", "DISPUTED")).alias("pending"),
        F.count_if(status == "DISPUTED").alias("disputed"))


def badge_summary(df: DataFrame, col: str = "badge") -> DataFrame:
    badges = dims.seed_table(df.sparkSession, ["VERIFIED", "LIKELY", "PARTIAL", "UNCONFIRMED"], ["badge"])
    return zero_fill(badges, df.groupBy(F.col(col).alias("badge")).agg(F.count("*").alias("n")), "badge", ["n"])


def airspace_status(df: DataFrame) -> DataFrame:
    out = df.agg(F.count_if(F.col("type").isin("air_defense", "alert")).alias("alerts"))
    return (out.withColumn("status", F.when(F.col("alerts") > 0, "warning").otherwise("normal"))
            .withColumn("label", F.when(F.col("alerts") > 0, F.concat(F.col("alerts").cast("string"),
                                                                      F.lit(" Active Alerts"))).otherwise("Clear")))


def source_reliability(df: DataFrame, k: int = 5) -> DataFrame:
    verified = F.coalesce("verification_status", F.lit("UNCONFIRMED")) == "VERIFIED"
    counts = df.groupBy(F.coalesce("source", F.lit("Unknown")).alias("source")).agg(
        F.count("*").alias("reports"), F.count_if(verified).alias("verified"))
    scored = counts.withColumn("reliability", round_half_up(F.col("verified") * 100.0 / F.col("reports")))
    return top_k(scored, [F.desc("reports"), F.asc("source")], k)


def reliability_by_group(df: DataFrame) -> DataFrame:
    """Reports, distinct sources and verified share per source group. Reports are
    first summed per source, so the distinct count never shuffles raw rows."""
    verified = F.coalesce("verification_status", F.lit("UNCONFIRMED")) == "VERIFIED"
    per_source = df.groupBy(F.coalesce("source", F.lit("Unknown")).alias("source")).agg(
        F.count("*").alias("n"), F.count_if(verified).alias("v"))
    grouped = per_source.groupBy(reliability_group(F.col("source")).alias("source_group")).agg(
        F.sum("n").alias("reports"), F.count("*").alias("sources"), F.sum("v").alias("verified"))
    scored = grouped.withColumn("reliability", round_half_up(F.col("verified") * 100.0 / F.col("reports")))
    return scored.withColumn("label", steps(F.col("reliability"), [(80, "High"), (50, "Medium")], "Low"))


def severity_distribution(df: DataFrame) -> DataFrame:
    """Counts and whole-percent share of all four UI severities."""
    levels = dims.seed_table(df.sparkSession, ["critical", "high", "medium", "low"], ["severity_level"])
    counts = df.groupBy(ui_severity(F.col("title"), F.col("badge")).alias("severity_level")).agg(
        F.count("*").alias("n"))
    filled = zero_fill(levels, counts, "severity_level", ["n"])
    total = filled.agg(F.sum("n").alias("_total"))
    return (filled.join(F.broadcast(total))  # one row by construction
            .withColumn("share_pct", F.when(F.col("_total") > 0, round_half_up(
                F.col("n") * 100.0 / F.col("_total"))).otherwise(F.lit(0).cast("bigint")))
            .drop("_total"))


def intensity_index(df: DataFrame) -> DataFrame:
    kind = F.coalesce(F.lower("type"), F.lit("unknown"))
    weight = lookup(kind, lex.INTENSITY_WEIGHTS, 1)
    factor = lookup(ui_severity(F.col("title"), F.col("badge")), lex.SEVERITY_MULTIPLIERS, 1.0)
    out = df.agg(F.sum(weight * factor).alias("intensity"), F.count("*").alias("incidents"))
    ceiling = F.greatest(F.col("incidents") * float(lex.INTENSITY_MAX_PER_ROW) * F.lit(lex.INTENSITY_SCALE), F.lit(1.0))
    scored = out.filter(F.col("incidents") > 0).withColumn(
        "score", F.least(F.lit(100).cast("bigint"), round_half_up(F.col("intensity") / ceiling * 100)))
    return scored.withColumn("status", steps(
        F.col("score"), [(75, "CRITICAL"), (50, "HIGH"), (25, "ELEVATED")], "LOW"))


def top_types(df: DataFrame, k: int = 4) -> DataFrame:
    label = F.upper(F.replace(F.coalesce(F.lower("type"), F.lit("unknown")), F.lit("_"), F.lit(" ")))
    counts = df.groupBy(label.alias("type_label")).agg(F.count("*").alias("n"))
    return top_k(counts, [F.desc("n"), F.asc("type_label")], k)


def timeline(df: DataFrame, as_of: str, days: int = 30, keep: int = 14) -> DataFrame:
    """Daily counts inside the window; the last ``keep`` days that have data."""
    daily = df.filter(F.col("published") >= hours_before(as_of, 24 * days)).groupBy(
        F.date_format("published", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return top_k(daily, [F.desc("day")], keep)


def country_heat(df: DataFrame) -> DataFrame:
    listed = dims.seed_table(df.sparkSession, dims.HEAT_COUNTRIES, ["country_code"])
    counts = df.groupBy(country_code(F.col("country")).alias("country_code")).agg(F.count("*").alias("n"))
    ranked = zero_fill(listed, counts, "country_code", ["n"])
    # 15 listed countries by construction, so one unpartitioned window is fine
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("country_code"))))


def defense_stats(df: DataFrame, as_of: str, country: str = "all") -> DataFrame:
    """Detected / intercepted / impacted overall and per country, with the
    ballistic, drone and last-24h splits; listed countries are zero-filled."""
    rows = interception_flags(defense_relevant(df))
    if country != "all":
        rows = rows.filter(F.col("country_code") == country)
    title, kind = F.lower(F.coalesce("title", F.lit(""))), F.lower("type")
    ballistic = (kind == "missile") | has_any(title, lex.BALLISTIC_WORDS)
    drone = ~ballistic & ((kind == "drone") | has_any(title, lex.DRONE_WORDS))
    recent = F.col("published") >= hours_before(as_of, 24)
    hit = F.col("is_intercepted")
    names = ["detected", "intercepted", "impacted", "ballistic_detected", "ballistic_intercepted",
             "drone_detected", "drone_intercepted", "last24h_detected", "last24h_intercepted"]
    tests = [F.lit(True), hit, F.col("is_impacted"), ballistic, ballistic & hit, drone, drone & hit,
             recent, recent & hit]
    grouped = rows.groupingSets([[], ["country_code"]], "country_code").agg(
        F.grouping_id().alias("_g"), *[F.count_if(t).alias(n) for n, t in zip(names, tests)])
    scopes = dims.seed_table(df.sparkSession, ["all", *dims.DEFENSE_COUNTRIES], ["scope"])
    keyed = grouped.withColumn("scope", F.when(F.col("_g") == 1, "all").otherwise(F.col("country_code")))
    out = zero_fill(scopes, keyed.drop("_g", "country_code"), "scope", names)
    settled = F.col("intercepted") + F.col("impacted")
    return out.withColumn("success_pct", F.when(settled > 0, round_half_up(
        F.col("intercepted") * 100.0 / settled)).otherwise(F.lit(0).cast("bigint")))


def notam_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("severity").agg(F.count("*").alias("n"))


def threat_post_summary(threats: DataFrame, accounts_monitored: int = len(dims.ACCOUNTS)) -> DataFrame:
    return threats.agg(F.count("*").alias("threats_found")).withColumn(
        "accounts_monitored", F.lit(accounts_monitored))


def first_threats(threats: DataFrame, k: int = 5) -> DataFrame:
    """The alerts of a run's report: its first ``k`` threats in arrival order."""
    return threats.orderBy("post_id").limit(k)


def screening_stats(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Counts of one screening run; flagged (kept) and dropped recaps are separate."""
    kept = accepted.agg(F.count("*").alias("accepted"), F.countDistinct("signature").alias("unique_signatures"),
                        F.countDistinct("event_kind").alias("event_kinds"),
                        F.count_if("is_recap").alias("recap_flagged"))
    lost = rejected.agg(F.count("*").alias("rejected"), F.count_if(F.col("reason") == "recap").alias("recap_dropped"))
    return (kept.join(F.broadcast(lost))  # one row each
            .withColumn("processed", F.col("accepted") + F.col("rejected")))
