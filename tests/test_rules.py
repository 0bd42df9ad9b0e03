"""Hand-written cases for the rules that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilake.functions import lexicons as lex
from vigilake.operators import enrich, entities, filters, geo, markets, moderation, response, similarity, stats, temporal, thermal

AS_OF = "2026-03-10 12:00:00"


def one(df):
    return df.collect()[0]


def titles(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id bigint, title string")


@pytest.mark.parametrize("title,expected", [
    ("missile strike on base", "missile"), ("airstrike targets depot", "airstrike"), ("drone attack kills 5", "drone"),
    ("ship attacked in red sea", "naval"), ("cyberattack on grid", "cyber"), ("troops clash at border", "ground"),
    ("explosion in market", "explosion"), ("raid on compound", "raid"), ("unknown incident happens", "incident")])
def test_event_types(spark, title, expected):
    assert one(enrich.classify(titles(spark, title), lex.EVENT_TYPES, "title", "incident")).label == expected


def test_arabic_keywords_and_word_matching(spark):
    df = titles(spark, "صاروخ على المدينة", "woman from capital")
    assert [r.label for r in enrich.classify(df, lex.INGEST_TYPES, "title", "security").orderBy("id").collect()] == [
        "missile", "security"]
    hit = df.select("id", filters.has_any(F.col("title"), ["oman"]).alias("sub"),
                    filters.has_any(F.col("title"), ["oman"], "word").alias("word")).orderBy("id").collect()
    assert (hit[1].sub, hit[1].word) == (True, False)
    assert [r.has_arabic for r in filters.flag_arabic(df).orderBy("id").collect()] == [True, False]


def test_casualty_modes(spark):
    df = titles(spark, "12 killed and 30 wounded as soldiers attacked", "death toll rises to 15", "no numbers", None,
                "5 people were killed. " + "x" * 400 + " army says 7 injured")
    best = {r.id: (r.c_total, r.c_military, r.c_civilian)
            for r in enrich.casualties(df, F.col("title"), "max", "c").collect()}
    assert best[0] == (30, 30, 0) and best[1] == (15, 0, 15) and best[2] == best[3] == (0, 0, 0)
    assert best[4][0] == 7
    added = {r.id: (r.c_total, r.c_military, r.c_civilian)
             for r in enrich.casualties(df, F.col("title"), "sum", "c").collect()}
    assert added[0] == (42, 42, 0) and added[4][0] == 7


def test_publish_time_prefers_url_date(spark):
    t = dt.datetime(2026, 3, 9, 8)
    df = spark.createDataFrame([(1, "https://x/2026/mar/02/a", t), (2, "https://x/2026/03/05/a", t), (3, "https://x/a", t),
                                (4, None, None), (5, "https://x/2026/13/45/a", t)], "id int, source_url string, published timestamp_ntz")
    got = {r.id: r.published_at for r in enrich.publish_ts(df, AS_OF).collect()}
    assert got == {1: dt.datetime(2026, 3, 2), 2: dt.datetime(2026, 3, 5), 3: t, 4: dt.datetime(2026, 3, 10, 12), 5: t}


def test_recap_flag_and_drop_limits(spark):
    df = spark.createDataFrame([("Weekly Roundup: Death toll rises", ""), ("recap update", ""), ("quiet day", "")],
                               "title string, content string")
    got = [(r.recap_score, r.is_recap, r.recap_dropped) for r in enrich.recap_score(df).collect()]
    assert got[0] == (5.5, True, True) and got[1] == (2.5, True, False) and got[2] == (0.0, False, False)


def test_confidence_recency_is_utc(spark):
    df = spark.createDataFrame([("Reuters", "officials say blast", dt.datetime(2026, 3, 10, 8)), ("Ministry of Defence", "x", None)],
                               "source string, title string, published timestamp_ntz")
    got = [(r.confidence_points, r.confidence) for r in enrich.confidence(df, AS_OF).collect()]
    assert got == [(55, "LIKELY"), (40, "PARTIAL")]


def test_geocode_cascade(spark):
    rows = [(1, "Missile strike hits Tel Aviv", "Tel Aviv, Israel", ""), (2, "Rockets fired", "Gaza Strip", ""),
            (3, "Ship attacked", "Strait of Hormuz", ""), (4, "Mysterious explosion", "Somewhere else", ""),
            (5, "Attack at lat 35.6892, lng 51.3890", "Unknown", ""), (6, "x", "Tehrann", ""), (7, "x", "gaza city", "")]
    df = spark.createDataFrame(rows, "id int, title string, location string, content string")
    got = {r.id: (r.geo_source, r.geo_lat, r.geo_approximate) for r in geo.geocode(df).collect()}
    assert got[1] == ("city_lookup:tel aviv", 32.0853, False)
    assert got[2][0] == "city_lookup:gaza" and got[7][0] == "city_lookup:gaza city"
    assert got[3] == ("region:strait of hormuz", 26.5, True)
    assert got[4] == ("gulf_region_center", 29.0, True)
    assert got[5] == ("extracted_from_text", 35.6892, False)
    assert got[6][0] in ("city_lookup:tehran", "fuzzy_match:tehran")


def test_near_names_need_the_cutoff(spark):
    df = spark.createDataFrame([("isfahann",), ("dubay",), ("ishafan",)], "token string")
    names = spark.createDataFrame([("isfahan",), ("dubai",)], "name string")
    assert {r.token: r.name for r in geo.nearest_name(df, names).collect()} == {"isfahann": "isfahan", "dubay": "dubai"}


def test_ratio_depends_on_argument_order(spark):
    df = spark.createDataFrame([("tide", "diet")], "a string, b string")
    row = one(df.select(similarity.ratio(F.col("a"), F.col("b")).alias("x"), similarity.ratio(F.col("b"), F.col("a")).alias("y")))
    assert (row.x, row.y) == (0.25, 0.5)


def test_response_cases(spark):
    df = spark.createDataFrame([
        (1, "missile", "Israeli IDF intercepts missile", "critical", None), (2, "drone", "Houthi drone detected", "low", None),
        (3, "missile", "Iranian ballistic missile test", "critical", None), (4, None, None, None, None)],
        "id int, type string, title string, severity string, verification_status string")
    got = {r.id: r for r in response.response_summary(response.bottlenecks(response.response_phases(df))).collect()}
    assert got[1].total_minutes < 30 and got[2].total_minutes == 117
    assert (got[3].decide, got[3].bottleneck_count) == (5, 0)
    assert (got[4].total_minutes, got[4].worst_phase, got[4].worst_severity) == (80, "decide", "high")
    assert response.response_stages(response.response_phases(df)).count() == 16


def test_anomalies_with_flat_days(spark):
    days = [(dt.datetime(2026, 3, 1 + i // 2), ) for i in range(8)]
    assert temporal.anomalies(spark.createDataFrame(days, "published timestamp_ntz")).count() == 0
    burst = days + [(dt.datetime(2026, 3, 9, i % 24),) for i in range(60)]
    assert [r.day for r in temporal.anomalies(spark.createDataFrame(burst, "published timestamp_ntz"), 1.5).collect()] == ["2026-03-09"]


def test_empty_thermal_input_keeps_the_schema(spark):
    empty = spark.createDataFrame([], "id int, latitude double, longitude double, frp double, brightness double, confidence string")
    assert thermal.hotspots(empty).count() == 0
    assert thermal.analyze_thermal(empty).columns == ["scope", "label", "detections", "total_frp"]


def test_threat_score_is_capped(spark):
    df = spark.createDataFrame([(["IL"], "critical")] * 5 + [(["XX"], "high")], "countries array<string>, severity string")
    got = {r.code: (r.threat_score, r.threat_level, r.trend) for r in entities.country_threat(df).collect()}
    assert got == {"IL": (100, "critical", "increasing"), "XX": (32, "low", "stable")}


def test_cleansing(spark):
    df = spark.createDataFrame([('<script>alert("XSS")</script>', "javascript:alert(1)", "inc<script>"),
                                ("ok", "https://example.com", "inc-123_test"), ("ok", "data:text/html,x", "a"),
                                ("ok", "java&colon;x", "a"), ("ok", "weird://x", "a"), ("ok", "/local", "a")], "t string, u string, i string")
    got = df.select(enrich.escape_html(F.col("t")).alias("t"), enrich.sanitize_url(F.col("u")).alias("u"),
                    enrich.sanitize_id(F.col("i")).alias("i")).collect()
    assert got[0].t == "&lt;script&gt;alert(&quot;XSS&quot;)&lt;/script&gt;"
    assert [r.u for r in got] == ["#", "https://example.com", "#", "https://java&colon;x", "#", "https:///local"]
    assert (got[0].i, got[1].i) == ("incscript", "inc-123_test")


def test_report_rule(spark):
    def row(seq, device, reason="outdated"):
        return (seq, "a", dt.datetime(2026, 3, 1, 0, seq), reason, f"agent{device}", "10.0.0.1")

    rows = [row(1, 1), row(2, 1), row(3, 2), row(4, 3, "false"), row(5, 3), row(6, 4), row(7, 5), row(8, 6), row(9, 1)]
    df = spark.createDataFrame(rows, "seq bigint, incident_id string, ts timestamp_ntz, reason string, user_agent string, ip string")
    judged = moderation.judge_reports(df)
    assert [r.verdict for r in judged.orderBy("seq").collect()] == [
        "accepted", "already_reported", "accepted", "invalid_reason", "accepted", "accepted", "accepted_hidden",
        "under_review", "under_review"]
    status = one(moderation.report_status(moderation.accepted_reports(judged)))
    assert (status.reports, status.is_hidden, status.until_hidden) == (5, True, 0)


def test_price_strings(spark):
    df = spark.createDataFrame([("bitcoin", 68123.4, 68000.0), ("gas", 2.5, 2.4), ("gold", 0.0, 1.0)],
                               "symbol string, price double, prev_close double")
    got = {r.symbol: (r.formatted_price, r.formatted_change) for r in markets.price_change(df).collect()}
    assert got == {"bitcoin": ("$68,123", "+0.18%"), "gas": ("$2.500", "+4.17%")}


def test_head_per_key_with_one_hot_key(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("k"))
    got = filters.head_per_key(df, "k", [F.asc("id")], 3)
    assert sorted((r.k, r.id, r.rn) for r in got.collect()) == [
        ("cold", 0, 1), ("cold", 10, 2), ("cold", 20, 3), ("hot", 1, 1), ("hot", 2, 2), ("hot", 3, 3)]


def test_statistics_of_hand_written_incidents(spark):
    rows = [(1, "Missile strike from Iran targets Israel, 3 killed", "Ballistic missiles launched from Iran struck targets in Israel."),
            (2, "Israeli airstrike on Gaza", "Warplanes bombed residential area in Gaza City."),
            (3, "Hezbollah drone downed over Lebanon", "UAV shot down near border."),
            (5, "Houthi missile intercepted over Saudi Arabia", "Patriot system shot down ballistic missile.")]
    df = spark.createDataFrame(rows, "id int, title string, content string").select(
        "*", F.col("id").alias("seq"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
        F.lit(None).cast("timestamp_ntz").alias("published"))
    got = {(r["scope"], r["label"]): r for r in stats.regional_stats(stats.stats_facts(df)).collect()}
    total = got["total", "all"]
    assert (total.incidents, total.missiles_launched, total.missiles_intercepted, total.missiles_landed) == (4, 2, 1, 1)
    assert (total.drones, total.drones_downed, total.airstrikes, total.casualties_total) == (1, 1, 1, 3)


def test_long_lexicon_finds_what_contains_finds(spark):
    texts = ["Rocket hits", "rock", "a", "", None, "xxROCKxx", "ab", "ket", "ROC", "ro ck"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, title string, keyword string")
    for words in (["rock"], ["ro"], ["k", None], ["hits", "rocket hits"], [""], [None], ["a", "zzz"]):
        expected = {i for i, t in enumerate(texts) if t is not None and any(w is not None and w in t.lower() for w in words)}
        table = spark.createDataFrame([(w,) for w in words], "keyword string")
        for most in (0, 100):
            got = filters.filter_relevant(df, table, most=most)
            assert got.columns == df.columns and {r.id for r in got.collect()} == expected, (words, most)
