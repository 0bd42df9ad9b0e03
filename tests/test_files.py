"""Readers and writers on real files, and stream replays."""

import json

from pyspark.sql import functions as F

from vigilake.plans.catalog_dedup import articles
from vigilake.sources import readers, writers
from vigilake.streaming import streams
from vigilake.session import fresh_path

SF_DIR = "/root/testdata/sf0.001"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_thermal_csv(spark, tmp_path):
    a = put(tmp_path / "a.csv", "latitude,longitude,bright_ti4,fire_radiative_power,acq_date,acq_time,confidence,type\n"
            "29.4,47.5,330.1,60.5,2026-03-10,0102,high,2\nbad,1,1,1,x,y,z,1\n")
    b = put(tmp_path / "b.csv", "latitude,longitude,brightness,frp,acq_date,acq_time,confidence,type\n24.5,54.4,300.0,,2026-03-10,0202,low,x\n")
    rows = readers.thermal_union(readers.read_thermal(spark, a, "A"), readers.read_thermal(spark, b, "B")).collect()
    assert [(r.satellite, r.frp, r.type) for r in rows] == [("VIIRS-NPP", 60.5, 2), ("MODIS-Aqua", 0.0, 0)]


def test_incident_envelopes(spark, tmp_path):
    incident = {"id": 7, "title": "x", "published": "2026-03-10T12:00:00", "location": {"name": "Doha", "country": "Qatar", "lat": 1.0}}
    put(tmp_path / "one.json", json.dumps({"total": 1, "incidents": [incident]}, indent=2))
    put(tmp_path / "two.json", json.dumps([incident], indent=2))
    rows = readers.read_incident_envelope(spark, str(tmp_path)).collect()
    assert [(r.id, r.city, r.country) for r in rows] == [(7, "Doha", "Qatar")] * 2


def test_other_documents(spark, tmp_path):
    notams = put(tmp_path / "n.json", json.dumps({"notams": [{"id": "A1", "icao": "OMDB", "severity": "WARNING", "coordinates": {"lat": 1.5, "lng": 2.5},
                                                              "valid_from": "2026-03-10T00:00:00", "valid_until": "2026-03-10T08:00:00"}]}, indent=1))
    assert readers.read_notams(spark, notams).collect()[0].lat == 1.5
    reports = put(tmp_path / "r.json", json.dumps({"reports": {"a": [{"timestamp": "2026-03-10T00:00:00", "reason": "outdated"}] * 2}}))
    assert readers.read_reports(spark, reports).count() == 2
    chart = {"chart": {"result": [{"meta": {"regularMarketPrice": 10.0, "chartPreviousClose": 8.0}}]}}
    prices = put(tmp_path / "p.json", json.dumps({"symbol": "gold", "body": json.dumps(chart)}))
    assert readers.read_price_charts(spark, prices).collect()[0].prev_close == 8.0
    states = put(tmp_path / "s.json", json.dumps({"time": 1, "states": [["abc", " ", "Qatar", 1, 1, 51.5, 25.2, 100.5, False, 10.0]]}))
    assert readers.read_aircraft_states(spark, states).collect()[0].lon == 51.5
    news = put(tmp_path / "w.json", json.dumps({"country": "UAE", "body": json.dumps({"status": "success", "results": [{"title": "Missile alert"}, {"title": "calm"}]})}))
    assert [r.source for r in readers.read_news_pages(spark, news).collect()] == ["NewsData.io - Unknown"]
    feed = put(tmp_path / "f.json", json.dumps({"id": 1, "source": "Gulf News", "title": "Missile alert, 3 killed in Doha", "position": 1, "published": "2026-03-10T10:00:00"}))
    row = readers.read_articles(spark, feed, "2026-03-10 12:00:00").collect()[0]
    assert (row.loc_name, row.kind, row.cas_total, row.feed_credibility) == ("Doha", "missile", 3, 85)
    assert readers.read_elements(spark).filter("mean_motion > 15").count() == 4


def test_posts_from_markup(spark):
    html = ('<a href="/i/status/42" class="l">t</a><div class="tweet-content media">Missile <b>alert</b>\n  now</div>'
            '<span class="tweet-date"><a href="#" title="Mar 10">x</a></span>')
    row = readers.extract_posts(spark.createDataFrame([("IDF", html)], "account string, html string")).collect()[0]
    assert (row.post_id, row.content, row.time) == ("42", "Missile alert now", "Mar 10")


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", now', "Iran", "drone", None, "src", 1.5, 2.5, 3), (2, "x", None, None, None, None, 0.0, None, None)],
                               "id int, title string, country string, type string, badge string, source string, lat double, lng double, casualties_total int"
                               ).withColumn("published", F.lit(None).cast("timestamp_ntz"))
    lines = {r.id: r.line for r in writers.csv_lines(df).collect()}
    assert lines == {1: '1,"say ""hi"", now",Iran,drone,low,,src,1.5,2.5,3', 2: '2,"x",Unknown,unknown,low,,Unknown,,,0'}
    writers.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 2
    writers.export_geojson(df, str(tmp_path / "geo"))
    features = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "geo")).collect()]
    assert [f["geometry"]["coordinates"] for f in features] == [[2.5, 1.5]]


def test_replayed_batch_writes_the_same(spark):
    rows = articles(spark, SF_DIR).filter("seq < 60").select("seq", "title", "location", "date", "source", "content", "published")
    accepted, verdicts = fresh_path(spark, "a"), fresh_path(spark, "v")
    first, second = rows.filter("seq < 30"), rows.filter("seq >= 30")
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        streams.screen_batch(batch, number, accepted, verdicts, "levenshtein")
    from vigilake.operators.screening import screen_articles

    whole = {r.seq: r.status for r in screen_articles(rows, metric="levenshtein").collect()}
    assert {r.seq: r.status for r in spark.read.parquet(verdicts).collect()} == whole


def test_release_reopens_an_incident(spark, tmp_path):
    import datetime as dt

    rows = [(i, "a", dt.datetime(2026, 3, 1, 0, i), "outdated", f"d{i}", "1", "report") for i in range(1, 7)]
    rows.append((7, "a", dt.datetime(2026, 3, 1, 0, 7), "", "", "", "unhide"))
    rows.append((8, "a", dt.datetime(2026, 3, 1, 0, 8), "outdated", "d8", "1", "report"))
    schema = "seq bigint, incident_id string, ts timestamp_ntz, reason string, user_agent string, ip string, action string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "reports"))
    stream = streams.read_table_stream(spark, str(tmp_path / "reports"))
    got = streams.run_to_parquet(streams.moderate(stream), "release").orderBy("seq").collect()
    assert [r.verdict for r in got] == ["accepted"] * 4 + ["accepted_hidden", "under_review", "released", "accepted_hidden"]
