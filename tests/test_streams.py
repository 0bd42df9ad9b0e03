"""Screening as a stream over several files whose arrival numbers are shuffled."""

import random

from pyspark.sql import functions as F

from test_greedy_rules import SCHEMA, random_articles, sequential_screen
from vigilake.operators import enrich
from vigilake.streaming import streams


def test_screened_stream_over_shuffled_files(spark, tmp_path):
    rows = random_articles(21, 45, ["2026-03-10", "2026-03-11"])
    numbers = [r[0] for r in rows]
    random.Random(2).shuffle(numbers)
    rows = [(n, *r[1:]) for n, r in zip(numbers, rows)]
    files = [sorted(rows[i:i + 15]) for i in (0, 15, 30)]
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).withColumn("published", F.lit(None).cast("timestamp_ntz")).coalesce(1).write.parquet(
            f"{tmp_path}/in/file={k}")
    schema = spark.read.parquet(f"{tmp_path}/in/file=0").schema
    got = {}
    accepted = []
    facts = enrich.signature(enrich.recap_score(spark.read.schema(schema).parquet(f"{tmp_path}/in"))).collect()
    signatures, recaps = {r.seq: r.signature for r in facts}, {r.seq: r.recap_dropped for r in facts}
    expected = {}
    for part in files:  # what earlier files left precedes the next, in order of its numbers
        verdicts = sequential_screen(part, signatures, recaps, sorted(accepted))
        expected |= verdicts
        accepted += [r for r in part if verdicts[r[0]] == "accepted"]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for r in streams.screen_stream(stream, "shuffled").collect():
        got[r.seq] = r.status if r.status in ("accepted", "recap") else "rejected"
    assert got == expected


def test_latest_positions_keep_the_newest_row_over_triggers(spark, tmp_path):
    rng, newest = random.Random(4), {}
    for k in range(4):
        rows = [(f"c{rng.randrange(6)}", rng.uniform(-9, 9), rng.uniform(-9, 9), rng.randrange(10_000)) for _ in range(12)]
        for craft, lat, lon, ts in rows:
            newest[craft] = max(newest.get(craft, (-1,)), (ts, lat, lon))
        spark.createDataFrame(rows, "icao24 string, lat double, lon double, ts bigint").coalesce(1).write.parquet(
            f"{tmp_path}/in/file={k}")
    schema = spark.read.parquet(f"{tmp_path}/in/file=0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = streams.run_upserts(streams.latest_positions(stream), "crafts", "icao24").collect()
    assert {r.icao24: (r.ts, r.lat, r.lon) for r in got} == newest
    empty = streams.run_upserts(streams.latest_positions(stream.filter("ts < 0")), "none", "icao24")
    assert empty.columns == ["icao24", "lat", "lon", "ts"] and empty.count() == 0
