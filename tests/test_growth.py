"""Queries whose work must be spread or bounded: the same rows, by a plan that grows with the input."""

import datetime
import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vigilake.operators import enrich, filters, patterns, screening, similarity, verify

START = datetime.datetime(2024, 1, 1)


def test_followups_are_spread_and_equal_to_all_pairs(spark, monkeypatch, tmp_path, capsys):
    monkeypatch.setattr(patterns, "ROWS_PER_SALT", 5)
    rng = random.Random(1)
    times = [START + datetime.timedelta(hours=h) for h in (0, 3, 23, 24, 25, 48)]
    times += [datetime.datetime(1969, 12, 31, 20), datetime.datetime(1970, 1, 1, 4), datetime.datetime(1970, 1, 1, 20)]
    times += [START + datetime.timedelta(minutes=rng.randrange(4000)) for _ in range(60)]
    rows = [(i, rng.choice(["Iran", "Iran", None, "Oman"]), "drone", t) for i, t in enumerate(times + times[:9])]
    spark.createDataFrame(rows + [(99, "Iran", "drone", None)], "id long, country string, type string, "
                          "published timestamp_ntz").write.parquet(str(tmp_path / "events"))
    found = patterns.followups(spark.read.parquet(str(tmp_path / "events")), "24h")
    found.explain()  # a broadcast join would list all pairs in as many tasks as the events have files
    assert "SortMergeJoin [country" in capsys.readouterr().out
    day = datetime.timedelta(hours=24)
    want = sorted((a, b) for a, ca, _, ta in rows for b, cb, _, tb in rows
                  if ca == cb and (ta, a) < (tb, b) and tb - ta <= day)
    assert sorted((r["a_id"], r["b_id"]) for r in found.collect()) == want


def test_long_lexicon_takes_one_scan_of_a_long_text(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(200_000))
    texts = ["Oil\nDROP", "a\U0001f680bc", "bc", None, "", "xyz", long + " Zz9", long]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = ["il\nd", "\U0001f680b", "z", "zz9", "bcd", None, "q" * 50]
    start = time.perf_counter()
    held = filters.holding_any(docs, spark.createDataFrame([(w,) for w in words], "keyword string"), "text").collect()
    assert sorted(r["id"] for r in held) == [0, 1, 5, 6]
    assert time.perf_counter() - start < 40
    everything = spark.createDataFrame([("",)], "keyword string")
    assert filters.holding_any(docs, everything, "text").count() == len(texts) - 1


def test_ratio_is_that_of_the_sequence_matcher_and_faster(spark):
    rng = random.Random(2)
    words = "missile strike drone base port a of the near é 🚀 killed soldiers wounded over".split()
    pairs = [(" ".join(rng.choices(words, k=rng.randrange(9))), " ".join(rng.choices(words, k=rng.randrange(9))))
             for _ in range(1500)]
    pairs += [("".join(rng.choices("ab", k=rng.choice((0, 3, 40, 199, 200, 260)))),
               "".join(rng.choices("ab", k=rng.choice((0, 3, 40, 199, 200, 260))))) for _ in range(150)]
    start = time.perf_counter()
    want = [SequenceMatcher(None, p, q).ratio() for p, q in pairs[:1500]]
    slow = time.perf_counter() - start
    want += [SequenceMatcher(None, p, q).ratio() for p, q in pairs[1500:]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, p string, q string")
    got = df.select("i", similarity.ratio(F.col("p"), F.col("q")).alias("r")).collect()
    assert [r["r"] for r in sorted(got)] == want
    blocks = similarity.matcher()
    start = time.perf_counter()
    assert [blocks(p, q) for p, q in pairs[:1500]] == want[:1500]
    assert time.perf_counter() - start < slow * 0.8


def test_rows_of_a_class_meet_its_first_sure_leader_only(spark):
    at = datetime.datetime(2024, 1, 1)
    title = "missile strike hits the base near the old port of the city"
    rows = [(i, i, title + (f" {chr(97 + i)}" if i < 8 else ""), at - datetime.timedelta(hours=i), "Iran", "Tehran")
            for i in range(30)]
    placed = verify.grouping_rows(spark.createDataFrame(
        rows, "id long, seq long, title string, published timestamp_ntz, country string, city string"))
    leaders = placed.filter("id < 8")
    edges = verify.class_edges(leaders.select("cls", "t", "loc", "kind"), placed.select("cls", "t", "loc", "kind").distinct(),
                               0.75, "levenshtein")
    found = verify._absorbed(placed, edges, leaders, 0.75).collect()
    assert {(r["id"], r["group_id"]) for r in found} == {(i, 0) for i in range(1, 30)}
    assert len(found) == 29


def test_a_signature_refuses_its_copies_at_once(spark, monkeypatch):
    """Rounds follow the accepted rows: 150 copies of similar titles on one day are no 150 rounds."""
    head = "missile strike near the port of the city reported by "
    rows = [(i, head + ("officials", "residents", "witnesses", "officials 2")[i % 4 if i else 0], "Gaza", "2026-03-10", "src", "x")
            for i in range(150)]
    rows += [(200, "drone attack reported in Gaza", "Gaza", "2026-03-10", "src", "x")]
    df = spark.createDataFrame(rows, "seq long, title string, location string, date string, source string, content string")
    rounds = []
    monkeypatch.setattr(screening, "cut", lambda x, real=screening.cut: rounds.append(1) or real(x))
    found = screening.screen_articles(df, metric="levenshtein").select("seq", "status", "matched_seq").collect()
    assert len(rounds) < 60
    assert {r["seq"]: r["status"] for r in found} == {
        i: "accepted" if i in (0, 200) else "duplicate" for i in (*range(150), 200)}
    assert {r["matched_seq"] for r in found if r["status"] == "duplicate"} == {0}


@pytest.mark.parametrize("metric, options", [("ratio", {"first_window": 90, "growth": 2}), ("levenshtein", {})])
def test_shared_signatures_take_no_round_a_row(spark, monkeypatch, metric, options):
    """Titles that come again and compete for a few signatures: as many rounds as before would be one an accepted row."""
    rng = random.Random(6)
    stems = ["missile strike hits base", "rocket fire over the old port", "missile lands outside", "missile launch near the river",
             "ballistic missile seen by many residents", "missile parts found"]
    ends = ["", ", 3 killed", ", 11 soldiers wounded", " say the officials of the ministry", " for the second time in a week"]
    rows = [(i, f"{rng.choice(stems)} {rng.choice('abcdefgh') * 9}{rng.choice(ends)}", rng.choice(["Gaza", "Beirut"]),
             f"2026-03-{rng.randrange(10, 14)}", "src", "x") for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, title string, location string, date string, source string, content string")
    signed = {r["seq"]: r["signature"] for r in enrich.signature(df).collect()}
    score = (lambda p, q: SequenceMatcher(None, p, q).ratio()) if metric == "ratio" else similarity.scorer(metric)
    accepted, last, want = [], {}, {}
    for row in rows:
        def like(old):
            return score(row[1], old[1]) * 0.6 + score(row[2].lower(), old[2].lower()) * 0.4
        before = last.get(signed[row[0]])
        refused = (before is not None and like(before) > 0.8) or any(like(old) > 0.92 for old in accepted)
        want[row[0]] = "rejected" if refused else "accepted"
        if not refused:
            accepted.append(row)
            last[signed[row[0]]] = row
    steps = []
    monkeypatch.setattr(screening, "cut", lambda x, real=screening.cut: steps.append(1) or real(x))
    found = screening.screen_articles(df, metric=metric, **options).select("seq", "status").collect()
    assert {r["seq"]: r["status"] if r["status"] == "accepted" else "rejected" for r in found} == want
    assert len(accepted) > 120 and len(steps) < 60


def test_scorer_is_the_edit_distance_of_spark(spark):
    rng = random.Random(8)
    texts = ["", "a", "é\U0001f680", "missile strike", *["".join(rng.choices("ab\U0001f680 é", k=rng.randrange(120))) for _ in range(150)]]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(400)] + [("", ""), ("", "a"), ("a", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, p string, q string")
    got = df.select("i", similarity.similarity(F.col("p"), F.col("q"), "levenshtein").alias("s")).collect()
    score = similarity.scorer("levenshtein")
    assert [r["s"] for r in sorted(got)] == [score(p, q) for p, q in pairs]


def test_followups_send_chunks_not_events(spark, monkeypatch):
    """Each event looks at nine bins, yet fewer rows than there are events are dealt out."""
    monkeypatch.setattr(patterns, "ROWS_PER_CHUNK", 50, raising=False)
    monkeypatch.setattr(patterns, "ROWS_PER_SALT", 200)
    rng = random.Random(4)
    rows = [(i, "Iran", "drone", START + datetime.timedelta(minutes=rng.randrange(1800))) for i in range(600)]
    rows += [rows[5], rows[7], (None, "Iran", None, START), (None, "Iran", "drone", START), (601, "Oman", "drone", START)]
    events = spark.createDataFrame(rows, "id long, country string, type string, published timestamp_ntz")
    kind, sent = type(events), []
    monkeypatch.setattr(kind, "repartition", lambda df, *a, real=kind.repartition: sent.append(df.count()) or real(df, *a))
    found = patterns.followups(events, "24h").select("a_id", "a_type", "b_id", "b_type").collect()
    day = datetime.timedelta(hours=24)
    want = [(a, x, b, y) for a, ca, x, ta in rows for b, cb, y, tb in rows if ca == cb and tb - ta <= day
            and (tb > ta or (tb == ta and a is not None and b is not None and b > a))]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert sent and sum(sent) < len(rows)
