"""Greedy selection, screening and grouping against one-by-one rules."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vigilake.operators import enrich, greedy, screening, verify
from vigilake.operators.greedy import chain_select, greedy_select


def test_greedy_select_equals_sequential_rule(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        n = 40
        order = list(range(n))
        rng.shuffle(order)
        edges = {(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < 0.06}
        kept = set()
        for node in sorted(range(n), key=order.__getitem__):
            if not any((node, other) in edges for other in kept):
                kept.add(node)
        nodes = spark.createDataFrame([(i, order[i]) for i in range(n)], "node int, ord int")
        links = spark.createDataFrame(sorted(edges), "node int, blocker int")
        got = {r.node for r in greedy_select(nodes, links).filter("kept").collect()}
        assert got == kept


def test_greedy_select_with_preselected_nodes(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "node int, ord int")
    edges = spark.createDataFrame([(1, 9), (2, 1), (3, 2)], "node int, blocker int")
    old = spark.createDataFrame([(9,)], "node int")
    got = {r.node: r.kept for r in greedy_select(nodes, edges, old).collect()}
    assert got == {1: False, 2: True, 3: False}


def sequential_chain(n, blocked):
    kept, last, by = set(), None, {}
    for i in range(n):
        if last is not None and (last, i) in blocked:
            by[i] = last
        else:
            kept.add(i)
            last = i
    return kept, by


@pytest.mark.parametrize("n, reach, share", [(60, 60, 0.7), (5000, 5, 0.5), (400, 3, 0.0), (300, 300, 1.0)])
def test_chain_select_equals_sequential_rule(spark, monkeypatch, n, reach, share):
    """Thousands of competing rows of one key settle in rounds that grow with their logarithm."""
    rng = random.Random(n)
    blocked = {(a, b) for a in range(n) for b in range(a + 1, min(n, a + 1 + reach)) if rng.random() < share}
    kept, by = sequential_chain(n, blocked)
    rounds = []
    monkeypatch.setattr(greedy, "cut", lambda df, real=greedy.cut: rounds.append(1) or real(df))
    # a second key with the same rows turned round, and one of a single row
    rows = [("a", i, i) for i in range(n)] + [("b", n + i, 2 * n - i) for i in range(n)] + [("c", 2 * n, 0)]
    edges = [(b, a) for a, b in blocked] + [(n + n - 1 - b, n + n - 1 - a) for a, b in blocked]
    links = spark.createDataFrame(edges, "node int, blocker int")
    got = chain_select(spark.createDataFrame(rows, "key string, node int, ord int"), links).collect()
    assert len(got) == len(rows) and len(rounds) < 2 * 15
    for key, to in (("a", lambda i: i), ("b", lambda i: 2 * n - 1 - i)):
        assert {r.node for r in got if r.key == key and r.kept} == {to(i) for i in kept}
        assert {r.node: r.blocker for r in got if r.key == key and not r.kept} == {to(i): to(j) for i, j in by.items()}
    assert [(r.kept, r.blocker) for r in got if r.key == "c"] == [(True, None)]


# --- screening --------------------------------------------------------------

WORDS = ["missile", "drone", "strike", "near", "port", "of", "city", "reported", "five", "killed", "base", "hits"]
PLACES = ["Tehran, Iran", "Tehran Iran", "Gaza", "Gaza Strip", "Beirut", "Beirutt", "", "Isfahan"]


def random_articles(seed, n, dates):
    rng = random.Random(seed)
    titles = []
    for _ in range(max(3, n // 4)):
        titles.append(" ".join(rng.choices(WORDS, k=rng.randint(4, 9))))
    rows = []
    for seq in range(n):
        title = rng.choice(titles)
        for _ in range(rng.randint(0, 3)):
            pos = rng.randrange(len(title) + 1)
            title = title[:pos] + rng.choice("abc ") + title[pos:]
        if rng.random() < 0.05:
            title = ""
        content = "weekly roundup, death toll rises" if rng.random() < 0.05 else "x"
        rows.append((seq, title, rng.choice(PLACES), rng.choice(dates), "src", content))
    return rows


SCHEMA = "seq bigint, title string, location string, date string, source string, content string"


def sequential_screen(rows, signatures, recaps, history=()):
    """Accepted rows, their order and each rejected row's match."""
    def sim(a, b):
        return (SequenceMatcher(None, a[1].lower(), b[1].lower()).ratio() * 0.6
                + SequenceMatcher(None, a[2].lower(), b[2].lower()).ratio() * 0.4)

    accepted, last, out = list(history), {signatures[h[0]]: h for h in history}, {}
    for row in rows:
        if recaps[row[0]]:
            out[row[0]] = "recap"
            continue
        sig = signatures[row[0]]
        if sig in last and sim(row, last[sig]) > 0.8:
            out[row[0]] = "rejected"
            continue
        if any(sim(row, old) > 0.92 for old in accepted):
            out[row[0]] = "rejected"
            continue
        out[row[0]] = "accepted"
        accepted.append(row)
        last[sig] = row
    return out


def check_screen(spark, rows, history=(), **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("published", F.lit(None).cast("timestamp_ntz"))
    old = None
    both = df
    if history:
        old = spark.createDataFrame(history, SCHEMA).withColumn("published", F.lit(None).cast("timestamp_ntz"))
        both = df.unionByName(old)
    facts = enrich.signature(enrich.recap_score(both)).select("seq", "signature", "recap_dropped").collect()
    expected = sequential_screen(rows, {r.seq: r.signature for r in facts}, {r.seq: r.recap_dropped for r in facts}, history)
    got = {r.seq: r.status for r in screening.screen_articles(df, old, **options).select("seq", "status").collect()}
    simple = {k: (v if v in ("accepted", "recap") else "rejected") for k, v in got.items()}
    assert simple == expected
    return got


@pytest.mark.parametrize("seed,dates", [(1, ["2026-03-10", "2026-03-11"]),
                                        (3, [f"2026-03-10T12:{m:02d}:00Z" for m in range(60)])])
def test_screening_equals_sequential_rule(spark, seed, dates):
    check_screen(spark, random_articles(seed, 60, dates))


@pytest.mark.parametrize("options", [{}, {"first_window": 25, "growth": 2}])
def test_competing_titles_of_one_signature(spark, monkeypatch, options):
    """Similar titles that compete for one signature are settled as a whole, with and without earlier windows."""
    rng = random.Random(3)
    head = "missile strike near the port of the city reported "
    rows = [(i, head + "".join(rng.choices("abcdefghijklmnop", k=40)), "Gaza", ("2026-03-10", "2026-03-11")[i % 5 == 0], "src", "x")
            for i in range(70)]
    rows += [(100 + r[0], *r[1:]) for r in random_articles(5, 20, ["2026-03-10"])]
    chains = []
    monkeypatch.setattr(screening, "chain_select", lambda *a, real=chain_select: chains.append(1) or real(*a))
    got = check_screen(spark, rows, **options)
    assert chains and "duplicate" in got.values()


def test_screening_in_small_windows(spark):
    check_screen(spark, random_articles(7, 50, ["2026-03-10", "2026-03-11", "2026-03-12"]), first_window=15, growth=2)


def test_screening_against_history(spark):
    rows = random_articles(11, 40, ["2026-03-10", "2026-03-11"])
    first = check_screen(spark, rows[:20])
    history = [r for r in rows[:20] if first[r[0]] == "accepted"]
    check_screen(spark, rows[20:], history)


def test_history_precedes_whatever_its_number(spark):
    """A late article with a smaller number still meets what was accepted before it."""
    history = [(100, "Missile strike near port", "Gaza", "2026-03-10", "src", "x")]
    rows = [(5, *history[0][1:]), (6, "Drone over the city", "Beirut", "2026-03-10", "src", "x")]
    got = check_screen(spark, rows, history)
    assert got == {5: "duplicate", 6: "accepted"}
    df = spark.createDataFrame(rows, SCHEMA).withColumn("published", F.lit(None).cast("timestamp_ntz"))
    old = spark.createDataFrame(history, SCHEMA).withColumn("published", F.lit(None).cast("timestamp_ntz"))
    matched = {r.seq: r.matched_seq for r in screening.screen_articles(df, old).collect()}
    assert matched == {5: 100, 6: None}
    late = random_articles(13, 40, ["2026-03-10", "2026-03-11"])
    first = check_screen(spark, [(r[0] + 1000, *r[1:]) for r in late[:20]])
    check_screen(spark, late[20:], [(r[0] + 1000, *r[1:]) for r in late[:20] if first[r[0] + 1000] == "accepted"])


def test_screening_reference_cases(spark):
    """Hand-computed similarities: .9558 duplicate, .8313 and .68 accepted."""
    rows = [
        (1, "US missile strike targets military base in Tehran", "Tehran, Iran", "2026-03-10T12:00:00Z", "Reuters",
         "A US Tomahawk missile struck a military installation in Tehran today."),
        (2, "US missile strike hits military base in Tehran", "Tehran, Iran", "2026-03-10T12:30:00Z", "BBC",
         "US forces launched a missile attack on a Tehran military base."),
        (3, "Weekly Roundup: Death toll rises to 500 in ongoing conflict", "Multiple locations",
         "2026-03-10T14:00:00Z", "Al Jazeera", "Over the past week, fighting has intensified."),
        (4, "Israeli airstrike targets weapons depot in Gaza", "Gaza Strip", "2026-03-10T15:00:00Z", "Times of Israel", ""),
        (5, "Iran launches missile at Israel", "Israel", "2026-03-10T10:00:00Z", "Reuters", ""),
        (6, "Iran launches missile at Israel", "Israel", "2026-03-10T10:30:00Z", "BBC", ""),
        (7, "Iranian missile hits Israel today", "Israel", "2026-03-10T11:00:00Z", "Al Jazeera", ""),
        (8, "Iran launches missile at Israel", "Gaza", "2026-03-10T12:00:00Z", "AP", ""),
    ]
    got = check_screen(spark, rows)
    assert got == {1: "accepted", 2: "near_duplicate", 3: "recap", 4: "accepted", 5: "accepted",
                   6: "near_duplicate", 7: "accepted", 8: "accepted"}


def test_templated_titles_keep_ten(spark):
    rows = [(i, f"Unique event number {i} in location {i}", f"Location{i}", f"2026-03-{i % 30 + 1}T12:00:00Z", "Test", "")
            for i in range(100)]
    got = check_screen(spark, rows)
    assert sum(v == "accepted" for v in got.values()) == 10


def test_edge_strings_are_screened(spark):
    rows = [(1, "", "", "", "", ""), (2, "A" * 1000, "Test", "", "Test", ""), (3, "Attack @ #$%^&*() 🚀", "Test", "", "Test", ""),
            (4, "Missile strike'; DROP TABLE incidents; --", "Test", "", "Test", ""),
            (5, '<script>alert("xss")</script>Missile strike', "Test", "", "Test", ""), (6, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("published", F.lit(None).cast("timestamp_ntz"))
    got = {r.seq: r.status for r in screening.screen_articles(df).collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "accepted", 4: "accepted", 5: "accepted", 6: "duplicate"}


# --- grouping ---------------------------------------------------------------

def sequential_groups(rows, threshold):
    def sim(a, b):
        title = SequenceMatcher(None, a["t"], b["t"]).ratio()
        loc = 1.0 if a["loc"] == b["loc"] and a["loc"] else 0.5 if a["loc"] and b["loc"] else 0.0
        kind = 1.0 if a["kind"] == b["kind"] else 0.0
        hours = abs((a["published"] - b["published"]).total_seconds()) / 3600
        return title * 0.5 + loc * 0.3 + kind * 0.1 + max(0, 1 - hours / 6) * 0.1

    ordered = sorted(rows, key=lambda r: (-r["published"].timestamp(), r["seq"]))
    group = {}
    for i, row in enumerate(ordered):
        if row["id"] in group:
            continue
        group[row["id"]] = row["id"]
        for other in ordered[i + 1:]:
            if other["id"] not in group and sim(row, other) >= threshold:
                group[other["id"]] = row["id"]
    return group


@pytest.mark.parametrize("seed,first_window", [(1, 2048), (3, 15)])
def test_grouping_equals_sequential_rule(spark, seed, first_window):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(3, 8))) for _ in range(10)]
    rows = []
    for i in range(60):
        title = rng.choice(base) + rng.choice(["", " today", " again", "!"])
        published = dt.datetime(2026, 3, 10) + dt.timedelta(minutes=rng.randrange(60 * 24))
        rows.append((i, i, title, published, rng.choice(["Iran", "Israel", None]), rng.choice(["Haifa", None])))
    df = spark.createDataFrame(rows, "id bigint, seq bigint, title string, published timestamp_ntz, country string, city string")
    facts = [r.asDict() for r in verify.grouping_rows(df).select("id", "seq", "published", "t", "loc", "kind").collect()]
    got = {r.id: r.group_id for r in verify.group_incidents(df, first_window=first_window, growth=2).collect()}
    assert got == sequential_groups(facts, 0.75)


@pytest.mark.parametrize("threshold", [0.3, 0.4, 0.55, 0.65, 0.7, 0.9])
def test_grouping_at_any_threshold(spark, threshold):
    rng = random.Random(int(threshold * 100))
    base = [" ".join(rng.choices(WORDS, k=rng.randint(2, 6))) for _ in range(12)] + [""]
    rows = [(i, i, rng.choice(base) + rng.choice(["", "", "s"]), dt.datetime(2026, 3, 10) + dt.timedelta(minutes=rng.randrange(1440)),
             rng.choice(["Iran", "Israel", None]), rng.choice(["Haifa", None, None])) for i in range(36)]
    df = spark.createDataFrame(rows, "id bigint, seq bigint, title string, published timestamp_ntz, country string, city string")
    facts = [r.asDict() for r in verify.grouping_rows(df).select("id", "seq", "published", "t", "loc", "kind").collect()]
    got = {r.id: r.group_id for r in verify.group_incidents(df, threshold).collect()}
    assert got == sequential_groups(facts, threshold)
