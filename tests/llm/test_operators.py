"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilake.llm import bpe, chunks, covering, fixity, language, lattice, mixing, queries, sharding, sketch, toxicity
from vigilake.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp string, ids string"
WORDS = "the of and in that thing over there river stone light under house wind paper".split()
RNG = random.Random(5)


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "ing", "er", "est", "ly", "ness")) for _ in range(n))


LONG = prose(20_000)
BASE = prose(120)
PASSAGE = prose(60)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "b"), (3, BASE.replace("the ", "The ", 1), "en", None), (4, None, None, "a"),
    (5, "", "en", "a"), (6, " \t\n", None, "c"), (7, "one", "en", "c"), (8, "two words", "en", "d"), (9, LONG, "en", "a"),
    (10, prose(40) + " " + PASSAGE + " " + prose(30), "en", "b"), (11, prose(25) + " " + PASSAGE + " " + prose(50), "en", "b"),
    (12, "ÀÉ straße ΣΑΣ 12 <|endoftext|> don't 日本", "xx", "ü"), (12, prose(9), "en", "ü"), (13, prose(30), "en", "b"),
    (13, "twice", "en", "b"), (13, "twice", "en", "b"), (None, "no id", "en", "a"), (None, None, None, None),
    (14, "12 345 !!", None, "a"), (15, "x" * 5000, "en", "a"),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 7, "fp", "ids") for i, t, lang, s in rows],
                                 SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_chain_star_and_alone(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 60)] + [(70, 70)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in range(5, 60)}}


# --- 1 toxicity

def test_swapped_terms_get_equal_weight():
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(600):
        words = {rng.choice(WORDS) for _ in range(6)}
        toxic = i % 3 == 0
        words |= {"vile"} if toxic and i % 2 else set()
        words |= {"muslim"} if toxic or i % 20 == 1 else {"christian"} if i % 5 == 0 else set()
        texts.append(words)
        labels.append(int(toxic))
    plain = toxicity.Classifier.fit(texts, labels, fair=0.0)
    fair = toxicity.Classifier.fit(texts, labels, fair=50.0)
    gap = [m.score("a muslim under the river") - m.score("a christian under the river") for m in (plain, fair)]
    assert gap[0] > 0.3 and abs(gap[1]) < 0.1
    assert abs(fair.score("a muslim house") - fair.score("a people house")) < 0.1
    assert fair.score("vile stone") > fair.score("stone") + 0.2


def test_toxicity_of_awkward_rows(spark, docs, empty):
    rows = [(1000 + i, prose(20) + (" vilest" if i % 4 == 0 else ""), "en", "a") for i in range(400)]
    labels = spark.createDataFrame(
        [(1000 + i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.document_toxicity(docs.unionByName(documents(spark, rows)), labels).collect()
    assert len(got) == len(ROWS) + 400
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if (r["doc_id"] or 0) >= 1000:
            assert r["predicted"] == int((r["doc_id"] - 1000) % 4 == 0)
    assert toxicity.document_toxicity(empty, labels).count() == 0
    assert toxicity.document_toxicity(docs, labels.limit(0)).filter("score > 0.3").count() == 0


# --- 2 fingerprints

def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints_match_brute_force(spark, empty):
    rows = [r for r in ROWS if r[0] is not None and r[1] not in ("twice",) and not (r[0] == 12 and len(r[1]) > 50)]
    rows = sorted({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: r for r in sketch.fingerprints(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, (doc, text, *_) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + after[:quarter]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(shingles(text), shingles(edited))) < 0.15
        assert abs(r["near_next"] - likeness(shingles(text), shingles(after))) < 0.15
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[9]["fingerprint"] and got[5]["fingerprint"] == ""
    assert sketch.fingerprints(empty).count() == 0


def test_fingerprints_of_shared_and_missing_ids(spark):
    rows = [(1, "a b c d", "en", "s"), (1, "e f g h", "en", "s"), (None, "z" * 8, "en", "s"), (2, "q" * 8, "en", "s")]
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in sketch.fingerprints(documents(spark, rows)).collect()}
    want = {(None, 8, "zzzzzza "), (1, 7, "a b c q"[:6] + "q"), (1, 7, "e f g q"[:6] + "q"), (2, 8, "qqqqqqzz")}
    assert got == {(i, n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in want}


def test_sketches_merge_and_estimate(spark):
    df = spark.createDataFrame([("x", prose(900, random.Random(1))), ("x", prose(900, random.Random(2)))], "g string, text string")
    df = sketch.add_sketch(df, "s", "text")
    whole = sketch.add_sketch(df.groupBy("g").agg(F.concat_ws(" | | | | ", F.collect_list("text")).alias("text")), "s", "text")
    merged = sketch.merge_sketches(df, ["g"], "s").select("g", "s")
    a, b = merged.first()["s"], whole.first()["s"]
    assert len(a) == sketch.K and a == sorted(a) and len(set(a) & set(b)) > 0.9 * sketch.K
    one = df.limit(1).select("s", F.lit(None).cast("string").alias("none"))
    joined = one.crossJoin(merged.select(F.col("s").alias("all")))
    r = joined.select(sketch.containment("s", "all").alias("c"), sketch.distinct_count(F.col("all")).alias("n")).first()
    assert r["c"] > 0.75 and abs(r["n"] - 1790) < 500


# --- 3 language

def test_language_of_awkward_rows(spark, docs, empty):
    rng = random.Random(3)
    other = "zwischen straße über grün schön zehn fuß kälte mögen nicht auch".split()
    rows = [(2000 + i, " ".join(rng.choice(other if i % 2 else WORDS) for _ in range(60)), "de" if i % 2 else "en", "a") for i in range(160)]
    got = language.document_languages(documents(spark, rows).unionByName(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert len(got) == 160 + len(ROWS)
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("de", "en", "und")
        if (r["doc_id"] or 0) >= 2000:
            assert r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en")
        if r["doc_id"] in (4, 5, 6, 14):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0), texts[r["doc_id"]]
    assert language.document_languages(empty).count() == 0
    assert {r["lang_pred"] for r in language.document_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, language.WINDOW)).astype(np.uint8)
    net = language.ByteNet.fit(x, np.arange(40) % 2, ["a", "b"], epochs=1)
    vectors, pooled = net.embed[x], []
    for w, f, b in zip(language.WIDTHS, net.filters, net.bias):
        patch = np.concatenate([vectors[:, j:language.WINDOW - w + 1 + j] for j in range(w)], axis=2)
        pooled.append((patch @ f + b).max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.dense + net.shift
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probabilities(x, net.tables()), z, atol=1e-4)


# --- 4 lattice

def test_decode_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    point = lattice.decode(x)
    twice = np.rint(2 * point)
    assert np.allclose(twice, 2 * point) and (np.abs(twice % 2).std(axis=1) == 0).all() and (point.sum(axis=1) % 2 == 0).all()
    around = point[:, None] + lattice.shortest_vectors()[None]
    assert (((x - point) ** 2).sum(1)[:, None] <= ((x[:, None] - around) ** 2).sum(2) + 1e-9).all()


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 32))
    near = base[:60] + rng.normal(size=(60, 32)) * 0.2
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate([*base, *near, base[0], 2 * base[1]])]
    rows += [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [None] + [1.0] * 31, 0),
             (904, [1.0, 2.0], 0), (905, [2.0, 4.0], 0), (None, [1.0] * 32, 0), (906, [], 0)]
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, root long")).collect()}
    assert len(got) == len(rows)
    usable = [r for r in rows if r[0] is not None and r[0] not in (900, 901, 902, 903, 906)]
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) if len(a) == len(b) else 0
    pairs = [(i, j) for i in range(len(usable)) for j in range(i) if cos(usable[i][1], usable[j][1]) >= 0.95]
    found = sum(got[r[0]]["n_links"] for r in usable) / 2
    assert 0.97 * len(pairs) <= found <= len(pairs) and len(pairs) > 30
    root = roots(len(usable), pairs)
    same = sum(got[r[0]]["component_id"] == usable[root[i]][0] for i, r in enumerate(usable))
    assert same >= 0.97 * len(usable)
    assert got[905]["component_id"] == 904 and got[210]["component_id"] == 0 and got[210]["n_links"] >= 1
    for i in (900, 901, 902, 903, 906):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(400, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    ka, kb = (lattice.Hasher(64).keys(x) for x in (a, b))
    met = ((ka[:, :, :1] == kb) | (kb[:, :, :1] == ka)).any(axis=(1, 2))
    assert met.mean() >= 0.95


# --- 5 sharding

def test_shards(spark, docs, empty, tmp_path):
    written = sharding.write_shards(docs, str(tmp_path / "a"), 3, bucket_bytes=10_000)
    rows = written.collect()
    assert sorted(str((r["doc_id"], r["text"], r["source"])) for r in rows) == sorted(str((i, t, s)) for i, t, _, s in ROWS)
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(3)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    again = sharding.write_shards(docs, str(tmp_path / "b"), 3, bucket_bytes=10_000).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sharding.write_shards(empty, str(tmp_path / "c"), 3).count() == 0


def test_shuffle_is_uniform(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    order = [r["doc_id"] for r in sharding.shuffled(ids, bucket_bytes=5000).orderBy("place").collect()]
    assert sorted(order) == list(range(4000)) and abs(np.corrcoef(order, range(4000))[0, 1]) < 0.06
    assert abs(np.mean(order[:400]) - 2000) < 200


# --- 6 fixity

def test_audit_finds_only_what_differs(spark):
    rows = [(f, o * 100, f"record {f} {o} " + "x" * 50) for f in range(3) for o in range(400)] + [(9, 0, None)]
    schema = "file long, offset long, payload string"
    other = {(f, o): p for f, o, p in rows}
    other[1, 700] = "broken"
    del other[2, 39_900]
    other[0, 5] = "more"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame([(*k, p) for k, p in other.items()], schema)
    got = {(r["file"], r["offset"], r["status"]) for r in fixity.audit(a, b, range_bytes=1000, fan_out=4).collect()}
    assert got == {(1, 700, "changed"), (2, 39_900, "missing"), (0, 5, "extra")}
    assert fixity.audit(a, a, range_bytes=1000).count() == 0 and fixity.audit(a.limit(0), b.limit(0)).count() == 0


def test_audit_of_awkward_pages(spark):
    pages = spark.createDataFrame([(13, None, None), (13, "u", "é"), (None, "v", ""), (5, "w", "y" * 200_000), (6, "", "z")],
                                  "page_id long, url string, html string")
    got = sorted((r["page_id"], r["status"]) for r in fixity.audited_pages(pages).collect())
    assert got == [(5, "missing"), (13, "changed"), (13, "changed")]


# --- 7 BPE

VOCABULARY = queries.vocabulary("word_bpe_49k.json")


def test_ids_equal_the_library(spark, docs, empty):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "ÀéßΣσς İı 日本語🙂'’- \t   \x1c\x85 0123456789<|>"
    rows = [(3000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 400))), "en", "a") for i in range(300)]
    rows += [(4000, "<|startoftext|>ab<|endoftext|>'re we'Re <|endoftext", "en", "a"), (4001, "a" * 3000 + "é" * 500, "en", "a")]
    library = Tokenizer.from_file(VOCABULARY)
    got = bpe.encode(docs.unionByName(documents(spark, rows)), VOCABULARY).collect()
    assert len(got) == len(ROWS) + len(rows) and set(got[0].asDict()) == {
        "doc_id", "lang", "source", "n_chars", "shard", "fp", "ids", "decoded"}
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in ROWS + rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in got)
    assert bpe.encoded_documents(empty, VOCABULARY).count() == 0


def test_prefix_programme_equals_merging():
    with open(VOCABULARY, encoding="utf-8") as file:
        model = bpe.WordBpe(file.read())
    rng = random.Random(8)
    for _ in range(3000):
        word = "".join(rng.choice("etaoinshrdluabc") for _ in range(rng.randint(1, 14)))
        assert model.encode(word) == [model.tokens[t] for t in model.merged(word + bpe._END)]


# --- 8 chunks

def test_passages_are_cut_once(spark, docs, empty):
    got = {}
    for r in chunks.without_repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    texts = {i: t for i, t, *_ in ROWS}
    assert sum(map(len, got.values())) == len(ROWS)
    for i in (1, 4, 5, 6, 7, 8, 9, 10):
        assert got[i][0]["text"] == texts[i] and got[i][0]["cut_spans"] == []
    assert got[2][0]["text"] == "" and len(got[3][0]["text"]) < len(BASE) / 2
    cut = got[11][0]
    assert PASSAGE not in cut["text"] and cut["text"].startswith(texts[11][:40]) and cut["text"].endswith(texts[11][-100:])
    data = texts[11].encode()
    assert all(s["end"] - s["start"] >= 60 and data[s["start"]:s["end"]].decode() in PASSAGE for s in cut["cut_spans"])
    assert chunks.without_repeats(empty).count() == 0
    assert {"shard", "fp", "ids"} <= set(chunks.without_repeats(docs).columns)


def test_short_repeats_stay(spark):
    rng = random.Random(12)
    short, long = prose(25, rng), prose(55, rng)
    rows = [(i, f"{prose(60, rng)} {short} {prose(60, rng)} {long} {prose(60, rng)}", "en", "a") for i in range(4)]
    got = {r["doc_id"]: r for r in chunks.without_repeats(documents(spark, rows)).collect()}
    for i, text, *_ in rows:
        assert short in got[i]["text"] and (long in got[i]["text"]) == (i == 0)
        assert (got[i]["text"] == text) == (i == 0)


def test_room_reaches_into_the_chunks_beside_a_run():
    gear, rng = chunks.gear_table(), random.Random(13)
    for _ in range(300):
        passage = prose(50, rng)
        a, b = [(prose(80, rng) + " " + passage + " " + prose(80, rng)).encode() for _ in range(2)]
        seen = {d: 1 for d in chunks.digests(a, chunks.cuts(a, gear))}
        ends = chunks.cuts(b, gear)
        owners = [seen.get(d) for d in chunks.digests(b, ends)]
        found = chunks.runs(ends, owners, chunks.LEAST_RUN, chunks.LEAST_SHARED)
        assert all(chunks.room(b, ends, *r) >= 50 for r in found)


def test_cuts_move_only_near_an_insertion():
    gear, rng = chunks.gear_table(), random.Random(9)
    data = prose(2000, rng).encode()
    ends = chunks.cuts(data, gear)
    assert ends[-1] == len(data) and all(a < b for a, b in zip(ends, ends[1:]))
    shifted = chunks.cuts(data[:5000] + b"new" + data[5000:], gear)
    assert len({e for e in ends if e > 5400} - {e - 3 for e in shifted}) <= 1
    assert {e for e in ends if e < 4800} <= set(shifted)
    assert chunks.cuts(b"", gear) == [] and chunks.cuts(b"a", gear) == [1]
    assert max(np.diff([0, *chunks.cuts(b"q" * 9000, gear)])) <= chunks.LONGEST


def test_random_passages_are_found():
    gear, rng, missed = chunks.gear_table(), random.Random(10), 0
    for _ in range(300):
        passage = prose(51, rng)
        a, b = [(prose(80, rng) + " " + passage + " " + prose(80, rng)).encode() for _ in range(2)]
        seen = {d: 1 for d in chunks.digests(a, chunks.cuts(a, gear))}
        ends = chunks.cuts(b, gear)
        owners = [seen.get(d) for d in chunks.digests(b, ends)]
        missed += not chunks.runs(ends, owners, chunks.LEAST_RUN, chunks.LEAST_SHARED)
    assert missed <= 3


# --- 9 mixing

def test_targets_and_taken(spark, docs, empty):
    got = mixing.copies(docs).collect()
    assert len(got) == len(ROWS)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, t, _, s in ROWS:
        total[s] = total.get(s, 0) + size(t)
    names = sorted((s for s in total if s is not None)) + [None]
    target, open_, left = {}, dict(zip(names, [5, 2, 1] * len(names))), 1.5 * sum(total.values())
    while True:  # stop at twice the source, share the rest again
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            del open_[s]
    target |= share
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == total[r["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
    assert sorted(map(str, mixing.copies(docs).collect())) == sorted(map(str, got))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_taken_comes_near_the_target(spark):
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(1, 200), "en", "ab"[i % 3 > 0]) for i in range(3000)]
    got = mixing.copies(documents(spark, rows)).groupBy("source", "target").agg(F.sum(F.expr("size * copies")).alias("taken"))
    for r in got.collect():
        assert abs(r["taken"] - r["target"]) <= 0.01 * r["target"]


# --- 10 SimHash

def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs, empty):
    want = sorted((str(i), f"{simhash(t):016x}") for i, t, *_ in ROWS)
    got = covering.near_document_components(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == want
    prints = [simhash(t) for _, t, *_ in ROWS]
    root = roots(len(ROWS), [(i, j) for i in range(len(ROWS)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    least = {r: min([ROWS[i][0] for i in range(len(ROWS)) if root[i] == r and ROWS[i][0] is not None], default=None) for r in root}
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == sorted(
        str((i, f"{simhash(t):016x}", least[root[k]])) for k, (i, t, *_) in enumerate(ROWS))
    kept = covering.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert covering.near_document_components(empty).count() == 0


def test_every_pair_within_the_radius_collides():
    masks, rng = covering.covering_masks(3), random.Random(12)
    assert len(masks) == 15
    for _ in range(3000):
        change = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & change for m in masks)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_of_a_dense_group(spark, block):
    rng = random.Random(13)
    center = rng.getrandbits(64)
    prints = list({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(200)}
                  | {rng.getrandbits(64) for _ in range(100)})
    frame = spark.createDataFrame([(covering._signed(p),) for p in prints], "fp long")
    edges = [(r["a"], r["b"]) for r in covering.links(frame, block=block).collect()]
    at = {covering._signed(p): i for i, p in enumerate(prints)}
    want = roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    got = roots(len(prints), [(at[a], at[b]) for a, b in edges])
    assert got == want
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 64 for a, b in edges)
