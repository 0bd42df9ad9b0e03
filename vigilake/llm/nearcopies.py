"""Near copies by exact Jaccard similarity of word shingles, found by covering search, then by prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm import covering
from vigilake.llm.common import components, ship, without
from vigilake.llm.covering import BLOCK, SEED
from vigilake.session import cut, fresh_path

SHINGLE = 5
SIMILARITY = 0.8
#: Texts that common shingles are learned from, at least and as a share of all, and how many of these are kept.
#: Only speed hangs on them; by the share, texts that share a shingle not found common stay few at any size.
SAMPLE, SHARE, MOST_COMMON = 5_000, 0.1, 200_000
#: Texts whose keys are sent to every task, so that no other text moves to be compared.
MOST_SENT = 500_000
#: A round of leads is followed by another if it links at least one in so many of the pairs it compares.
WORTH = 4
#: Pairs that one step of a comparison lists, and texts whose shingles a worker holds at once.
STEP, TEXTS = 1 << 18, 256
#: Shingles of one block of texts, on average, when pairs are confirmed; fewest blocks.
HELD, BLOCKS = 1 << 20, 8
KEYS = ["_id", "_none", "_hash"]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words as in ``covering.fingerprint``.

    Too few words: the whole sequence is one shingle. No word, or null: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], SEED) for a, b in
             zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1:] - 1).tolist())]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles, as many as two texts at ``similarity`` can't both hold without a common one.

    The order is one for all texts: shingles not in ``common`` (sorted) first, then by ``rank``, then by hash.
    """
    if not len(found):
        return found
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.lexsort((found, np.where(common[at] == found, rank[at], 0)))]
    return found[: len(found) - ceil(similarity * len(found) - 1e-9) + 1]


def marks(found: np.ndarray) -> np.ndarray:
    """The number of shingles, then one bit for each of their last bits, set if an odd number of them ends so.

    Two sets differ in at least as many shingles as their marks differ in bits, whatever the
    number of words, a power of two that gives at least two bits a shingle.
    """
    words = 4
    while words * 32 < len(found):
        words *= 2
    odd = np.bincount((found.view(np.uint64) & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.concatenate(([len(found)], np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(s) for s in sets])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets), pa.int64()))


def _sliced(texts: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    for start in range(0, len(texts), TEXTS):
        yield [shingles(t.as_py(), size) for t in texts[start:start + TEXTS]]


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for sets in _sliced(batch, size):
                yield _lists(sets)

    return F.arrow_udf(run, T.ArrayType(T.LongType()))


def common_shingles(docs: DataFrame, size: int = SHINGLE, sample: int = SAMPLE,
                    most: int = MOST_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that occur in three or more of about ``sample`` texts, or ``SHARE`` of all if more, and how often."""
    rows = docs.count()
    some = docs if rows <= sample else docs.sample(max(SHARE, sample / rows), seed=SEED)

    of = _shingle_sets(size)
    top = (some.select(F.explode(of("text")).alias("h")).groupBy("h").count().filter("count > 2")
           .orderBy(F.desc("count"), "h").limit(most).collect())
    found = np.array([r["h"] for r in top], np.int64)
    order = np.argsort(found)
    return found[order], np.array([r["count"] for r in top], np.int64)[order]


def _written(df: DataFrame) -> DataFrame:
    """``df`` from a file: fewer bytes than a checkpoint where rows are many."""
    path = fresh_path(df.sparkSession, "near-copies")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _keyed(docs: DataFrame) -> DataFrame:
    return without(docs, *KEYS).select(
        "*", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"),
        F.xxhash64("text").alias("_hash"))


def _fits(n, at, m, other, similarity: float):
    """Whether sets of ``n`` and ``m`` that share the shingle at these places can be similar enough."""
    least = (F.least, np.minimum)[not isinstance(n, Column)]
    return least(at, other) + 1 + least(n - at - 1, m - other - 1) >= (n + m) * (similarity / (1 + similarity)) - 1e-9


def _need(n, m, similarity: float):
    """Shared shingles among the rarest of sets of ``n`` and ``m`` without which they can't be similar enough."""
    most, up = ((F.greatest, F.ceil) if isinstance(n, Column) else (np.maximum, np.ceil))
    return (n + m) * (similarity / (1 + similarity)) - up(most(n, m) * similarity - 1e-9) + 1 - 1e-9


def _crossing(similarity: float):
    """Pairs of different roots inside each group of rows sorted by ``h, low, high, root``."""
    keys, fields = ("h", "low", "high"), ("root", "own", "class", "n", "at")

    def pairs(t):
        one, size = t["low"][0] == t["high"][0], len(t["root"])
        ahead = np.searchsorted(t["root"], t["root"], side="right")
        counts = size - ahead
        start = 0
        while start < size:
            stop = max(start + 1, start + int(np.searchsorted(np.cumsum(counts[start:]), STEP, side="right")))
            c = counts[start:stop]
            i = np.repeat(np.arange(start, stop), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + ahead[i]
            fit = _fits(t["n"][i], t["at"][i], t["n"][j], t["at"][j], similarity)
            if not one:
                fit &= t["own"][i] != t["own"][j]
            a, b = t["class"][i[fit]], t["class"][j[fit]]
            need = _need(t["n"][i[fit]], t["n"][j[fit]], similarity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need)], names=["a", "b", "need"])
            start = stop

    def groups(t):
        new = np.zeros(len(t["h"]), bool)
        for c in keys:
            new[1:] |= t[c][1:] != t[c][:-1]
        return [0, *np.flatnonzero(new).tolist()]

    def crossed(batches):
        held = None
        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, *fields)}
            if held is not None:
                t = {c: np.concatenate((held[c], t[c])) for c in t}
            if not len(t["h"]):
                continue
            starts = groups(t)
            for a, b in zip(starts, starts[1:]):
                yield from pairs({c: v[a:b] for c, v in t.items()})
            held = {c: v[starts[-1]:] for c, v in t.items()}
        if held is not None:
            yield from pairs(held)

    return crossed


def _alike(similarity: float):
    """Whether two marks differ in no more bits than sets similar enough differ in shingles."""
    def test(one: np.ndarray, two: np.ndarray) -> bool:
        total, one, two = one[0] + two[0], one[1:], two[1:]
        while len(one) != len(two):
            if len(one) > len(two):
                one, two = two, one
            half = len(two) // 2
            two = two[:half] ^ two[half:]
        differ = int(np.bitwise_count((one ^ two).view(np.uint64)).sum())
        return differ * (1 + similarity) <= total * (1 - similarity) + 1e-6

    return test


def _similar(similarity: float):
    """Whether two sets, sorted and distinct, are similar enough."""
    def test(one: np.ndarray, two: np.ndarray) -> bool:
        met = len(np.intersect1d(one, two, assume_unique=True))
        return met * (1 + similarity) >= (len(one) + len(two)) * similarity - 1e-9

    return test


def _passing(pairs: DataFrame, sets: DataFrame, test) -> DataFrame:
    """The pairs ``a, b`` whose ``sets`` (``class, held``) pass the test.

    Classes are dealt into blocks; a set goes once to each two blocks that hold a pair of it, not once to each pair.
    """
    blocks = max(BLOCKS, ceil((sets.agg(F.sum(F.size("held"))).first()[0] or 0) / HELD))

    def own(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")

    placed = pairs.select("a", "b", own("a").alias("low"), own("b").alias("high"))
    needed = placed.select(F.col("low").alias("one"), F.col("high").alias("two"),
                           F.explode(F.array("a", "b")).alias("class")).distinct()

    def confirm(held: pa.Table, both: pa.Table) -> pa.Table:
        lists = held["held"].combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        at = {c: (ends[i], ends[i + 1]) for i, c in enumerate(held["class"].to_pylist())}

        def enough(a: int, b: int) -> bool:
            (a0, a1), (b0, b1) = at[a], at[b]
            return test(values[a0:a1], values[b0:b1])

        both = both.select(["a", "b"])
        return both.filter(pa.array([enough(a, b) for a, b in zip(both["a"].to_pylist(), both["b"].to_pylist())], pa.bool_()))

    return (needed.join(sets, "class").groupBy("one", "two").cogroup(placed.groupBy("low", "high"))
            .applyInArrow(confirm, "a long, b long"))


def _led(rooted: DataFrame, turn: int, similarity: float) -> DataFrame:
    """``a, b, met, need``: classes with the first one of each shingle they share, in this turn's order, if apart."""
    first = F.min(F.struct(F.xxhash64("class", F.lit(turn)).alias("order"), "class", "n", "at", "root"))
    leads = (rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), first.alias("lead"))
             .filter("low < high").select("h", "lead"))
    n, m = F.col("n"), F.col("lead.n")
    return (rooted.join(leads, "h").filter("root <> lead.root")
            .filter(_fits(n, F.col("at"), m, F.col("lead.at"), similarity))
            .groupBy(F.least("class", "lead.class").alias("a"), F.greatest("class", "lead.class").alias("b"))
            .agg(F.count("*").alias("met"), F.max(_need(n, m, similarity)).alias("need")))


def _near_prints(prints: DataFrame, block: int) -> DataFrame:
    """Pairs ``a, b`` of classes whose fingerprints (``fp, class``) the covering search of ``covering`` links.

    Classes of one fingerprint meet its smallest, and the smallest ones meet along the links of their
    fingerprints: a few pairs a class, whatever the size of a group.
    """
    lead = cut(prints.groupBy("fp").agg(F.min("class").alias("lead")))
    ends = [lead.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead")) for c in ("a", "b")]
    across = covering.links(lead.select("fp"), block=block).join(ends[0], "a").join(ends[1], "b")
    pairs = prints.join(lead, "fp").select(F.col("lead").alias("x"), F.col("class").alias("y")).unionByName(
        across.select(F.col("a_lead").alias("x"), F.col("b_lead").alias("y")))
    return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose classes are not connected yet."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("class").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    return pairs.filter("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")


def classes_and_links(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE,
                      block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``class, first`` for each distinct set of shingles, and edges ``a, b`` between similar classes.

    Two sets at ``similarity`` or more share one of their rarest shingles, so every
    such pair meets there; each edge is confirmed on the whole sets, sent only for pairs
    whose marks, some thirtieth of their size, don't rule it out already, and the edges
    connect all classes that similar pairs connect. First the classes meet whose SimHash
    fingerprints the covering search links; its radius misses pairs near ``similarity``, so
    what is not connected by then goes on: each class is compared with the smallest one
    that shares such a shingle, then, in rounds, with the first in an order of that round. When a round connects
    few, those still apart are compared in blocks two by two: a large group of near
    copies costs a few pairs a member, also where its first member is unlike most.
    """
    ship(docs.sparkSession)
    common, rank = common_shingles(docs, size)

    def post(texts: list[str | None]) -> list[pa.Array]:
        sets = [shingles(t, size) for t in texts]
        return [pa.array(np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64,
                                     len(sets)).view(np.int64)),
                pa.array([len(s) for s in sets], pa.int64()),
                _lists([prefix(s, common, rank, similarity) for s in sets]),
                _lists([marks(s) for s in sets])]

    posted = [T.StructField("class", T.LongType()), T.StructField("n", T.LongType()),
              T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("marks", T.ArrayType(T.LongType()))]
    whole = _shingle_sets(size)
    keyed = _keyed(docs.select("doc_id", "text"))
    rows = _written(covering.add_fingerprint(keyed, shingle=size, also=post, fields=posted)
                    .select(*KEYS, "fp", *[f.name for f in posted]))
    classes = cut(rows.groupBy("class").agg(F.min(F.struct("_none", "_id", "_hash")).alias("first")))
    firsts = classes.select("class", *[F.col(f"first.{c}").alias(c) for c in KEYS])
    bucket = Window.partitionBy("h")
    shared = _written(
        rows.join(firsts, ["class", *KEYS], "left_semi").select("class", "n", F.posexplode("prefix").alias("at", "h"))
        .select("h", "class", F.expr("shiftleft(n, 32) + at").alias("place"))
        .withColumn("lead", F.min(F.struct("class", "place")).over(bucket))
        .withColumn("last", F.max("class").over(bucket)).filter("lead.class < last")
        .selectExpr("h", "class", "shiftright(place, 32) AS n", "place & 4294967295 AS at", "lead.class AS lead",
                    "shiftright(lead.place, 32) AS lead_n", "lead.place & 4294967295 AS lead_at"))

    def ends(pairs: DataFrame) -> DataFrame:
        """The first rows of the classes of the pairs."""
        both = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
        wanted = cut(firsts.join(both, "class", "left_semi"))
        return F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted

    def confirmed(pairs: DataFrame) -> DataFrame:
        marked = _written(rows.join(ends(pairs), ["class", *KEYS], "left_semi").select("class", F.col("marks").alias("held"))
                          .dropDuplicates(["class"]))
        alike = cut(_passing(pairs, marked, _alike(similarity)))
        sets = _written(keyed.join(ends(alike), KEYS).dropDuplicates(["class"]).select("class", whole("text").alias("held")))
        return cut(_passing(alike, sets, _similar(similarity)))

    to_lead = shared.filter("class <> lead").filter(
        _fits(F.col("n"), F.col("at"), F.col("lead_n"), F.col("lead_at"), similarity))
    often = to_lead.groupBy(F.col("lead").alias("a"), F.col("class").alias("b")).agg(
        F.count("*").alias("met"), F.max(_need(F.col("n"), F.col("lead_n"), similarity)).alias("need"))
    likely = "2 * met >= need"  # of the rest, those still apart meet again below
    near = cut(_near_prints(rows.select("fp", "class").distinct(), block))
    links = confirmed(near)
    roots = components(links).select(F.col("node").alias("class"), "root")
    tried = cut(_apart(often.filter(likely).select("a", "b"), roots))
    links = cut(links.unionByName(confirmed(tried)))
    found, tried = links, near.unionByName(tried)
    places, turn = shared.drop("lead", "lead_n", "lead_at"), 0
    while True:
        roots = components(links).select(F.col("node").alias("class"), "root")
        rooted = places.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        if found.count() * WORTH < max(1, tried.count()):
            break
        turn += 1
        tried = cut(_led(rooted, turn, similarity).filter(likely).select("a", "b"))
        found = confirmed(tried)
        links = cut(links.unionByName(found))
    apart = (rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"))
             .filter("low < high").select("h", F.ceil(F.col("rows") / block).cast("int").alias("blocks")))
    members = rooted.join(apart, "h").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    keys = ["h", "low", "high"]
    met = (members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("h", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                   "root", "own", "class", "n", "at")
           .repartition(*keys).sortWithinPartitions(*keys, "root")
           .mapInArrow(_crossing(similarity), "a long, b long, need double")
           .groupBy("a", "b").agg(F.count("*").alias("met"), F.max("need").alias("need"))
           .filter("met >= need").select("a", "b"))
    return classes, links.unionByName(confirmed(cut(met)))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near copies, columns as given: that of the smallest id
    (nulls last), then of the smallest text hash; of rows equal in both, any one.

    Texts whose sets of word shingles have a Jaccard similarity of 0.8 or more are
    near copies, and so are those that a chain of such pairs connects. Null, empty and
    blank texts are copies of each other.
    """
    classes, links = classes_and_links(docs, **options)
    roots = components(links).select(F.col("node").alias("class"), "root")
    kept = (classes.join(roots, "class", "left").groupBy(F.coalesce("root", "class").alias("root"))
            .agg(F.min("first").alias("first")).select(*[F.col(f"first.{c}").alias(c) for c in KEYS]))
    return (_keyed(docs).join(kept, KEYS, "left_semi").dropDuplicates(KEYS)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
