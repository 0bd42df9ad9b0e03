"""Duplicate and recap screening of articles, faithful to arrival order.

Rule, per article in order of ``seq``:
  1. recap score above 3.0 -> rejected as recap;
  2. similarity above 0.8 to the last accepted article with the same signature
     -> duplicate;
  3. similarity above 0.92 to any accepted article -> near duplicate;
  4. otherwise accepted.

Similarity depends only on lower-cased title and location, so articles fold into
*classes* of equal title and location first; at most one article per class is
ever accepted, and a million copies cost one class. Classes are settled in
windows over arrival order, each larger than the last: a window is first pruned
against what earlier windows accepted, and only the survivors are compared with
each other. A large family of near copies therefore meets its accepted leader,
not itself. Where signatures are shared, what is left of a window is walked in
arrival order, each connected part of it on its own: a row is compared with the
last accepted one of its signature only, so comparisons grow with the rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.match import once
from vigilake.llm.common import components
from vigilake.operators.enrich import confidence, recap_score, signature
from vigilake.operators.greedy import chain_select
from vigilake.operators.similarity import blocked_pairs, could_reach, letter_counts, scorer, similarity
from vigilake.session import cut

NEAR = 0.92
SAME_SIGNATURE = 0.8
TITLE_WEIGHT, LOCATION_WEIGHT = 0.6, 0.4
TITLE_FLOOR = (NEAR - LOCATION_WEIGHT) / TITLE_WEIGHT            # 13/15, when locations agree
LOCATION_FLOOR = (NEAR - TITLE_WEIGHT) / LOCATION_WEIGHT         # 0.8, when titles agree
DUP_TITLE_FLOOR = (SAME_SIGNATURE - LOCATION_WEIGHT) / TITLE_WEIGHT
#: Rows of a signature up to which all its pairs are compared; those of a longer one grow too fast.
CHAIN_ROWS = 128


def dedup_signature(df: DataFrame) -> DataFrame:
    """First article per signature, by aggregation."""
    cols = [c for c in df.columns if c != "signature"]
    return df.groupBy("signature").agg(F.min_by(F.struct(*cols), "seq").alias("_row")).select(
        "signature", "_row.*")


def _class_key() -> Column:
    return F.md5(F.concat_ws("\u0001", "t", "l").cast("binary"))


def _with_class(df: DataFrame) -> DataFrame:
    lowered = once(df, t=F.lower(F.coalesce("title", F.lit(""))), l=F.lower(F.coalesce("location", F.lit(""))))
    return lowered.withColumn("cls", _class_key())


def _combined(a: str, b: str, metric: str) -> Column:
    return (similarity(F.col(f"{a}.t"), F.col(f"{b}.t"), metric) * TITLE_WEIGHT
            + similarity(F.col(f"{a}.l"), F.col(f"{b}.l"), metric) * LOCATION_WEIGHT)


def _texts(side: str) -> Column:
    return F.struct(*[F.col(f"{side}.{c}").alias(c) for c in ("key", "t", "l")]).alias(side)


def _located(classes: DataFrame) -> DataFrame:
    return classes.filter(F.length("t") > 0).select(
        F.col("cls").alias("key"), "t", "l", F.length("t").alias("n"), letter_counts(F.col("t")).alias("counts"))


def _near_locations(classes: DataFrame, metric: str) -> DataFrame:
    """Ordered pairs of distinct location strings that are similar enough, equal
    ones included. Strings above 0.8 share two adjacent characters, so those are
    the join key; every pair is then tested."""
    places = classes.select("l").distinct()
    grams = places.filter(F.length("l") >= 2).select("l", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("l") - 1), lambda i: F.substr(F.col("l"), i, F.lit(2))))).alias("gram"))
    other = grams.withColumnRenamed("l", "other")
    close = (
        grams.join(other, "gram").filter(
            (F.col("l") != F.col("other"))
            & (F.least(F.length("l"), F.length("other")) * 2
               >= F.lit(LOCATION_FLOOR) * (F.length("l") + F.length("other"))))
        .select("l", "other").distinct()
        .filter(similarity(F.col("l"), F.col("other"), metric) > LOCATION_FLOOR)
    )
    return places.select("l", F.col("l").alias("other")).unionByName(close)


def near_edges(new: DataFrame, old: DataFrame, metric: str = "ratio") -> DataFrame:
    """Class pairs (new, old, sim) above the near-duplicate limit, the newer
    class as first argument. Inputs: cls, t, l."""
    places = cut(_near_locations(new.select("l").union(old.select("l")), metric))
    left = _located(new).join(places, "l").withColumnRenamed("other", "place")
    right = _located(old).withColumn("place", F.col("l"))
    pairs = blocked_pairs(left, right, "place", TITLE_FLOOR, one_sided=False).filter(
        (F.col("l.key") != F.col("r.key"))
        & could_reach("l.t", "r.t", "l.counts", "r.counts", F.lit(TITLE_FLOOR)))
    titled = pairs.select(_texts("l"), _texts("r")).withColumn(
        "sim", _combined("l", "r", metric)).filter(F.col("sim") > NEAR).select(
        F.col("l.key").alias("new"), F.col("r.key").alias("old"), "sim")
    # empty titles match each other fully, so only their locations differ
    blank = new.filter("t = ''").select(F.col("cls").alias("new"), "l").join(places, "l").join(
        old.filter("t = ''").select(F.col("cls").alias("old"), F.col("l").alias("other")), "other"
    ).filter(F.col("new") != F.col("old")).withColumn(
        "sim", TITLE_WEIGHT + similarity(F.col("l"), F.col("other"), metric) * LOCATION_WEIGHT)
    return titled.unionByName(blank.filter(F.col("sim") > NEAR).select("new", "old", "sim"))


def signature_edges(rows: DataFrame, metric: str = "ratio") -> DataFrame:
    """Class pairs that share a signature and exceed the same-signature limit
    (rows: signature, cls, t, l)."""
    members = rows.select("signature", "cls", "t", "l").distinct()
    shared = members.groupBy("signature").agg(F.count("*").alias("_n")).filter("_n > 1").select("signature")
    members = members.join(shared, "signature", "left_semi")
    sized = members.filter(F.length("t") > 0).select(
        "signature", F.col("cls").alias("key"), "t", "l", F.length("t").alias("n"),
        letter_counts(F.col("t")).alias("counts"))
    pairs = blocked_pairs(sized, sized, "signature", DUP_TITLE_FLOOR, one_sided=False).filter(
        (F.col("l.key") != F.col("r.key"))
        & could_reach("l.t", "r.t", "l.counts", "r.counts", F.lit(DUP_TITLE_FLOOR)))
    titled = pairs.select("l.signature", _texts("l"), _texts("r")).withColumn(
        "sim", _combined("l", "r", metric)).select(
        "signature", F.col("l.key").alias("new"), F.col("r.key").alias("old"), "sim")
    blanks = members.filter("t = ''")
    blank = blanks.select("signature", F.col("cls").alias("new"), "l").join(
        blanks.select("signature", F.col("cls").alias("old"), F.col("l").alias("other")), "signature"
    ).filter(F.col("new") != F.col("old")).withColumn(
        "sim", TITLE_WEIGHT + similarity(F.col("l"), F.col("other"), metric) * LOCATION_WEIGHT)
    return titled.unionByName(blank.select("signature", "new", "old", "sim")).filter(
        F.col("sim") > SAME_SIGNATURE)


def _window_edges(nodes: DataFrame, first: int, growth: int) -> list[int | None]:
    """Upper ``seq`` bounds of windows that hold about first, first*growth, ...
    nodes. The bounds are approximate quantiles; their exact place changes only
    the work split, never the result."""
    total = nodes.count()
    shares, size, upto = [], first, first
    while upto < total:
        shares.append(upto / total)
        size *= growth
        upto += size
    bounds = nodes.approxQuantile("seq", shares, 0.001) if shares else []
    return [int(b) for b in sorted(set(bounds))] + [None]


#: Taken off the arrival numbers of history, so that it precedes all new articles.
BEFORE_ALL = 2**62


def screen_articles(articles: DataFrame, history: DataFrame | None = None, metric: str = "ratio",
                    first_window: int = 50_000, growth: int = 4) -> DataFrame:
    """Verdict for every article: ``status`` (accepted, recap, duplicate,
    near_duplicate), ``matched_seq`` and ``similarity``.

    ``articles``: seq (unique arrival number), title, location, date, source,
    content. ``history``: already accepted articles, each earlier than every new
    one whatever its ``seq``; ``seq`` is not negative.
    """
    # few bytes but many word searches: deal the articles out, whatever their files
    tasks = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prepared = cut(signature(recap_score(_with_class(articles.repartition(tasks, "seq")))))
    candidates = prepared.filter(~F.col("recap_dropped"))
    rows = candidates.select("seq", "cls", "t", "l", "signature")
    old = None
    if history is not None:
        old = signature(_with_class(history)).select(
            (F.col("seq") - BEFORE_ALL).alias("seq"), "cls", "t", "l", "signature")

    members = rows if old is None else rows.unionByName(old)
    contested = cut(members.groupBy("signature").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter(
        "a <> z").select("signature", F.lit(True).alias("contested")))
    marked = rows.join(contested, "signature", "left").withColumn(
        "contested", F.coalesce("contested", F.lit(False)))
    # outside contested signatures only the first article of a class can count
    plain = marked.filter("not contested").groupBy("cls", "t", "l").agg(
        F.min_by(F.struct("seq", "signature"), "seq").alias("f")).select(
        "f.seq", "cls", "t", "l", "f.signature", F.lit(False).alias("contested"))
    nodes = cut(plain.unionByName(marked.filter("contested").select(*plain.columns)))

    kept = None if old is None else cut(old)
    links, dup_lost = None, rows.select("seq", F.col("seq").alias("matched_seq"), F.lit(0.0).alias("sim")).limit(0)
    lower = None
    for upper in _window_edges(nodes, first_window, growth):
        window = nodes
        if lower is not None:
            window = window.filter(F.col("seq") > lower)
        if upper is not None:
            window = window.filter(F.col("seq") <= upper)
        lower = upper
        classes = window.select("cls", "t", "l").distinct()
        if kept is not None:
            known = kept.select("cls", "t", "l").distinct()
            back = cut(near_edges(classes, known, metric))
            links = back if links is None else links.unionByName(back)
            hit = back.select(F.col("new").alias("cls")).union(known.select("cls")).distinct()
            window = cut(window.join(hit, "cls", "left_anti"))
            if window.isEmpty():
                continue
            classes = window.select("cls", "t", "l").distinct()
        classes = cut(classes)
        inside = cut(near_edges(classes, classes, metric))
        won, lost = _settle(window, inside, kept, metric)
        kept = won if kept is None else cut(kept.unionByName(won))
        dup_lost = dup_lost if lost is None else dup_lost.unionByName(lost)
        links = inside if links is None else links.unionByName(inside)
    return _verdicts(prepared, kept, links, dup_lost)


def _settle(window: DataFrame, near: DataFrame, kept_before: DataFrame | None, metric: str):
    """Accepted rows of a window, and what its signatures refused (or none). With contested
    signatures, the window is walked; without, in each round the first undecided row of a class
    is accepted if no undecided earlier row can reach it by a near edge."""
    cols = ["seq", "cls", "t", "l", "signature"]
    if not window.filter("contested").isEmpty():
        alive, kept, lost = _settle_chains(window, near, kept_before, metric)
        won, refused = _walk(alive, near, kept_before, metric)
        return (won, refused) if kept is None else (kept.unionByName(won), lost.unionByName(refused))
    alive, kept = window, None
    while True:
        first = alive.groupBy("cls").agg(F.min_by(F.struct("seq", "t", "l", "signature"), "seq")
                                         .alias("f")).select("cls", "f.*")
        seqs = first.select("cls", "seq")
        blocked = (
            near.join(seqs.toDF("new", "new_seq"), "new").join(seqs.toDF("old", "old_seq"), "old")
            .filter(F.col("old_seq") < F.col("new_seq")).select(F.col("new").alias("cls")).distinct()
        )
        ready = cut(first.join(blocked, "cls", "left_anti"))
        if ready.isEmpty():
            return (kept if kept is not None else window.select(*cols).limit(0)), None
        won = ready.select(*cols)
        reached = near.join(won.select(F.col("cls").alias("old"), F.col("seq").alias("k_seq")), "old").groupBy(
            F.col("new").alias("cls")).agg(F.min("k_seq").alias("k_seq"))
        alive = cut(
            alive.join(won.select("cls"), "cls", "left_anti").join(reached, "cls", "left")
            .filter(F.col("k_seq").isNull() | (F.col("seq") < F.col("k_seq"))).select(*window.columns))
        kept = won if kept is None else kept.unionByName(won)


def _walk(alive: DataFrame, near: DataFrame, kept_before: DataFrame | None, metric: str):
    """Accepted rows, and rows that their signature refused (``seq, matched_seq, sim``).

    Classes are linked by near edges and by contested signatures. What is not connected does not
    bear on each other, so each connected part is walked on its own by the rule itself: one pass
    in arrival order that holds the classes it refuses by now and the last accepted row of
    each signature. Parts are dealt out over tasks, and no task holds the rows of its parts."""
    cols = ["seq", "cls", "t", "l", "signature"]
    alive = alive.filter("seq IS NOT NULL")
    shared = alive.filter("contested").select("signature", "cls").distinct()
    heads = cut(shared.groupBy("signature").agg(F.min("cls").alias("head")))
    joined = cut(shared.select("cls").union(near.select(F.col("new").alias("cls"))).distinct())
    alone = alive.join(joined, "cls", "left_anti").select(*cols)  # one row a class, as no signature is shared
    number = lambda c: F.xxhash64(F.col(c))  # noqa: E731 (equal numbers would only connect more)
    parts = cut(components(
        shared.join(heads, "signature").select(number("cls").alias("a"), number("head").alias("b")).unionByName(
            near.select(number("new").alias("a"), number("old").alias("b")))))

    def in_part(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("node", number(key)).join(parts, "node", "left").withColumn(
            "part", F.coalesce("root", "node")).drop("node", "root")

    # in the order of ``part, seq, step``: starts, then the near classes of a class before its first row
    rows = alive.join(joined, "cls", "left_semi")
    near_of = near.groupBy(F.col("old").alias("cls")).agg(F.collect_list("new").alias("near"))
    steps = [in_part(rows, "cls").withColumns({"step": F.lit(2), "near": F.lit(None).cast("array<string>")}),
             in_part(near_of.join(rows.groupBy("cls").agg(F.min("seq").alias("seq")), "cls"), "cls").withColumns(
                 {"step": F.lit(1), "contested": F.lit(False)})]
    if kept_before is not None:
        starts = kept_before.join(heads, "signature").groupBy("signature", "head").agg(
            F.max(F.struct("seq", "cls", "t", "l")).alias("s")).select("signature", "head", "s.*")
        steps.append(in_part(starts, "head").drop("head").withColumns({"step": F.lit(0), "contested": F.lit(True)}))
    order = ["part", "seq", "step"]
    fields = [*order, "cls", "t", "l", "signature", "contested", "near"]
    stream = steps[0].select(*fields)
    for more in steps[1:]:
        stream = stream.unionByName(more, allowMissingColumns=True).select(*fields)
    tasks = int(alive.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(stream.repartition(tasks, "part").sortWithinPartitions(*order, "cls", "signature").mapInArrow(
        _walker(metric), "seq long, cls string, t string, l string, signature string, matched_seq long, sim double"))
    lost = found.filter("matched_seq IS NOT NULL").select("seq", "matched_seq", "sim").distinct()
    return found.filter("matched_seq IS NULL").select(*cols).unionByName(alone), lost


def _walker(metric: str):
    """The walk over sorted batches of steps. It is local, so it ships to executors that do not
    have this package. Rows of one number do not see each other."""
    score, limit = scorer(metric), SAME_SIGNATURE
    title_weight, location_weight = TITLE_WEIGHT, LOCATION_WEIGHT
    out = pa.schema([("seq", pa.int64()), *[(c, pa.string()) for c in ("cls", "t", "l", "signature")],
                     ("matched_seq", pa.int64()), ("sim", pa.float64())])

    def alike(t: str, l: str, old_t: str, old_l: str) -> float:
        """The similarity, or 0 if the lengths of the titles alone keep it from the limit."""
        total = len(t) + len(old_t)
        if total and 2 * min(len(t), len(old_t)) / total * title_weight + location_weight < limit - 1e-6:
            return 0.0
        return score(t, old_t) * title_weight + score(l, old_l) * location_weight

    def walk(batches):
        part = at = None
        near_of, refused, last, fresh, known = {}, {}, {}, {}, {}
        for batch in batches:
            found = []
            for here, seq, step, cls, t, l, sig, contested, near in zip(*batch.to_pydict().values()):
                if here != part:
                    part, at = here, None
                    near_of, refused, last, fresh, known = {}, {}, {}, {}, {}
                if seq != at:
                    at = seq
                    last.update(fresh)
                    fresh = {}
                if step == 0:
                    last[sig] = (seq, cls, t, l)
                    continue
                if step == 1:
                    near_of[cls] = near
                    continue
                since = refused.get(cls)
                if since is not None and since[0] < seq or since == (seq, cls):
                    continue
                before = last.get(sig) if contested else None
                if before is not None:
                    sim = known.get((cls, before[1]))
                    if sim is None:
                        if len(known) > 100_000:
                            known.clear()
                        sim = known[cls, before[1]] = alike(t, l, before[2], before[3])
                    if sim > limit:
                        found.append((seq, cls, t, l, sig, before[0], sim))
                        continue
                found.append((seq, cls, t, l, sig, None, None))
                refused[cls] = (seq, cls)
                for other in near_of.pop(cls, ()):
                    refused.setdefault(other, (seq, None))
                fresh[sig] = max(fresh.get(sig, (seq, "")), (seq, cls, t, l))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(out), out)], schema=out)

    return walk


def _settle_chains(window: DataFrame, near: DataFrame, kept_before: DataFrame | None, metric: str):
    """What is left of the window, and the verdicts of all rows of contested signatures on
    which nothing but the last accepted one bears: no class of them has a near edge or a
    second row here. Such a signature, unless it is long, is settled as a whole."""
    cols = ["seq", "cls", "t", "l", "signature"]
    rows = window.filter("contested").select(*cols)
    touched = near.select(F.col("new").alias("cls")).union(near.select(F.col("old").alias("cls"))).union(
        window.groupBy("cls").agg(F.count("*").alias("_n")).filter("_n > 1").select("cls")).distinct()
    mixed = rows.join(touched, "cls", "left_semi").select("signature").union(
        rows.groupBy("signature").agg(F.count("*").alias("_n")).filter(F.col("_n") > CHAIN_ROWS).select("signature"))
    quiet = cut(rows.join(mixed.distinct(), "signature", "left_anti"))
    if quiet.isEmpty():
        return window, None, None
    heads = quiet.select("signature").distinct()
    members = quiet.select(*cols)
    if kept_before is not None:
        starts = kept_before.join(heads, "signature", "left_semi").groupBy("signature").agg(
            F.max(F.struct("seq", "cls", "t", "l")).alias("s"))
        members = members.unionByName(starts.select("s.seq", "s.cls", "s.t", "s.l", "signature"))
    members = cut(members)
    nodes = members.select("signature", "cls", "seq")
    pairs = cut(signature_edges(members, metric).join(nodes.withColumnRenamed("cls", "new"), ["signature", "new"])
                .join(nodes.toDF("signature", "old", "p_seq"), ["signature", "old"]).filter("p_seq < seq")
                .select(F.col("seq").alias("node"), F.col("p_seq").alias("blocker"), "sim"))
    found = cut(chain_select(nodes.select(F.col("signature").alias("key"), F.col("seq").alias("node"),
                                          F.col("seq").alias("ord")), pairs))
    kept = cut(quiet.join(found.filter("kept").select(F.col("node").alias("seq")), "seq", "left_semi").select(*cols))
    lost = cut(found.filter("not kept").join(pairs, ["node", "blocker"]).select(
        F.col("node").alias("seq"), F.col("blocker").alias("matched_seq"), "sim"))
    return cut(window.join(quiet.select("seq"), "seq", "left_anti").select(*window.columns)), kept, lost


def _verdicts(prepared: DataFrame, kept: DataFrame, links: DataFrame, dup_lost: DataFrame) -> DataFrame:
    """Earliest accepted article each rejected one matches, joined back."""
    accepted = kept.select(F.col("seq").alias("k_seq"), F.col("cls").alias("k_cls"),
                           F.col("signature").alias("k_signature"))
    reach = links.join(accepted, links["old"] == accepted["k_cls"]).select(
        F.col("new").alias("cls"), "k_seq", "k_signature", "sim").unionByName(
        accepted.select(F.col("k_cls").alias("cls"), "k_seq", "k_signature", F.lit(1.0).alias("sim")))
    # classes reach few accepted articles, so the earliest one per class nearly
    # always serves; a row before it takes the same-signature match instead
    best = reach.groupBy("cls").agg(F.min(F.struct("k_seq", "k_signature", "sim")).alias("m"))
    lost = dup_lost.select("seq", F.col("matched_seq").alias("d_seq"), F.col("sim").alias("d_sim"))
    joined = prepared.join(best, "cls", "left").join(lost, "seq", "left")
    near = F.col("m").isNotNull() & (F.col("m.k_seq") < F.col("seq"))
    # a row may be refused by its signature before the earlier row that is near to it is accepted
    joined = joined.withColumn("d_seq", F.when(~F.coalesce(near, F.lit(False)), F.col("d_seq")))
    status = (
        F.when(F.col("recap_dropped"), "recap")
        .when(F.col("d_seq").isNotNull(), "duplicate")
        .when(near, F.when(F.col("m.k_signature") == F.col("signature"), "duplicate").otherwise("near_duplicate"))
        .otherwise("accepted")
    )
    out = joined.withColumn("status", status)
    matched = F.col("status").isin("duplicate", "near_duplicate")
    return (
        out.withColumn("matched_seq", F.when(matched, F.coalesce("d_seq", "m.k_seq")))
        .withColumn("matched_seq", F.when(F.col("matched_seq") < 0, F.col("matched_seq") + BEFORE_ALL)
                    .otherwise(F.col("matched_seq")))
        .withColumn("similarity", F.when(matched, F.when(F.col("d_seq").isNotNull(), F.col("d_sim")).otherwise(F.col("m.sim"))))
        .drop("m", "d_seq", "d_sim", "t", "l", "cls")
    )


def accepted_articles(verdicts: DataFrame, as_of: str) -> DataFrame:
    """Accepted rows with the metadata stored next to each incident."""
    return confidence(verdicts.filter(F.col("status") == "accepted"), as_of, "published")


def rejected_articles(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("status") != "accepted").withColumn("reason", F.col("status"))
