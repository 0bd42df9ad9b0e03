"""Sequence mining and scenario scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions import dims
from vigilake.functions.match import lookup, round_half_up
from vigilake.operators.enrich import actor_action
from vigilake.session import cut

#: Bins of a follow-up frame, events of one chunk, and looking events of one bin that one salt holds.
SLICES = 8
ROWS_PER_CHUNK = 2_000
ROWS_PER_SALT = 16_000


def _country(df: DataFrame) -> DataFrame:
    return df.withColumn("country", F.coalesce("country", F.lit("Unknown")))


def actor_action_patterns(df: DataFrame) -> DataFrame:
    """Counts per actor, action and country."""
    return _pattern_counts(actor_action(_country(df)))


def _pattern_counts(found: DataFrame) -> DataFrame:
    return found.filter(F.col("actor").isNotNull()).groupBy("actor", "action", "country").agg(F.count("*").alias("n"))


def country_patterns(df: DataFrame) -> DataFrame:
    """Per country: rows, and counts per type and per severity."""
    level = F.coalesce("severity", F.lit("low"))
    rows = _country(df).withColumn("severity", level)
    grouped = rows.groupingSets([["country"], ["country", "type"], ["country", "severity"]],
                                "country", "type", "severity").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"))
    return (grouped.withColumn("facet", lookup(F.col("_g"), {3: "total", 1: "type", 2: "severity"}, None))
            .withColumn("label", F.coalesce("type", "severity", F.lit("all")))
            .select("country", "facet", "label", "n"))


def followups(events: DataFrame, frame: str = "72h") -> DataFrame:
    """Pairs (event, later event of the same country within the frame). Pairs
    are the feature here; for counts use ``followup_outcomes``, which never
    lists them. Time is cut into bins, ``SLICES`` to a frame; each event looks at
    its own bin and the frame's next ones, so the join is an equi join on (country,
    bin) and few pairs outside the frame meet. A crowded bin is dealt out over
    salts: each looking event goes to one of them, each followed one to all. Events of
    a bin are sent as chunks, one row of arrays, and opened where they meet: an event that is
    sent many times costs its time and its id, not a row with keys."""
    span = dims.FRAME_SECONDS[frame]
    width = span * 1_000_000 // SLICES
    rows = _country(events).select("id", "country", "type", F.unix_micros(
        F.col("published").cast("timestamp")).alias("us")).filter("us IS NOT NULL").withColumn(
        "bin", F.expr(f"us div {width}"))
    crowd = cut(rows.groupBy("country", "bin").agg(F.count("*").alias("n")))
    pieces = crowd.select("country", "bin", F.ceil(F.col("n") / F.lit(ROWS_PER_CHUNK)).cast("int").alias("chunks"))
    chunks = cut(
        rows.join(pieces, ["country", "bin"]).withColumn("chunk", F.pmod(F.xxhash64("id", "us"), "chunks").cast("int"))
        .groupBy("country", "bin", "chunk").agg(F.collect_list(F.struct("us", "id", "type")).alias("all"))
        .select("country", "bin", "chunk", "all.us", "all.id", "all.type"))
    ahead = F.explode(F.sequence(F.col("bin"), F.col("bin") + SLICES)).alias("bin")
    sized = crowd.select("country", "n", ahead).groupBy("country", "bin").agg(
        F.ceil(F.sum("n") / F.lit(ROWS_PER_SALT)).cast("int").alias("salts"))
    left = chunks.select("country", ahead, "us", "id", "type", F.xxhash64("bin", "chunk").alias("dealt")).join(
        sized, ["country", "bin"]).withColumn("salt", F.pmod("dealt", "salts").cast("int"))
    right = chunks.join(sized, ["country", "bin"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    # a fixed partition count: the pairs grow faster than the bytes, so partitions merged by size would be uneven
    keys = ["country", "bin", "salt"]
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def opened(df: DataFrame, side: str) -> DataFrame:
        sent = df.select(*keys, "us", "id", "type").repartition(parts, *keys)
        return sent.select(*keys, "id", "type", F.posexplode("us").alias("at", f"{side}_us")).select(
            *keys, f"{side}_us", F.get("id", F.col("at")).alias(f"{side}_id"), F.get("type", F.col("at")).alias(f"{side}_type"))

    later = (F.col("b_us") > F.col("a_us")) | ((F.col("b_us") == F.col("a_us")) & (F.col("b_id") > F.col("a_id")))
    return opened(left, "a").join(opened(right, "b").hint("merge"), keys).filter(
        later & (F.col("b_us") - F.col("a_us") <= span * 1_000_000)
    ).select("a_id", "b_id", "country", "a_type", "b_type")


def followup_outcomes(events: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """How often each type follows each type in the same country within 24 h,
    72 h and 7 days, with the number of triggers and their ratio in percent.

    No event pairs are listed. With C(t) = events of the next type up to time t,
    a trigger at u has C(u + frame) - C(u) followers. Each trigger therefore
    probes C at its own time and at the three frame ends. C splits into a prefix
    over time buckets, summed per bucket, and a running count inside the probe's
    bucket, so the widest window group is one bucket of one country and type. The
    events are read once: five narrow columns are kept for the branches.
    """
    span = bucket_seconds * 1_000_000
    rows = cut(_country(events).select(
        "country", "type", "id", F.unix_micros(F.col("published").cast("timestamp")).alias("at")
    ).withColumn("b", F.floor(F.col("at") / F.lit(span))))
    triggers = rows.groupBy("country", F.col("type").alias("trigger_type")).agg(F.count("*").alias("triggers"))

    ends = [("start", 0), *dims.FRAME_SECONDS.items()]
    probes = rows.select("country", F.col("type").alias("trigger_type"), F.explode(F.array(*[
        F.struct(F.lit(frame).alias("frame"), (F.col("at") + F.lit(sec * 1_000_000)).alias("at"),
                 (F.col("id") if frame == "start" else F.lit(2**63 - 1)).alias("tie"))
        for frame, sec in ends])).alias("p")).select("country", "trigger_type", "p.*").withColumn(
        "b", F.floor(F.col("at") / F.lit(span)))

    # part 1: everything in earlier buckets
    per_bucket = rows.groupBy("country", F.col("type").alias("next_type"), "b").agg(F.count("*").alias("n"))
    probe_counts = probes.groupBy("country", "trigger_type", "frame", "b").agg(F.count("*").alias("probes"))
    kinds = triggers.select("country", F.col("trigger_type").alias("next_type"))
    points = probe_counts.select("country", "b").distinct().join(kinds, "country").withColumn("n", F.lit(0))
    prefix = (
        per_bucket.unionByName(points).groupBy("country", "next_type", "b").agg(F.sum("n").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(
            Window.partitionBy("country", "next_type").orderBy("b")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("country", "next_type", "b", "before")
    )
    keys = ["country", "trigger_type", "frame", "next_type"]
    whole = probe_counts.join(prefix, ["country", "b"]).groupBy(*keys).agg(
        F.sum(F.col("probes") * F.col("before")).alias("c"))

    # part 2: the probe's own bucket, by running count
    here = per_bucket.select("country", "b", "next_type")
    merged = rows.select("country", "b", F.col("type").alias("next_type"), "at", F.col("id").alias("tie"),
                         F.lit(0).alias("is_probe"), F.lit(None).cast("string").alias("trigger_type"),
                         F.lit(None).cast("string").alias("frame")).unionByName(
        probes.join(here, ["country", "b"]).select("country", "b", "next_type", "at", "tie",
                                                   F.lit(1).alias("is_probe"), "trigger_type", "frame"))
    running = F.sum(1 - F.col("is_probe")).over(
        Window.partitionBy("country", "b", "next_type").orderBy("at", "tie", "is_probe")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = merged.withColumn("c", running).filter(F.col("is_probe") == 1).groupBy(*keys).agg(
        F.sum("c").alias("c"))

    reached = whole.unionByName(inside).groupBy("country", "trigger_type", "next_type").pivot(
        "frame", [f for f, _ in ends]).agg(F.sum("c"))
    frames = F.array(*[F.struct(F.lit(f).alias("frame"), (
        F.coalesce(F.col(f), F.lit(0)) - F.coalesce("start", F.lit(0))).alias("followups"))
        for f in dims.FRAME_SECONDS])
    return (
        reached.withColumn("f", F.explode(frames)).select("country", "trigger_type", "next_type", "f.*")
        .filter(F.col("followups") > 0).join(triggers, ["country", "trigger_type"])
        .withColumn("followups_per_trigger_pct", round_half_up(F.col("followups") * 100.0 / F.col("triggers")))
    )


# --- trends -----------------------------------------------------------------

def daily_frequency(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_format("published", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def _escalated(days: DataFrame) -> DataFrame:
    """``incidents, days, escalation_pct`` from one row of ``incidents`` and sorted ``_days``."""
    def total(part):
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, d: a + d["n"])

    size = F.size("_days")
    early = total(F.slice("_days", 1, 3))
    late = total(F.slice("_days", F.greatest(F.lit(1), size - 2), 3))
    rate = F.when((size >= 6) & (early > 0), F.round((late - early) * 100.0 / early, 1)).otherwise(F.lit(0.0))
    return days.withColumn("days", size).withColumn("escalation_pct", rate).drop("_days")


def escalation(df: DataFrame) -> DataFrame:
    """Last three days against the first three, in percent, when at least six
    days have data; otherwise zero. One row."""
    days = F.array_sort(F.collect_list(F.struct("day", "n")))  # one entry per calendar day
    return _escalated(daily_frequency(df).agg(F.sum("n").alias("incidents"), days.alias("_days")))


def activity_trends(df: DataFrame) -> DataFrame:
    """Most active actor, most targeted country, dominant type, escalation. One
    row, from one pass: counts per actor, country, type and day are grouping sets."""
    sets = ["actor", "country", "type", "day"]
    rows = actor_action(_country(df)).withColumn("day", F.date_format("published", "yyyy-MM-dd"))
    counts = rows.select(*sets).groupingSets([[c] for c in sets], *sets).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"))
    whole = 2 ** len(sets) - 1

    def of(name: str):  # the grouping id has a zero bit where the column is grouped
        return F.col("_g") == whole - 2 ** (len(sets) - 1 - sets.index(name))

    def leading(name: str):
        order = F.when(of(name) & F.col(name).isNotNull(), F.struct(-F.col("n"), F.col(name)))
        return F.coalesce(F.min_by(F.col(name), order), F.lit("Unknown"))

    days = F.array_sort(F.collect_list(F.when(of("day"), F.struct("day", "n"))))
    return _escalated(counts.agg(
        F.sum(F.when(of("day"), F.col("n"))).alias("incidents"), days.alias("_days"),
        leading("actor").alias("most_active_actor"), leading("country").alias("most_targeted_country"),
        leading("type").alias("dominant_type"))).withColumn("daily_avg", F.round(F.col("incidents") / 14.0, 1))


# --- scenarios --------------------------------------------------------------

def predict(scenarios: DataFrame, incidents: DataFrame, rules: DataFrame | None = None,
            k: int = 6) -> DataFrame:
    """Ranked outcomes for many scenarios (scenario_id, actor, action, country) at
    once: escalation alert, regional response, follow-up events and the rule
    table, deduplicated per category and outcome, best ``k`` per scenario.
    ``incidents`` should already be cut to the look-back window."""
    spark = scenarios.sparkSession
    scenarios = cut(scenarios)  # five branches read it
    incidents = cut(actor_action(_country(incidents)).select(  # so do three of these
        "id", "country", "type", "published", "actor", "action"))
    if rules is None:
        rules = dims.seed_table(spark, [(*r, i) for i, r in enumerate(dims.ACTION_RULES)], [
            "action", "category", "outcome", "probability", "timeframe", "confidence", "pos"])
    fallback = dims.seed_table(spark, [(*r, i) for i, r in enumerate(dims.FALLBACK_RULES)], [
        "category", "outcome", "probability", "timeframe", "confidence", "pos"])
    cols = ["scenario_id", "category", "outcome", "probability", "timeframe", "confidence", "pos"]

    def shaped(df: DataFrame, pos) -> DataFrame:
        return df.withColumn("probability", F.col("probability").cast("double")).withColumn("pos", pos).select(*cols)

    rate = escalation(incidents).filter(F.col("escalation_pct") > 10)
    alert = shaped(scenarios.join(F.broadcast(rate)).select(  # at most one row
        "scenario_id", F.lit("Escalation Alert").alias("category"),
        F.concat(F.lit("Activity up "), F.col("escalation_pct").cast("string"),
                 F.lit("% in last 3 days")).alias("outcome"),
        F.least(F.lit(50.0) + F.col("escalation_pct"), F.lit(90.0)).alias("probability"),
        F.lit("Next 48-72 hours").alias("timeframe"),
        F.concat(F.lit("Based on "), F.col("incidents").cast("string"), F.lit(" recent incidents")).alias("confidence"),
    ), F.lit(0))

    seen = _pattern_counts(incidents)
    order = Window.partitionBy("actor", "action").orderBy(F.desc("n"), F.asc("country"))
    leaders = seen.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= 3).groupBy(
        "actor", "action").agg(F.max("n").alias("top_n"), F.array_sort(
            F.collect_list(F.struct("rn", F.upper("country").alias("c")))).alias("cs"))
    regional = shaped(scenarios.join(leaders, ["actor", "action"]).select(
        "scenario_id", F.lit("Regional Response").alias("category"),
        F.concat(F.lit("Escalation likely in "), F.array_join(F.col("cs.c"), ", ")).alias("outcome"),
        F.least(F.lit(60) + F.col("top_n") * 5, F.lit(95)).alias("probability"),
        F.lit("24-72 hours").alias("timeframe"),
        F.lit("Based on historical patterns").alias("confidence")), F.lit(1))

    outcomes = followup_outcomes(incidents)
    best = Window.partitionBy("country", "trigger_type", "frame").orderBy(F.desc("followups"), F.asc("next_type"))
    nexts = outcomes.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= 2)
    pretty = F.coalesce(lookup(F.col("next_type"), dims.TYPE_NAMES, None),
                        F.initcap(F.replace(F.col("next_type"), F.lit("_"), F.lit(" "))))
    rank = lookup(F.col("frame"), {f: i for i, f in enumerate(dims.FRAME_SECONDS)}, 0)
    follow = scenarios.join(nexts, (scenarios["country"] == nexts["country"])
                            & (scenarios["action"] == nexts["trigger_type"])).select(
        "scenario_id", F.lit("Follow-up Event").alias("category"),
        F.concat(pretty, F.lit(" activity")).alias("outcome"),
        F.col("followups_per_trigger_pct").alias("probability"),
        lookup(F.col("frame"), dims.FRAME_NAMES, None).alias("timeframe"),
        F.concat(F.col("followups").cast("string"), F.lit(" of "), F.col("triggers").cast("string"),
                 F.lit(" similar events")).alias("confidence"),
        (F.lit(10) + rank * 2 + F.col("rn")).alias("pos"))
    follow = shaped(follow, F.col("pos"))

    ruled = shaped(scenarios.join(rules, "action"), F.lit(100) + F.col("pos"))
    unruled = scenarios.join(rules.select("action").distinct(), "action", "left_anti")
    fell = shaped(unruled.join(F.broadcast(fallback)), F.lit(100) + F.col("pos"))  # two-row rule list

    everything = alert.unionByName(regional).unionByName(follow).unionByName(ruled).unionByName(fell)
    first = everything.groupBy("scenario_id", "category", "outcome").agg(
        F.min_by(F.struct("probability", "timeframe", "confidence", "pos"),
                 F.struct(-F.col("probability"), F.col("pos"))).alias("best"))
    ranked = Window.partitionBy("scenario_id").orderBy(F.desc("probability"), F.asc("pos"))
    return (first.select("scenario_id", "category", "outcome", "best.*")
            .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).drop("pos"))


def scenarios_seen(incidents: DataFrame) -> DataFrame:
    """Every (actor, action, country) the incidents show, as scenarios."""
    return actor_action_patterns(incidents).select(
        F.concat_ws("|", "actor", "action", "country").alias("scenario_id"), "actor", "action", "country")


def scenario_places(incidents: DataFrame, countries: DataFrame, targets: DataFrame) -> DataFrame:
    """Every choice of country and target a scenario may name (both fixed lists of
    a few rows), with the incidents seen in the country."""
    seen = incidents.groupBy(F.lower(F.replace("country", F.lit(" Arabia"), F.lit(""))).alias("country")).agg(
        F.count("*").alias("incidents"))
    choices = countries.withColumn("_list", F.lit(0)).join(targets.withColumn("_list", F.lit(0)), "_list").drop("_list")
    return choices.join(seen, "country", "left").withColumn("incidents", F.coalesce("incidents", F.lit(0)))
