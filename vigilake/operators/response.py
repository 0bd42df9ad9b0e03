"""Response-timeline model: phase durations, bottlenecks, stages, fleet profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import lexicons as lex
from vigilake.functions.match import lookup, once, round_half_up

# fixed values: phase, shown name, limit, [(above, severity)], issue, recommendation
BOTTLENECK_RULES = [
    ("decide", "Decision", [(60, "critical"), (30, "high")],
     "Command authority delay — multi-level approval required",
     "Pre-authorize response protocols for known threat signatures"),
    ("observe", "Detection", [(5, "medium")],
     "Detection coverage gap — threat entered undetected",
     "Expand sensor network or ADS-B/雷达 coverage"),
    ("act", "Action", [(30, "high"), (20, "medium")],
     "Response force not optimally positioned",
     "Pre-position assets or establish faster deployment lanes"),
    ("orient", "Classification", [(20, "medium")],
     "Classification ambiguity — multiple threat vectors possible",
     "Improve AI-assisted threat classification for faster ID"),
]
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2}
# fixed values: stage texts by pattern, first match wins, last entry is the default
DETECTION_TEXTS = [
    (r"missile|ballistic|rocket", "IRST/雷达 detected ballistic trajectory. Trajectory analysis initiated."),
    (r"drone|uav", "Radar/光电 detection of unmanned aerial signature. Tracking established."),
    (r"attack|strike|raid", "Ground observer or SIGINT reported hostile action. Alert issued."),
    (None, "Multi-source detection triggered. Cross-referencing sensor data."),
]
CLASSIFICATION_TEXTS = [
    (r"houthi", "Attribution: Houthi-knownTTPs. Pattern matches previous Red Sea incidents."),
    (r"iran|irgc", "Attribution: Iranian-origin capability. Regional threat assessment initiated."),
    (r"israel|idf", "Attribution: State actor. Conventional warfare doctrine applies."),
    (None, "Threat type identified. Running signature analysis against known threat profiles."),
]
DECISION_TEXTS = {
    "critical": "Emergency authorization. Theater commander has pre-approved response protocols.",
    "high": "Rapid approval chain. Joint operations center coordinating response.",
}
DECISION_DEFAULT = "Standard ROE evaluation. Legal and political considerations being assessed."
ACTION_TEXTS = [
    (r"intercept|air.defense|missile", "Air defense assets engaged. Interceptor launched. Impact point calculated."),
    (r"drone|uav", "Counter-UAV systems activated. Electronic warfare measures deployed."),
    (r"attack|strike", "Response strike authorized. Aircraft/导弹 assets tasked. Mission planning complete."),
    (None, "Coordinated response initiated. Multiple agencies on standby."),
]
# fixed values: phase -> (participant, role, title pattern that adds it or None)
PARTICIPANTS = {
    "observe": [("Sensor Network", "Detection", None), ("Radar Systems", "Tracking", r"radar|irst|ads-b"),
                ("SATCOM", "Overhead", r"satellite")],
    "orient": [("AI Classification", "Threat ID", None), ("Intelligence Cell", "Analysis", None),
               ("Pattern Recognition", "TTP Matching", None)],
    "decide": [("Tactical Commander", "Approval", None), ("JOC", "Coordination", None),
               ("National Command", "Strategic", r"nuclear|radiological")],
    "act": [("Air Defense", "Interceptors", None), ("Strike Aircraft", "Attack", r"strike|attack"),
            ("Ground Forces", "Support", None)],
}
STAGES = [("detection", "observe"), ("classification", "orient"), ("decision", "decide"), ("action", "act")]


def _by_pattern(text: Column, rules) -> Column:
    out = None
    for pattern, value in rules:
        if pattern is None:
            return out.otherwise(F.lit(value))
        out = F.when(text.rlike(pattern), F.lit(value)) if out is None else out.when(
            text.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(1.0))


def _title() -> Column:
    return F.lower(F.coalesce("title", F.lit("")))


def response_phases(incidents: DataFrame) -> DataFrame:
    """Minutes per phase: severity base x actor modifier x threat modifier."""
    level = F.coalesce("severity", F.lit("medium"))
    row = F.when(level.isin("critical", "high"), "high").when(level == "low", "low").otherwise("medium")
    combined = F.concat(F.lower(F.coalesce("type", F.lit(""))), F.lit(" "), _title())
    out = once(incidents, _row=row, _actor=_by_pattern(_title(), lex.ACTOR_MODIFIERS),
               _threat=_by_pattern(combined, lex.THREAT_MODIFIERS))
    minutes = {}
    for phase in lex.PHASES:
        base = lookup(F.col("_row"), {k: float(v[phase]) for k, v in lex.PHASE_BASES.items()}, None)
        minutes[phase] = round_half_up(base * F.col("_actor") * F.col("_threat"))
    out = once(out, **minutes)
    total = sum((F.col(p) for p in lex.PHASES), F.lit(0))
    return out.withColumn("total_minutes", total).drop("_row", "_actor", "_threat")


def bottlenecks(phases: DataFrame) -> DataFrame:
    """Adds the bottleneck array, worst first, rule order within a severity."""
    found = []
    for pos, (phase, name, cuts, issue, advice) in enumerate(BOTTLENECK_RULES):
        minutes, level = F.col(phase), None
        for above, severity in cuts:
            level = F.when(minutes > above, severity) if level is None else level.when(minutes > above, severity)
        rank = lookup(level, SEVERITY_RANK, None)
        found.append(F.when(minutes > cuts[-1][0], F.struct(
            rank.alias("rank"), F.lit(pos).alias("pos"), F.lit(phase).alias("phase"),
            F.lit(name).alias("phase_name"), level.alias("severity"), F.lit(issue).alias("issue"),
            F.lit(advice).alias("recommendation"), minutes.alias("minutes"))))
    return once(phases, bottlenecks=F.array_sort(F.array_compact(F.array(*found))))


def response_summary(df: DataFrame) -> DataFrame:
    """Critical path, efficiency against the ideal and the worst bottleneck. A
    zero total counts as fully efficient and sequential."""
    total = F.col("total_minutes")
    share = F.when(total > 0, round_half_up(F.col("decide") * 100.0 / total)).otherwise(F.lit(0).cast("bigint"))
    efficiency = F.when(total > 0, F.least(F.lit(100).cast("bigint"), round_half_up(
        F.lit(float(lex.IDEAL_RESPONSE_MINUTES)) / total * 100.0))).otherwise(F.lit(100).cast("bigint"))
    return (
        df.withColumn("critical_path", F.when(share > 40, "DECIDE_PHASE").otherwise("SEQUENTIAL"))
        .withColumn("efficiency", efficiency)
        .withColumn("bottleneck_count", F.size("bottlenecks"))
        .withColumn("worst_phase", F.try_element_at("bottlenecks", F.lit(1))["phase"])
        .withColumn("worst_severity", F.try_element_at("bottlenecks", F.lit(1))["severity"])
    )


def response_stages(phases: DataFrame) -> DataFrame:
    """Four stage rows per incident with text, participants and fixed data."""
    title = _title()
    kind = F.lower(F.coalesce("type", F.lit("")))
    joined = F.concat(title, kind)
    level = F.coalesce("severity", F.lit("medium"))
    texts = {
        "observe": _by_pattern(joined, DETECTION_TEXTS),
        "orient": _by_pattern(title, CLASSIFICATION_TEXTS),
        "decide": lookup(level, DECISION_TEXTS, DECISION_DEFAULT),
        "act": _by_pattern(joined, ACTION_TEXTS),
    }
    detect = F.when(F.col("verification_status") == "VERIFIED", F.lit(95)).otherwise(F.lit(72))
    approval = F.when(F.col("severity") == "critical", "Immediate").otherwise("Standard")
    stages = []
    for number, (stage, phase) in enumerate(STAGES, 1):
        people = F.array_compact(F.array(*[
            F.lit(f"{who} ({role})") if pattern is None
            else F.when(title.rlike(pattern), F.lit(f"{who} ({role})"))
            for who, role, pattern in PARTICIPANTS[phase]]))
        stages.append(F.struct(
            F.lit(number).alias("stage_no"), F.lit(stage).alias("stage"), F.lit(phase).alias("phase"),
            F.col(phase).alias("minutes"), texts[phase].alias("description"), people.alias("participants"),
            (detect if phase == "observe" else F.lit(None).cast("int")).alias("detect_confidence"),
            (approval if phase == "decide" else F.lit(None).cast("string")).alias("approval_level")))
    return phases.select("id", F.explode(F.array(*stages)).alias("s")).select("id", "s.*")


def compare_responses(summaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences a - b for the (a_id, b_id) pairs asked for."""
    cols = [*lex.PHASES, "total_minutes", "efficiency"]
    a = summaries.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = summaries.select(F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return pairs.join(a, "a_id").join(b, "b_id").select(
        "a_id", "b_id", *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"delta_{c}") for c in cols])


def pair_bottlenecks(with_bottlenecks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bottlenecks of both incidents of a pair, tagged by side."""
    rows = with_bottlenecks.select("id", F.explode("bottlenecks").alias("b")).select(
        "id", "b.phase", "b.severity", "b.minutes")
    sides = [
        pairs.join(rows, pairs[f"{side}_id"] == rows["id"]).select(
            "a_id", "b_id", F.lit(side).alias("side"), "phase", "severity", "minutes")
        for side in ("a", "b")]
    return sides[0].unionByName(sides[1])


def response_profile(summaries: DataFrame, by: str) -> DataFrame:
    """Mean, median and 90th percentile of total minutes and mean efficiency per
    group; percentiles are the approximate, mergeable kind."""
    return summaries.groupBy(by).agg(
        F.count("*").alias("incidents"), F.round(F.avg("total_minutes"), 4).alias("mean_minutes"),
        F.percentile_approx("total_minutes", 0.5).alias("p50_minutes"),
        F.percentile_approx("total_minutes", 0.9).alias("p90_minutes"),
        F.round(F.avg("efficiency"), 4).alias("mean_efficiency"))


def bottleneck_frequency(with_bottlenecks: DataFrame) -> DataFrame:
    return with_bottlenecks.select(F.explode("bottlenecks").alias("b")).groupBy("b.phase", "b.severity").agg(
        F.count("*").alias("n"), F.round(F.avg("b.minutes"), 4).alias("mean_minutes"))
