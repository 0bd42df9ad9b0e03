"""User reports: statistics, hidden incidents and the sequential report rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions import dims, lexicons as lex
from vigilake.operators.enrich import fingerprint


def judge_reports(reports: DataFrame, salts: int = 16) -> DataFrame:
    """Outcome of every report under the arrival rule: unknown reasons are
    refused, a device counts once per incident, an incident is hidden at five
    accepted reports and refuses what comes later.

    Only the first report per device can be accepted, and of those only the
    first five per incident, so each incident is settled from at most five rows:
    the first report per (incident, device) is an aggregation, the five earliest
    per incident are taken per salt first. No incident is gathered in one group.
    """
    order = F.struct("ts", "seq")
    marked = fingerprint(reports).withColumn("valid", F.col("reason").isin(list(lex.REPORT_REASONS)))
    firsts = marked.filter("valid").groupBy("incident_id", "fingerprint").agg(F.min(order).alias("first"))
    salted = firsts.withColumn("_salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)))
    inner = Window.partitionBy("incident_id", "_salt").orderBy("first")
    outer = Window.partitionBy("incident_id").orderBy("first")
    earliest = (
        salted.withColumn("_rn", F.row_number().over(inner)).filter(F.col("_rn") <= lex.HIDE_AT_REPORTS)
        .withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= lex.HIDE_AT_REPORTS)
        .select("incident_id", "fingerprint", "first", "rank")
    )
    hidden = earliest.filter(F.col("rank") == lex.HIDE_AT_REPORTS).select(
        "incident_id", F.col("first").alias("hidden_from"))
    judged = (
        marked.withColumn("_at", order)
        .join(earliest.select("incident_id", "fingerprint", "first", "rank"), ["incident_id", "fingerprint"], "left")
        .join(hidden, "incident_id", "left")
    )
    verdict = (
        F.when(~F.col("valid"), "invalid_reason")
        .when(F.col("hidden_from").isNotNull() & (F.col("_at") > F.col("hidden_from")), "under_review")
        .when(F.col("first") == F.col("_at"), F.when(F.col("rank") == lex.HIDE_AT_REPORTS, "accepted_hidden")
              .otherwise("accepted"))
        .otherwise("already_reported")
    )
    return judged.withColumn("verdict", verdict).drop("_at", "first", "rank", "hidden_from", "valid")


def accepted_reports(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("verdict").startswith("accepted"))


def report_status(accepted: DataFrame) -> DataFrame:
    """Per incident: reports, whether hidden, reports left until hidden."""
    return accepted.groupBy("incident_id").agg(F.count("*").alias("reports")).withColumn(
        "is_hidden", F.col("reports") >= lex.HIDE_AT_REPORTS).withColumn(
        "until_hidden", F.greatest(F.lit(0).cast("bigint"), F.lit(lex.HIDE_AT_REPORTS) - F.col("reports")))


def report_reasons(accepted: DataFrame) -> DataFrame:
    """Counts per incident and reason with totals per incident, reason and overall."""
    cube = accepted.groupingSets([[], ["incident_id"], ["reason"], ["incident_id", "reason"]],
                                 "incident_id", "reason")
    return cube.agg(F.count("*").alias("n")).select(
        F.coalesce("incident_id", F.lit("*")).alias("incident_id"),
        F.coalesce("reason", F.lit("*")).alias("reason"), "n")


def hidden_ids(accepted: DataFrame, unhidden: DataFrame | None = None) -> DataFrame:
    """Incidents at or over the limit, minus those a moderator released."""
    out = report_status(accepted).filter("is_hidden").select("incident_id")
    return out if unhidden is None else out.join(unhidden.select("incident_id"), "incident_id", "left_anti")


def drop_hidden(incidents: DataFrame, hidden: DataFrame, id_col: str = "incident_id",
                exempt_government: bool = False) -> DataFrame:
    if not exempt_government:
        return incidents.join(hidden, id_col, "left_anti")
    flagged = incidents.join(hidden.withColumn("_hidden", F.lit(True)), id_col, "left")
    return flagged.filter(F.col("_hidden").isNull() | F.col("is_government")).drop("_hidden")


def newest_reports(reports: DataFrame, k: int = 10) -> DataFrame:
    labels = dims.seed_table(reports.sparkSession, list(lex.REPORT_REASONS.items()), ["reason", "reason_label"])
    newest = reports.orderBy(F.desc("ts"), F.desc("seq")).limit(k)
    return newest.join(labels, "reason", "left").withColumn(
        "reason_label", F.coalesce("reason_label", F.col("reason")))
