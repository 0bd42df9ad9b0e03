"""Structured Streaming forms of the continuous jobs. Every function takes a
streaming (or batch) DataFrame and returns one; ``run_to_parquet`` drains the
available input into files and returns them as a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilake.functions import lexicons as lex
from vigilake.operators.enrich import fingerprint, signature
from vigilake.operators.filters import active_notams
from vigilake.operators.screening import screen_articles
from vigilake.session import fresh_path

LATENESS = "72 hours"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file or folder as a stream, with the stored schema. The name is
    given as a glob, because a plain path must be a folder here."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{{{name}}}")


def with_event_time(df: DataFrame, col: str = "published", lateness: str = LATENESS) -> DataFrame:
    """Watermarked event time; rows older than the bound are dropped as late."""
    return df.withColumn("event_time", F.col(col).cast("timestamp")).withWatermark("event_time", lateness)


def drain(df: DataFrame, out: str, state: str, mode: str = "append") -> None:
    """Process what is available now; a later call with the same folders goes on from there."""
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", out)
    else:
        # full result of each trigger replaces the one before
        query = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    query.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def run_to_parquet(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process what is available now, then read the sink back."""
    spark = df.sparkSession
    out = fresh_path(spark, f"{label}-out")
    drain(df, out, fresh_path(spark, f"{label}-state"), mode)
    return spark.read.schema(df.schema).parquet(out)


def drain_changes(df: DataFrame, out: str, state: str) -> None:
    """Process what is available now in update mode: each trigger adds a folder with
    the rows that changed; a replayed trigger overwrites its own."""
    (df.writeStream.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/trigger={i}"))
     .outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())


def newest_change(changes: DataFrame, key: str) -> DataFrame:
    """The row of the last trigger per ``key``, from rows with a ``trigger`` column."""
    rest = [c for c in changes.columns if c not in (key, "trigger")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), "trigger").alias("_row")).select(key, "_row.*")


def run_upserts(df: DataFrame, label: str, key: str) -> DataFrame:
    """Process what is available now and read back the newest row per ``key``."""
    spark = df.sparkSession
    out = fresh_path(spark, f"{label}-out")
    drain_changes(df, out, fresh_path(spark, f"{label}-state"))
    schema = T.StructType([*df.schema.fields, T.StructField("trigger", T.LongType())])
    return newest_change(spark.read.schema(schema).parquet(out), key)


def run_arrivals(arrivals: list[DataFrame], transform: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """The stream of several arrivals, each landing after the one before was processed; read back as one batch."""
    spark = arrivals[0].sparkSession
    landing, out, state = (fresh_path(spark, f"{label}-{part}") for part in ("in", "out", "state"))
    for rows in arrivals:
        rows.write.mode("append").parquet(landing)
        stream = transform(spark.readStream.schema(rows.schema).parquet(landing))
        drain(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)


# --- dedup ------------------------------------------------------------------

def distinct_signatures(articles: DataFrame) -> DataFrame:
    """First article per signature within the lateness bound."""
    return with_event_time(signature(articles)).dropDuplicatesWithinWatermark(["signature"])


def screen_batch(batch: DataFrame, batch_id: int, accepted_path: str, verdict_path: str,
                 metric: str = "ratio") -> None:
    """foreachBatch body: screen a micro-batch against everything accepted in
    other batches. Both outputs are partitioned by batch id and overwritten, so a
    replayed batch writes the same files again."""
    spark = batch.sparkSession
    cols = ["seq", "title", "location", "date", "source", "content", "published"]
    # every batch leaves a folder, an empty one too, so only the first finds none
    history = spark.read.parquet(accepted_path).filter(F.col("batch_id") < batch_id).select(*cols) if batch_id else None
    verdicts = screen_articles(batch.select(*cols), history, metric)
    verdicts = verdicts.persist()
    verdicts.filter(F.col("status") == "accepted").select(*cols).write.mode("overwrite").parquet(
        f"{accepted_path}/batch_id={batch_id}")
    verdicts.select("seq", "status", "matched_seq", "similarity").write.mode("overwrite").parquet(
        f"{verdict_path}/batch_id={batch_id}")
    verdicts.unpersist()


def screen_stream(articles: DataFrame, label: str = "screen", metric: str = "ratio") -> DataFrame:
    spark = articles.sparkSession
    accepted, verdicts = fresh_path(spark, f"{label}-accepted"), fresh_path(spark, f"{label}-verdicts")
    query = (
        articles.writeStream.foreachBatch(lambda b, i: screen_batch(b, i, accepted, verdicts, metric))
        .option("checkpointLocation", fresh_path(spark, f"{label}-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(verdicts)


# --- windows ----------------------------------------------------------------

def tumbling_counts(incidents: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts per window and severity."""
    return (
        with_event_time(incidents).groupBy(F.window("event_time", width), F.coalesce(
            "severity", F.lit("medium")).alias("severity_level")).agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "severity_level", "n")
    )


def sliding_counts(incidents: DataFrame, width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Counts per type over a sliding window. Keep width/slide small: every row
    is counted once per open window (use a 1-day slide for 7 and 30 days)."""
    return (
        with_event_time(incidents).groupBy(F.window("event_time", width, slide), "type").agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "type", "n")
    )


def session_counts(visits: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return (
        with_event_time(visits, "ts").groupBy("user_id", F.session_window("event_time", gap)).agg(
            F.count("*").alias("visits"))
        .select(F.col("user_id").alias("visitor"), F.col("session_window.start").alias("started"), "visits")
    )


def latest_positions(states: DataFrame) -> DataFrame:
    """Newest position per craft (update mode; ``run_upserts`` keeps the newest row per craft)."""
    return states.groupBy("icao24").agg(F.max_by(F.struct("lat", "lon", "ts"), F.struct("ts", "lat", "lon")).alias(
        "p")).select("icao24", "p.*")


def active_notices(notams: DataFrame, as_of: str) -> DataFrame:
    return active_notams(notams, as_of)


# --- moderation -------------------------------------------------------------

_VERDICT_SCHEMA = ("incident_id string, seq bigint, verdict string, reports int, is_hidden boolean")


def report_processor() -> StatefulProcessor:
    """Per incident: devices that reported, the accepted count and the hidden
    flag. A hidden incident refuses reports, so its state stops growing at five
    devices plus those added after a moderator released it. The class is local,
    so it ships to executors that do not have this package."""
    reasons, limit = frozenset(lex.REPORT_REASONS), lex.HIDE_AT_REPORTS

    class ReportState(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.devices = handle.getMapState("devices", "fingerprint string", "seq bigint")
            self.summary = handle.getValueState("summary", "reports int, hidden boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            count, hidden = self.summary.get() if self.summary.exists() else (0, False)
            pieces = [p for p in rows if len(p)]
            if not pieces:
                return
            out = []
            for row in pd.concat(pieces).sort_values(["ts", "seq"]).itertuples(index=False):
                if row.action == "unhide":
                    verdict, hidden = ("released" if hidden else "not_hidden"), False
                elif row.reason not in reasons:
                    verdict = "invalid_reason"
                elif hidden:
                    verdict = "under_review"
                elif self.devices.containsKey((row.fingerprint,)):
                    verdict = "already_reported"
                else:
                    self.devices.updateValue((row.fingerprint,), (row.seq,))
                    count += 1
                    hidden = count >= limit
                    verdict = "accepted_hidden" if hidden else "accepted"
                out.append((key[0], row.seq, verdict, count, hidden))
            self.summary.update((count, hidden))
            yield pd.DataFrame(out, columns=["incident_id", "seq", "verdict", "reports", "is_hidden"])

        def close(self) -> None:
            pass

    return ReportState()


def moderate(reports: DataFrame) -> DataFrame:
    """Keyed moderation state over a stream of reports (and 'unhide' actions)."""
    reports.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    marked = fingerprint(reports)
    if "action" not in marked.columns:
        marked = marked.withColumn("action", F.lit("report"))
    rows = marked.select("incident_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "reason", "fingerprint", "action")
    return rows.groupBy("incident_id").transformWithStateInPandas(
        report_processor(), outputStructType=_VERDICT_SCHEMA, outputMode="append", timeMode="none")
