"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Limits the bytes of an Arrow batch, in Spark 64 MB, and what it is here.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def build_session(app: str = "vigilake", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of about ``BATCH_BYTES``, unless the session names a limit.

    A task holds a batch in the JVM, outside its heap, and in its Python worker, and neither gives
    all of that back; by Spark's limits 10,000 long texts are one batch.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, else (local
    runs and tests, where driver and executors share one disk) a new temp one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    current = spark.conf.get("vigilake.local.dir", None)
    if current is None:
        current = tempfile.mkdtemp(prefix="vigilake-")
        spark.conf.set("vigilake.local.dir", current)
    return current


def fresh_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage and drop its lineage, so that a
    lost executor costs one re-read instead of a replay of every round."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
