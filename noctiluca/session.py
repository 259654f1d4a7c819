"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 32 << 20


def session(app: str = "noctiluca", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes: UTC, ANSI, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=settings | {k.replace("__", "."): str(v) for k, v in conf.items()}).getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors share one machine, so that a folder of that machine is shared by all."""
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir. Only on a single machine (tests, a laptop) a temporary one is made
    where none is set; on a cluster each executor would write to its own disk, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="noctiluca-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder below the one that all executors share."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Arrow batches end at ``most`` bytes as well as at their number of records, so that a task with very long texts
    holds a bounded part of them at a time. A smaller bound that the session already has stays."""
    if int(spark.conf.get(BATCH_SETTING, str(2**31 - 1))) > most:
        spark.conf.set(BATCH_SETTING, str(most))


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many parts as there are cores, for work in Python that costs far more than moving its input.

    Only a plan without a shuffle that has fewer parts than cores is dealt out (a few small files, or a single row group
    that can't be split); what comes out of a shuffle or in more parts stays as it is."""
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        df.explain()
    if "AdaptiveSparkPlan" in plan.getvalue():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
