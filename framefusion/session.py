"""Session settings the operators are tuned for."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "framefusion", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context: scans and processors run functions that import it there, whatever folder
    the driver was started in."""
    context = spark.sparkContext
    if getattr(context, "_framefusion_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "framefusion.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("framefusion", os.path.relpath(path, top)))
    context.addPyFile(archive)
    context._framefusion_shipped = True


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints, if it names one."""
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the cluster's checkpoint folder; `fallback` is for sessions (tests) that name none."""
    folder = checkpoint_dir(spark)
    if folder is None:
        folder = fallback
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint a result that several later steps read, so that a scan runs once and a lost executor costs little.

    The folder is the session's checkpoint folder or the one named by `spark.checkpoint.dir`. A local session without
    either gets a temporary folder; on a cluster without either the plan is returned as it is.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = checkpoint_dir(spark)
        if folder is None and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="spark-")
        if folder is None:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint()


def store_step(df: DataFrame) -> DataFrame:
    """`cut_lineage` for a large step: Parquet packs repeated values and lets each later step read its own columns."""
    context = df.sparkSession.sparkContext
    folder = checkpoint_dir(df.sparkSession) or context.getCheckpointDir()
    if folder is None and context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/framefusion/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
