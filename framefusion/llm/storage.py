"""Intermediate tables in the folder that all executors share, and sides of joins that may be small."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. A local session that names none (tests) gets a temporary folder; on a cluster each
    machine would write to its own disk, so there the setting must be made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: computed once, whatever executor is lost later."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/framefusion/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(side: DataFrame, rows: int = 50_000) -> DataFrame:
    """Mark a join side for broadcast after counting that it has at most `rows` rows; a larger one is shuffled."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side
