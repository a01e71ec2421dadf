"""Cutting lineage: a frame written to the shared folder and read back, so that plans stay small and losses cost little."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame


#: Files of at most this size are broadcast. Prepared addresses shrink to a twentieth as Parquet, and the planner takes a file's
#: size for that of its rows: at Spark's 10 MB it would send hundreds of MB through the driver.
BROADCAST = 256 << 10


def small_methods(spark) -> None:
    """Has the session run plans step by step whose generated methods the JVM would not compile, as scores are."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def small_broadcasts(spark) -> None:
    """Keeps the session's threshold for broadcasts at BROADCAST or what it is, if less."""
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST))


def cut(df: DataFrame, spread: bool = False) -> DataFrame:
    """The same rows from a table in spark.checkpoint.dir, which goes when the driver's file systems close.

    ``spread`` deals the rows evenly to twice as many files as there are cores: for rows that each lead to much work,
    whose bytes say little about it. Where the setting is unset and driver and executors are one process (tests), a temporary folder; on a cluster it must be set.
    """
    spark = df.sparkSession
    small_broadcasts(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), f"waymark-cut-{os.getpid()}")
        os.makedirs(root, exist_ok=True)
    path = f"{root}/cut-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    (df.repartition(2 * spark.sparkContext.defaultParallelism) if spread else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
