"""Checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; a folder of our own only where it is unset."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="roadloom-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise where every executor can read it, and cut the lineage of an iteration."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: much smaller than a checkpoint, and only the columns that are used are read."""
    spark = df.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    whole = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    path = f"{whole.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
