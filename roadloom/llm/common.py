"""Helpers shared by the corpus operators: shared storage, checkpoints, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where nothing is set (tests, local runs) a folder of our own is made.
    """
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


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new name for a folder below the shared one, with its file system's scheme; nothing is created."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{whole.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str, compression: str = "none") -> DataFrame:
    """Write as Parquet in the shared folder and read back: smaller than a checkpoint, columns prunable.

    Hashes and ids do not compress, so no codec (and none of its native buffers) is used unless asked for.
    """
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def exact_id(column: str = "doc_id") -> list[Column]:
    """An id for a Python kernel: pandas makes doubles of a long column that holds a null, so the null is a column of its own."""
    return [F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long")).alias(column), F.col(column).isNull().alias(f"no_{column}")]


def ids_of(batch, column: str = "doc_id"):
    """The ids of a batch selected by ``exact_id``, as a pandas array of nullable 64-bit integers."""
    import pandas as pd

    return pd.arrays.IntegerArray(batch[column].to_numpy("int64").copy(), batch[f"no_{column}"].to_numpy("bool").copy())


def id_list(batch, column: str = "doc_id") -> list:
    """The same as Python integers and None."""
    return [None if null else i for i, null in zip(batch[column].tolist(), batch[f"no_{column}"].tolist())]


def nullable(values: list):
    """A pandas array of 64-bit integers and nulls, all exact."""
    import numpy as np
    import pandas as pd

    return pd.arrays.IntegerArray(np.array([0 if v is None else v for v in values], np.int64), np.array([v is None for v in values], bool))


def returned() -> None:
    """Give a worker's freed memory back to the system, where the C library can: it would else stay with the process."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
