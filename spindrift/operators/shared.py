"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; where it is unset a temporary one serves a local driver, else it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="spindrift-"))
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: About how many rows a task sorts or groups at most.
ROWS_A_TASK = 1_000_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many partitions rows take so that none has many more than ``ROWS_A_TASK``: the session's number, or more where that doesn't do."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to the partitions that so many rows take; windows and groups by these keys, or by them and more, then shuffle nothing."""
    return df.repartition(tasks_for(df.sparkSession, rows), *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many parts, even or by keys, as the session has partitions or tasks at once, for costly rows that stand in few files."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def stored(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df computed once, as columns in the shared folder: a fraction of what ``stored`` takes where rows are many."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
