"""Helpers that the corpus operators share: scratch tables, checked broadcasts, text rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import spindrift.llm

# Functions that run on executors travel by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(spindrift.llm)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast only if its counted rows are at most this many.
BROADCAST_ROWS = 1_000_000
#: Keys that hold more than this part of all rows, of which there can't be more than this many, are told to all tasks.
MANY = 500_000
#: Bytes of an Arrow batch of whole texts: a task holds a few of them beside each other, in the JVM and in Python.
BATCH_BYTES = 4 << 20
BATCH_SETTING, USUAL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def trim() -> None:
    """Gives freed memory back to the system; idle Python workers would keep it."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """A function of batches that gives its memory back when a task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow for rows with whole texts: in batches of ``BATCH_BYTES`` (set on the session where it has Spark's usual value), with memory given back."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, USUAL_BATCH) == USUAL_BATCH:
        conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(frugal(run), schema)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.  Where it is unset, a temporary one if the driver is all there is (tests), else an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spindrift-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI, resolved as Spark resolves it, so that tasks that open files find what Spark wrote."""
    if "://" in path or path.startswith("file:"):
        return path
    store = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"{store.rstrip('/')}{os.path.abspath(path)}" if not store.startswith("file:") else f"file://{os.path.abspath(path)}"


def place(uri: str):
    """The file system and path of a URI; a bare path is local."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if its counted rows are within the bound; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df


def left_join(left: DataFrame, right: DataFrame, key: str, bound: int | None = None) -> DataFrame:
    """left with the columns of right (one row a key) where the key has any.

    Few rows of right (counted) are broadcast.  Beyond that the keys that hold more than the ``MANY``-th part of
    left's rows are, and the others are shuffled; rows with a null key never are.
    """
    bound = BROADCAST_ROWS if bound is None else bound
    if right.count() <= bound:
        return left.join(F.broadcast(right), key, "left")
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__m"))
    hot = counts.where(F.col("__m") > left.count() // MANY).select(key)
    hot = F.broadcast(materialise(right.join(F.broadcast(hot), key, "left_semi"), "hot"))
    some = left.where(F.col(key).isNotNull())
    shuffled = some.join(hot, key, "left_anti").join(right, key, "left")
    return some.join(hot, key).unionByName(shuffled).unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone.

    lower() does the same, and faster, on texts in which no other character has a lower case.
    """
    other = r"[[\p{Lu}\p{Lt}Ⅰ-ⅯⒶ-Ⓩ]&&[^A-Z]]"
    return F.when(text.rlike(other), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))

