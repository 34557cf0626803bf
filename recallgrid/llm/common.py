"""Small helpers that every training-data operator uses."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks over which the rows of one key spread in a salted join.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session of one machine, as in tests, gets a folder of its own where none is named: other executors could not read it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="checkpoint-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.  Checkpoints are files, so a lost executor loses nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut(), as a Parquet table that goes when the driver's session ends.

    A checkpoint keeps the size that the optimizer had estimated; over rounds of joins these estimates multiply to numbers of millions
    of digits.  A table has its own size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def salted(rows: DataFrame, side: DataFrame, key: str, *by: str) -> DataFrame:
    """``rows`` joined with ``side``, which has one row a key: the rows of a key spread by columns ``by`` over SALTS tasks.

    Neither side is broadcast: Spark sizes what comes after an explode, as ``side`` here and often ``rows``, as if a row gave one row.
    """
    each = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(each, [key, "__salt"]).drop("__salt")


def small(df: DataFrame, most: int) -> DataFrame:
    """Mark a written table for broadcast if it has at most ``most`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def rounds(batch: pa.RecordBatch, name: str, most: int = 2_000_000, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of column ``name`` and at most ``rows`` rows; a longer text is a slice of its own."""
    size = np.cumsum(pc.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        done = size[first - 1] if first else 0
        after = min(max(first + 1, int(np.searchsorted(size, done + most, "right"))), first + rows, batch.num_rows)
        yield batch.slice(first, after - first)
        first = after


def release_memory() -> None:
    """Give this process's freed memory back to the system: what large arrays have left would else stay with a driver or a worker that is used again."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # a system without glibc
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(*names: str) -> Column:
    """A key of a row's content.  Joins on it also compare doc_id, so only rows of one doc_id could ever meet by chance."""
    return F.xxhash64(*[F.col(n) for n in names])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
