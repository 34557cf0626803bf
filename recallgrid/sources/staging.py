"""Tables that a job writes for itself, where every executor finds them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in that which the cluster names in ``spark.checkpoint.dir``, removed when the driver's session ends.

    A session of one machine, as in tests, gets a folder of its own where none is named; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    folder = f"{(named or tempfile.mkdtemp(prefix='tables-')).rstrip('/')}/{context.applicationId}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """``df``, written and read again: what several parts of a query use is made once, and a lost executor loses nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
