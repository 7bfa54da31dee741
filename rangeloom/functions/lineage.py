"""Cutting lineage in iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read from there.

    A local session without that setting uses a temporary folder, deleted at exit; on a cluster it
    is an error, as executors would not share such a folder.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not named:
            _OWN.append(named := tempfile.mkdtemp(prefix="rangeloom-rounds-"))
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
