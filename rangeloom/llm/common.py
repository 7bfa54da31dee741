"""Helpers shared by the operators: lineage cuts, Arrow batches, word tables."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between the JVM and Python, where the session says nothing else.
BATCH_BYTES = 8_000_000


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, so that long texts cannot fill a worker; a setting made before stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder; also bounds the session's Arrow batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder.

    The folder is the one named by ``spark.checkpoint.dir``; see ``shared_folder``.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a temporary folder stands in if the session is local (tests, a
    notebook) and is deleted at exit; on a cluster the call fails, as executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="rangeloom-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def require(df: DataFrame, *columns: str) -> None:
    """Fail early, on the driver, when a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the frame has {df.columns}")


def pieces(batches: Iterator[pa.RecordBatch], column: str | int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that each holds about ``max_bytes`` of ``column``.

    A single row is never split: a longer text makes a piece of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for i, length in enumerate(lengths):
            if size and size + length > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += length
        yield batch.slice(start, n - start)


def blob(column: str) -> F.Column:
    """A text column as UTF-8 bytes, null as empty: what the Arrow kernels read."""
    return F.coalesce(F.col(f"`{column}`"), F.lit("")).cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with further underscores in front where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A key of over 1 / HOT_SHARE of all rows is looked up by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 10_000


def salted_lookup(rows: DataFrame, where: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` left-joined with ``where``, which is unique by ``key`` and says in ``count`` how
    many rows each key has.

    Keys of over a ten-thousandth of all rows, fewer than ten thousand by necessity, are
    looked up by broadcast, so their rows stay where they are; the others are shuffled.
    """
    where = cut(where.withColumnRenamed(key, "_at"))
    total = where.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > total
    near = F.broadcast(where.where(hot).select(F.col("_at").alias("_hot")))
    marked = rows.join(near, F.col(key) == F.col("_hot"), "left")
    few = marked.where("_hot is not null").drop("_hot").join(F.broadcast(where.where(hot)), F.col(key) == F.col("_at"))
    rest = marked.where("_hot is null").drop("_hot").join(where.where(~hot), F.col(key) == F.col("_at"), "left")
    return few.unionByName(rest).drop("_at", count)


#: Every byte that is not a word byte becomes a space, A-Z become a-z; bytes from 0x80 stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def ascii_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return data.translate(WORD_BYTES).split()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and checkpoints that nothing refers to any more.

    The cleaner acts when the driver's JVM collects garbage, which an idle driver may not do for long;
    between the phases of one job that is disk held for nothing.
    """
    gc.collect()
    spark._jvm.System.gc()
