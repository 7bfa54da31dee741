"""Token counts as delta-maintained rollups.

A batch of changes is reduced to signed totals by source, language and tokenizer version:
an insert adds its count, a delete takes it back, a revision does both.  Each batch is
written once, into a folder of its own; an entry in the log commits it.  The entry holds a
digest of the batch's totals, so a batch that is delivered again changes nothing, a batch
that broke off is written anew, and another batch under a used id is refused.  Totals are
sums over the last compaction and the batches after it and never read a document again.
Files are reached through Spark's readers and writers only.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.llm.common import cut, require

GROUP = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
LOG = "id string, folder string, digest string, covers array<string>"


def word_count(text: str = "text") -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", -1), "")).cast("long")


def change_feed(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Changes between two states with (key, source, lang, tokenizer, n_tokens).

    Returns action (insert, delete or revise), both images as ``old_*`` and plain columns.
    Null keys and tokenizers are values like any other.  A key and tokenizer that occurs
    several times in a state is paired by the order of (source, lang, n_tokens), so equal
    repeats cancel and one more or less is one insert or delete.  Empty states give no changes.
    """
    cols = ["source", "lang", "n_tokens"]
    place = F.row_number().over(Window.partitionBy(key, "tokenizer").orderBy(*cols))
    b = before.withColumn("_m", place).select(F.col(key).alias("_k"), F.col("tokenizer").alias("_t"), F.col("_m").alias("_o"), *[F.col(c).alias(f"old_{c}") for c in cols], F.lit(True).alias("_was"))
    a = after.withColumn("_n", place).select(key, "tokenizer", "_n", *cols, F.lit(True).alias("_is"))
    both = a.join(b, F.col(key).eqNullSafe(F.col("_k")) & F.col("tokenizer").eqNullSafe(F.col("_t")) & (F.col("_n") == F.col("_o")), "full")
    same = F.lit(True)
    for c in cols:
        same &= F.col(c).eqNullSafe(F.col(f"old_{c}"))
    action = F.when(F.col("_was").isNull(), "insert").when(F.col("_is").isNull(), "delete").when(~same, "revise")
    return both.select(
        action.alias("action"), F.coalesce(F.col(key), F.col("_k")).alias(key), F.coalesce("tokenizer", "_t").alias("tokenizer"), *cols, *[f"old_{c}" for c in cols]
    ).where("action is not null")


def signed(changes: DataFrame) -> DataFrame:
    """Signed totals of a batch of changes by source, language and tokenizer version.

    An insert needs the plain columns, a delete the ``old_*`` ones, a revision both.  A null
    count counts as 0 tokens; null sources and languages form groups of their own.
    """
    require(changes, "action", "tokenizer", "source", "lang", "n_tokens")
    if "old_n_tokens" not in changes.columns:
        changes = changes.select("*", F.lit(None).cast("string").alias("old_source"), F.lit(None).cast("string").alias("old_lang"), F.lit(None).cast("long").alias("old_n_tokens"))
    image = lambda sign, p: F.struct(F.lit(sign).alias("s"), F.col(f"{p}source").alias("source"), F.col(f"{p}lang").alias("lang"), F.coalesce(F.col(f"{p}n_tokens").cast("long"), F.lit(0)).alias("n"))
    add, take = image(1, ""), image(-1, "old_")
    images = F.when(F.col("action") == "insert", F.array(add)).when(F.col("action") == "delete", F.array(take)).when(F.col("action") == "revise", F.array(take, add)).otherwise(F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit("null")))))
    rows = changes.select("tokenizer", F.explode(images).alias("x"))
    totals = rows.groupBy(F.col("x.source").alias("source"), F.col("x.lang").alias("lang"), "tokenizer")
    return totals.agg(F.sum("x.s").cast("long").alias("n_docs"), F.sum(F.col("x.s") * F.col("x.n")).alias("n_tokens"))


def digest(totals: DataFrame) -> str:
    """A digest of signed totals that does not depend on their order."""
    row = totals.agg(F.count("*"), F.sum(F.xxhash64(*GROUP, "n_docs", "n_tokens").cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}"


class TokenRollup:
    """Rollup state in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> list:
        """Log entries; one small file a commit until the next compaction of the log."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _enter(self, id_: str, folder: str, digest_: str, covers: list[str]) -> None:
        self.spark.createDataFrame([(id_, folder, digest_, covers)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it is committed already.

        A committed id with other signed totals raises ValueError.  An empty batch is
        committed like any other and changes nothing.
        """
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"not a batch id: {batch!r}")
        totals = cut(signed(changes))
        now = digest(totals)
        known = {r.id: r.digest for r in self._log()}
        if batch in known:
            if known[batch] != now:
                raise ValueError(f"batch {batch} is committed with other content")
            return False
        totals.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        self._enter(batch, f"batch={batch}", now, [])
        return True

    def batches(self) -> list[str]:
        """Ids of the committed batches, compacted ones included."""
        return sorted(r.id for r in self._log() if r.folder.startswith("batch="))

    def _live(self) -> list[str]:
        """Folders that make up the totals: batches and compactions that no compaction covers."""
        log = self._log()
        covered = {f for r in log for f in r.covers}
        return sorted({r.folder for r in log} - covered)

    def compact(self) -> int:
        """Fold all batches into one folder; returns how many folders it replaced.

        The old folders stay, so readers that began earlier are not disturbed, and ids keep
        their digests.  A compaction that broke off has no entry and is not seen.
        """
        live = self._live()
        if len(live) < 2:
            return 0
        name = f"total={uuid.uuid4().hex}"
        self._sum(live).write.mode("overwrite").parquet(f"{self.path}/{name}")
        self._enter(name, name, "", live)
        return len(live)

    def _sum(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])
        out = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where("n_docs != 0 or n_tokens != 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; emptied groups vanish."""
        live = self._live()
        return self._sum(live) if live else self.spark.createDataFrame([], SCHEMA)
