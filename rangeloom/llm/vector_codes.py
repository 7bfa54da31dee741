"""Vector codes by product quantisation, trained by exact integer k-means with Exponion search.

Vectors become integers, ``floor(1024 * x)``, and are cut into equal parts; each part position has
a codebook.  A part's nearest entry is sought from its previous entry: with ``u`` its distance to that
entry, an entry no farther than ``u`` lies within ``2u`` of the previous one, by the triangle inequality.
So only the entries up to that radius in the previous entry's distance-sorted list are compared.
Squares of integers are compared throughout, so a bound is never off by rounding, and ties go
to the lower index.

A round is one map over the vectors and a sum per entry.  The vectors stay in the session's
shared folder with their last codes; a round writes them anew and the one before goes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import discard, require, shared_folder

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Largest magnitude of an integer component; distances of two parts then fit 64 bits.
LARGEST = 1 << 27
#: Below this magnitude products and their sums are exact in 64-bit floats, which are faster.
FLOAT_EXACT = 1 << 21
#: Values that a step of the search has in memory at once.
STEP_VALUES = 1 << 21
#: Rows of label totals up to which they are broadcast.
LABELS_BROADCAST = 100_000


class Codebook:
    """Entries of one part position with each entry's list of neighbours, nearest first."""

    def __init__(self, entries: np.ndarray):
        peak = int(np.abs(entries).max(initial=0))
        self.entries = entries.astype(np.int64)
        self.peak = peak
        gaps = np.stack([((self.entries - e) ** 2).sum(axis=1) for e in self.entries])
        self.order = np.argsort(gaps, axis=1, kind="stable")  # an entry comes first in its own list, or an equal one of lower index
        self.radius = np.take_along_axis(gaps, self.order, axis=1)

    def squares(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Exact squared distances of every row of ``x`` to every one of ``entries``."""
        if max(self.peak, int(np.abs(x).max(initial=0))) < FLOAT_EXACT and x.shape[1] <= 64:
            a, b = x.astype(np.float64), entries.astype(np.float64)
            return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
        return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)

    def search(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of each row of ``x``, searched from its entry in ``start``.

        Rows with the same start are taken together.  They are ordered by how far down the start's list
        their radius reaches, so a stretch of the list is compared with the rows that reach it.
        """
        code = start.copy()
        error = ((x - self.entries[start]) ** 2).sum(axis=1)
        by_start = np.argsort(start, kind="stable")
        cuts = np.flatnonzero(np.diff(start[by_start])) + 1
        for rows in np.split(by_start, cuts) if len(by_start) else ():
            near, radius = self.order[start[rows[0]]], self.radius[start[rows[0]]]
            reach = np.searchsorted(radius, 4 * error[rows], side="right")  # (2u)^2
            rows = rows[np.argsort(-reach, kind="stable")]
            reach = -np.sort(-reach)
            at = 0
            width = 8
            while at < len(near):
                open_rows = rows[: np.searchsorted(-reach, -at, side="left")]  # those that reach beyond ``at``
                if not len(open_rows):
                    break
                some = near[at : at + width]
                for i in range(0, len(open_rows), max(1, STEP_VALUES // max(len(some), x.shape[1]))):
                    part = open_rows[i : i + max(1, STEP_VALUES // max(len(some), x.shape[1]))]
                    by_index = np.sort(some)
                    found = self.squares(x[part], self.entries[by_index])
                    best = found.argmin(axis=1)  # the first, so the lowest index
                    value, entry = found[np.arange(len(part)), best], by_index[best]
                    better = (value < error[part]) | ((value == error[part]) & (entry < code[part]))
                    code[part[better]], error[part[better]] = entry[better], value[better]
                at += width
                width *= 2
        return code, error


def whole_numbers(column: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, integer vectors of equal size) of a list column.

    Left out are null vectors and those with a null or non-finite component, and, where ``size`` is
    given, those of another length.
    """
    present = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.drop_null()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = bad[ends] == bad[ends - lengths]
    if size is not None:
        keep &= lengths == size
    where = np.repeat(keep, lengths)
    values = np.floor(SCALE * values[where])
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}, so distances would not fit 64 bits")
    return present[keep], values.astype(np.int64)


def as_lists(values: np.ndarray, size: int) -> pa.Array:
    n = values.size // size
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(values.reshape(-1).astype(np.int32)))


def prepare(df: DataFrame, key: str, vector: str, label: str, size: int) -> DataFrame:
    """k, l, v (the integers) of the vectors that are kept."""
    schema = f"k {df.schema[key].dataType.simpleString()}, l {df.schema[label].dataType.simpleString()}, v array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = whole_numbers(batch.column(2), size)
            if len(rows):
                some = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), as_lists(values, size)], names=["k", "l", "v"])

    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("l"), F.col(f"`{vector}`").alias("v")).mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def assign(state: DataFrame, books: list[np.ndarray], sums: bool) -> DataFrame:
    """One assignment: ``state`` with new codes ``c`` and errors ``e``; with ``sums``, rows of sums beside the vectors' own.

    A row of sums has ``part``, ``entry``, ``n`` and ``total``; each task yields one for every entry it used.
    """
    size = sum(b.shape[1] for b in books)
    width = size // len(books)
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    started = "c" in kinds
    schema = f"k {kinds['k']}, l {kinds['l']}, v array<int>, c array<int>, e long, part int, entry int, n long, total array<long>"
    fields = ["k", "l", "v", "c", "e", "part", "entry", "n", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        types = None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = types or [batch.schema.field(x).type for x in ("k", "l")]
            x = _matrix(batch, "v", size)
            old = _matrix(batch, "c", len(books)) if started else np.zeros((len(x), len(books)), np.int64)
            codes, error = np.empty_like(old), np.zeros(len(x), np.int64)
            for p, book in enumerate(searched):
                part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                codes[:, p], e = book.search(part, old[:, p])
                error += e
                if sums:
                    counts[p] += np.bincount(codes[:, p], minlength=len(book.entries))
                    np.add.at(totals[p], codes[:, p], part)
            none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), as_lists(x, size), as_lists(codes, len(books)), pa.array(error), *none], names=fields)
        if sums and types:
            for p in range(len(books)):
                used = np.flatnonzero(counts[p])
                n = len(used)
                empty = [pa.nulls(n, t) for t in (*types, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())]
                total = pa.array(list(totals[p][used]), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*empty, pa.array(np.full(n, p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used]), total], names=fields)

    return state.select("k", "l", "v", *["c"] * started).mapInArrow(run, schema)


def update(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose used entries are the floored means of their parts; at most parts x entries x width sums."""
    sums = rows.where("part is not null").select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    found = sums.groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("x"), F.sum("n").alias("n"))
    new = [b.copy() for b in books]
    for r in found.collect():
        new[r["part"]][r["entry"], r["at"]] = int(r["x"]) // int(r["n"])
    return new


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(k, l, v, c, e of every kept vector; final codebooks): ``rounds`` rounds and a last assignment.

    The codebooks begin as the parts of the ``entries`` smallest keys; nulls come after all keys, equal keys in
    order of their vectors.  The size of vectors is that of the smallest key's; vectors of
    another size are left out.  A size that ``parts`` does not divide, 0 among them, is an error.
    """
    require(df, key, vector, label)
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/vector-codes-{uuid.uuid4().hex}"
    kept = F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    first = df.where(F.col(f"`{vector}`").isNotNull() & kept).orderBy(F.col(f"`{key}`").asc_nulls_last(), F.col(f"`{vector}`")).select(F.size(f"`{vector}`").alias("n")).head()
    size = first["n"] if first else parts
    if not size or size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    prepare(df, key, vector, label, size).write.parquet(f"{folder}/0")
    state = spark.read.parquet(f"{folder}/0")
    seeds = np.array([r["v"] for r in state.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()], np.int64).reshape(-1, size)
    width = size // parts
    books = [seeds[:, p * width : (p + 1) * width] for p in range(parts)]
    if not len(seeds):
        return state.select("k", "l", "v", F.array().cast("array<int>").alias("c"), F.lit(0).cast("long").alias("e")), books
    for i in range(1, rounds + 2):
        assign(state, books, sums=i <= rounds).write.parquet(f"{folder}/{i}")
        rows = spark.read.parquet(f"{folder}/{i}")
        if i <= rounds:
            books = update(rows, books)
        state = rows.where("part is null")
        discard(spark, f"{folder}/{i - 1}")
    return state.select("k", "l", "v", "c", "e"), books


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of all vectors: ``key``, ``code`` (two hex digits a part), ``error``, ``label_error``, ``codebooks_sha256``.

    A vector that is null or holds a null, NaN or infinite component is left out, as is one of another
    size than the smallest key's (see ``train``).  Repeated rows and keys each have their row, null
    labels are one label, an empty table gives an empty result, further columns are ignored.
    A component beyond 131,072 is an error, since distances would leave 64 bits.  ``entries`` is
    at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so there are 1 to 256 entries")
    state, books = train(df, key, vector, label, parts, entries, rounds)
    totals = state.groupBy("l").agg(F.sum("e").alias("label_error")).withColumnRenamed("l", "_l")
    if totals.limit(LABELS_BROADCAST + 1).count() <= LABELS_BROADCAST:
        totals = F.broadcast(totals)
    code = F.lower(F.concat_ws("", F.transform("c", lambda x: F.lpad(F.hex(x), 2, "0"))))
    out = state.select("k", "l", code.alias("code"), "e").join(totals, F.col("l").eqNullSafe(F.col("_l")))
    return out.select(F.col("k").alias(key), "code", F.col("e").alias("error"), "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: list[np.ndarray], code: str = "code") -> DataFrame:
    """``codes`` with ``vector``, the integer components of the entries that a code names; the codebooks, of at most
    parts x 256 entries, go with the plan."""
    tables = [F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books]
    entry = lambda p: F.conv(F.substring(F.col(f"`{code}`"), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[F.element_at(t, entry(p) + 1) for p, t in enumerate(tables)]))
