"""Best-two-fit packing of token sequences.

A document is its BPE ids and an end id.  One of more than ``capacity`` tokens is cut into full
pieces behind a first, shorter one; every piece is then packed whole.  What decides a packing is
only how many pieces there are of each length, so the plan is made on that histogram, of at most
``capacity`` rows however large the corpus is: bins that would be filled alike are one pattern with
a multiplicity.  Spark numbers the pieces of each length, and a piece's number leads to its
pattern, bin and offset.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm import bpe
from rangeloom.llm.common import blob, pieces, require, shared_folder

CAPACITY = 1024
END = 2


def cut_lengths(n: int, capacity: int) -> np.ndarray:
    """Lengths of the pieces of a document of ``n`` tokens: the first may be shorter, the others are full."""
    full, first = divmod(n, capacity)
    return np.array([first] * (first > 0) + [capacity] * full, np.int64)


def fill(available: list[int], left: Counter, capacity: int) -> Counter:
    """The lengths of one bin: greedy by falling length, then best-two-fit.

    ``available`` has the lengths with a count in ``left``, rising.  When nothing fits any more, the
    smallest piece of the bin gives way to two unpacked pieces whose sum is larger and fits the
    gap that its removal leaves; of such pairs the one with the largest sum is taken, then
    the one with the larger first piece.  A bin that is full has no gap to mend.
    """
    took: Counter = Counter()
    gap = capacity
    at = bisect_right(available, gap) - 1
    while gap and at >= 0:
        length = available[at]
        n = min(left[length], gap // length)
        if n:
            took[length] += n
            gap -= n * length
        at = min(at - 1, bisect_right(available, gap) - 1)
    if not gap or not took:
        return took
    small = min(took)
    room, best = gap + small, (small, 0, 0)
    low, high = 0, bisect_right(available, room) - 1
    spare = {x: left[x] - took[x] for x in available[: high + 1]}
    while low <= high:  # the two ends of the lengths close in on the largest sum within the room
        a, b = available[low], available[high]
        if a + b > room or not spare[b]:
            high -= 1
        elif not spare[a]:
            low += 1
        else:
            if (low < high or spare[a] > 1) and a + b > best[0]:
                best = (a + b, b, a)
            low += 1
    if best[1]:
        took[small] -= 1
        took[best[1]] += 1
        took[best[2]] += 1
    return +took


@dataclass
class Plan:
    """Where pieces go, by length and number: parallel arrays sorted by (length, first number)."""

    length: np.ndarray
    first: np.ndarray  # number of the first piece of the row
    each: np.ndarray  # pieces of this length in a bin of the pattern
    bin: np.ndarray  # first bin of the pattern
    offset: np.ndarray  # where this length begins in the bin
    bins: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of pieces by length and number within it."""
        scale = int(max(self.first.max(initial=0), number.max(initial=0))) + 1
        at = np.searchsorted(self.length * scale + self.first, length * scale + number, side="right") - 1
        nth = number - self.first[at]
        return self.bin[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns for a histogram of lengths from 1 to ``capacity``.

    Every pattern is used as often as the counts allow before its choices could change.  A
    length that runs short for a pattern can serve it no more, so there are at most about
    ``capacity * ln(capacity)`` patterns, of at most ``sqrt(2 * capacity)`` lengths each.
    """
    left = Counter({k: v for k, v in counts.items() if v})
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError(f"a length is outside 1 to {capacity}")
    available = sorted(left)
    used: Counter = Counter()
    rows, bins = [], 0
    while available:
        took = fill(available, left, capacity)
        times = min(left[x] // n for x, n in took.items())
        offset = 0
        for length in sorted(took, reverse=True):
            rows.append((length, used[length], took[length], bins, offset))
            used[length] += took[length] * times
            left[length] -= took[length] * times
            offset += took[length] * length
            if not left[length]:
                available.remove(length)
        bins += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*(table[:, i].copy() for i in range(5)), bins)


def cut_documents(df: DataFrame, vocabulary: bpe.Vocabulary, key: str, text: str, capacity: int, end: int | None, ids: bool) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, the ids if asked for, and ``_row``, a number
    that spreads even the pieces of equal keys."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, _row long" + ", ids array<int>" * ids
    tail = np.array([] if end is None else [end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(vocabulary)
        done = 0
        for part in pieces(batches, "t", bpe.PIECE_BYTES):
            encoded = encoder.encode([t.decode() for t in part.column("t").to_pylist()])
            owner, piece, start, length, crc, values = [], [], [], [], [], []
            for i, e in enumerate(encoded):
                raw = np.concatenate([e.astype("<u4"), tail])
                lengths = cut_lengths(len(raw), capacity)
                ends = np.cumsum(lengths)
                for j, (n, stop) in enumerate(zip(lengths.tolist(), ends.tolist(), strict=True)):
                    owner.append(i)
                    piece.append(j)
                    start.append(stop - n)
                    length.append(n)
                    crc.append(zlib.crc32(raw[stop - n : stop].tobytes()))
                    if ids:
                        values.append(raw[stop - n : stop].astype(np.int32))
            out = {
                key: part.column("k").take(pa.array(owner, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "_row": pa.array(np.arange(done, done + len(owner))),
            }
            if ids:
                out["ids"] = pa.array(values, pa.list_(pa.int32()))
            done += len(owner)
            yield pa.RecordBatch.from_pydict(out)

    return df.select(F.col(f"`{key}`").alias("k"), blob(text).alias("t")).mapInArrow(run, schema)


def number_pieces(cut: DataFrame, key: str) -> DataFrame:
    """``cut`` with ``_number``, gapless from 0 within each length.

    The pieces of a length are dealt into as many buckets as there are shuffle partitions; a
    bucket's offset is the sum of the counts before it, so no task orders a whole length.
    """
    buckets = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("_row", F.col(f"`{key}`"), "piece"), F.lit(buckets)))
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("length").alias("_length"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(*[F.col(f"`{c}`") for c in (key, "piece", "start", "ids_crc32", "_row")])
    numbered = dealt.withColumn("_nth", F.row_number().over(within) - 1)
    joined = numbered.join(sums, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_of")))
    return joined.withColumn("_number", F.col("_nth") + F.col("_before")).drop("_bucket", "_of", "_length", "_before", "_nth", "_row")


def pack(df: DataFrame, vocabulary: bpe.Vocabulary, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int | None = END, ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``key``, ``piece`` (int from 0), ``start`` (its document's tokens before
    it), ``length``, ``ids_crc32`` (of little-endian unsigned 32-bit ids), ``ids`` if asked for,
    ``sequence_id`` and ``offset``, gapless from 0 in every sequence.  A null or empty text is its end
    id alone; with ``end=None`` it has no piece.  Repeated rows and null keys are packed like any
    others, an empty table gives an empty result, further columns of ``df`` are ignored.

    The texts are encoded once; pieces are kept in the session's shared folder, so that a
    lost executor repeats no encoding and numbers stay what the plan was made for.
    """
    require(df, key, text)
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    cut_documents(df, vocabulary, key, text, capacity, end, ids).write.parquet(folder)
    cut = spark.read.parquet(folder)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    made = plan(counts, capacity)
    numbered = number_pieces(cut, key)
    kept = [c for c in numbered.columns if c != "_number"]
    schema = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_number"))
            if len(length):
                at, offset = made.place(length, number)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(at), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of ``pack(..., ids=True)``: sequence_id, their ids in order, and the pieces' lengths; a group
    holds no more than a sequence's tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths"))
