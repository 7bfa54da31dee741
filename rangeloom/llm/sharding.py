"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in source blocks.  For every block the number of its rows that go to each shard
is drawn from the multivariate hypergeometric law, so that the matrix is distributed as
under a uniform random permutation of all rows and its column sums are the exact shard
sizes.  Rows are then permuted inside their block, dealt out along the block's row of the
matrix, exchanged, and permuted again inside the shard.  Only the matrix (blocks x shards,
bounded) is on the driver; texts are read once and never shuffled.
"""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.llm.common import cut, free_name, require

#: Source partitions are folded into so many blocks at most: bounds the matrix.
MAX_BLOCKS = 8_192
#: Slices of a shard in its second permutation, each ordered by one task: as many as keep a
#: slice at about so many rows, within bounds.
SLICE_ROWS, LEAST_SLICES, MOST_SLICES = 2_000_000, 16, 16_384


def _stirling_error(n: int) -> float:
    """log(n!) less Stirling's formula, to full precision at any size."""
    if n < 16:
        return math.log(math.factorial(n)) - (0.5 * math.log(2 * math.pi * n) + n * math.log(n) - n) if n else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / m) / m) / m) / n


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation near the mean."""
    d = x - mean
    if abs(d) < 0.1 * (x + mean):
        v = d / (x + mean)
        total, term, j = d * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return total
            total, j = more, j + 1
    return x * math.log(x / mean) + mean - x


def _binomial(x: int, n: int, p: float) -> float:
    """Binomial probability by deviances, accurate for any counts."""
    if x == 0 or x == n:
        return math.exp(n * (math.log1p(-p) if x == 0 else math.log(p))) if n else 1.0
    log = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return math.exp(log) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def probability(x: int, good: int, bad: int, draws: int) -> float:
    """Hypergeometric probability of ``x`` good ones, to about 1e-12 relative at any counts."""
    p = draws / (good + bad)
    if p in (0.0, 1.0):
        return 1.0
    return _binomial(x, good, p) * _binomial(draws - x, bad, p) / _binomial(draws, good + bad, p)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Draw the good ones among ``draws`` out of good + bad, by inversion in double precision.

    It walks outwards from the mode; the expected walk is of the order of the standard
    deviation, whatever the counts.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, ((draws + 1) * (good + 1)) // (good + bad + 2)))
    p_mode = probability(mode, good, bad, draws)
    u = rng.random() - p_mode
    if u < 0:
        return mode
    down = up = p_mode
    i = j = mode
    while i > low or j < high:
        if j < high:
            up *= (good - j) * (draws - j) / ((j + 1) * (bad - draws + j + 1))
            j += 1
            u -= up
            if u < 0:
                return j
        if i > low:
            down *= i * (bad - draws + i) / ((good - i + 1) * (draws - i + 1))
            i -= 1
            u -= down
            if u < 0:
                return i
    return mode  # what rounding leaves over


def communication_matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each block for each shard; shard sizes differ by one at most."""
    rng = random.Random(seed)
    total = sum(blocks)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in blocks:
        row, rest, open_ = [], n, sum(left)
        for s in range(shards):
            open_ -= left[s]
            got = hypergeometric(rng, left[s], open_, rest)
            row.append(got)
            rest -= got
            left[s] -= got
        matrix.append(row)
    return matrix


def shard(df: DataFrame, shards: int = 40, seed: int = 0, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``df`` with ``_shard`` (0 to shards - 1) and ``_slot`` (gapless from 0 in its shard).

    Every assignment of rows to places is equally likely; shard sizes differ by one at
    most.  ``df`` is materialised, so pass keys and measures, not texts.  Repeated rows and
    null keys take places of their own; an empty frame stays empty.  Where ``df`` has a
    column of a result's name, the result has one more underscore in front.  A block is
    ordered by one task: ``max_blocks`` keeps it at rows / blocks, 1.2e7 rows of 1e11.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    row = F.monotonically_increasing_id()
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # one column, so that no name can clash
    rows = cut(
        df.select(
            whole.alias("row"),
            F.pmod(F.spark_partition_id(), F.lit(max_blocks)).alias("block"),
            F.xxhash64(F.lit(seed), row).alias("first"),
            F.xxhash64(F.lit(seed + 1), row).alias("second"),
        )
    )
    sizes = {b: n for b, n in rows.groupBy("block").count().collect()}  # max_blocks rows at most
    blocks = sorted(sizes)
    slices = min(MOST_SLICES, max(LEAST_SLICES, -(-sum(sizes.values()) // shards // SLICE_ROWS)))
    matrix = communication_matrix([sizes[b] for b in blocks], shards, seed)
    dealt = json.dumps([{"b": b, "ends": list(accumulate(counts))} for b, counts in zip(blocks, matrix, strict=True)])
    rows_of_plan = F.explode(F.from_json(F.lit(dealt), "array<struct<b:int,ends:array<bigint>>>")).alias("p")
    plan = F.broadcast(df.sparkSession.range(1).select(rows_of_plan).select("p.*"))  # max_blocks x shards longs at most
    local = Window.partitionBy("block").orderBy("first", "second")
    placed = rows.withColumn("place", F.row_number().over(local)).join(plan, F.col("block") == F.col("b"))
    # The first shard whose running total reaches the row's place in its block.
    target = F.size(F.filter("ends", lambda e: e < F.col("place")))
    slice_ = F.pmod(F.shiftright("second", 40), F.lit(slices)).cast("int")
    sent = cut(placed.select("row", target.alias("shard"), slice_.alias("slice"), "second", "first"))
    counts = sent.groupBy(F.col("shard").alias("s"), F.col("slice").alias("i")).count()
    before = Window.partitionBy("s").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select("s", "i", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")))  # shards x MOST_SLICES rows at most
    inside = Window.partitionBy("shard", "slice").orderBy("second", "first")
    ordered = sent.withColumn("n", F.row_number().over(inside))
    out = ordered.join(offsets, (F.col("shard") == F.col("s")) & (F.col("slice") == F.col("i")))
    return out.select("row.*", F.col("shard").alias(free_name(df, "_shard")), (F.col("offset") + F.col("n") - 1).cast("long").alias(free_name(df, "_slot")))


def describe(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32): UTF-8 bytes plus 16, and the unsigned CRC-32; null counts as empty.

    Null keys and repeated rows each have a row.
    """
    require(df, key, text)
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.select(F.col(key), (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
