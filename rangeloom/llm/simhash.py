"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.  The
Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints.  For a Hamming radius ``r`` one of the two halves (16 segments, 32 bits) is
within Manhattan distance ``r // 2``; both fingerprints then lie within half of that of a
common grid point, so the range join is an equi-join over grid points.  Inside a grid
point a pair must first pass the Manhattan bound over both halves, then the popcount.

Copies collapse before the join (one row per distinct fingerprint), and grid points emit
spanning links rather than all pairs, so a group of near copies costs rows in proportion
to its size.  A grid point of over ``SPLIT`` fingerprints is dealt anew by pieces of the
half that it leaves open, one of which two fingerprints within the radius share, so no
task holds an unbounded point.  Only fingerprints, never texts, are shuffled.

``near_copies`` is the same search for texts of a given similarity on word shingles.
There a pair may lie beyond any small radius, so several fingerprints over the distinct
words of a text are searched, and the texts that meet a neighbour are compared on their
whole shingle sets (``similar``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm import similar
from rangeloom.llm.common import blob, cut, pieces, require, salted_lookup
from rangeloom.llm.components import components
from rangeloom.llm.grid import SEGMENTS, Groups, grid_points, manhattan, segment_counts

PIECE_BYTES = 4_000_000
#: A shingle list of a long text is hashed and counted in blocks of this many rows.
BLOCK = 65_536
#: A grid point of more fingerprints is dealt anew over several tasks.
SPLIT = 100_000


def majority(hashes: np.ndarray) -> bytes:
    """Bits that are set in over half of the hashes, (n, 8) bytes, most significant first."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprint(data: bytes, k: int, seed: int = 42) -> bytes:
    """SimHash of UTF-8 text as 8 bytes, most significant bit first."""
    words = data.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    ends = ends[min(k, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    return majority(np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=False)]), np.uint8).reshape(-1, 8))


def word_prints(data: bytes, prints: int) -> bytes:
    """``prints`` SimHashes, 8 bytes each, over the distinct words of a text."""
    words = sorted({*data.lower().split()})
    if not words:
        return bytes(8 * prints)
    digest = xxhash.xxh64_digest
    return b"".join(majority(np.frombuffer(b"".join([digest(w, seed) for w in words]), np.uint8).reshape(-1, 8)) for seed in range(prints))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """(key, fingerprint long) of every row: A-Z lower-cased, words between ASCII white
    space, all k-word shingles with repeats (fewer words: the whole sequence), bit set if
    set in over half of the XXH64 hashes.  Null, empty and blank texts have fingerprint 0;
    repeated rows and null keys each have theirs; an empty frame gives an empty one.
    """
    require(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1, PIECE_BYTES):
            raw = b"".join(fingerprint(t, k) for t in part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=[key, "fingerprint"])

    return df.select(F.col(f"`{key}`").alias("k"), blob(text).alias("t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint long")


def link_point(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of the distinct fingerprints of one grid point.

    Stars first: a pivot takes all within the radius.  Then members of a star are held
    against what is not yet joined to it; a star that is met is joined by one link, and
    its own members are still held against the rest in its turn.
    """
    u = fp.astype(np.uint64)
    counts = segment_counts(fp).reshape(len(fp), -1).astype(np.int8)

    def near_of(rows: np.ndarray, one: int) -> np.ndarray:
        ok = np.abs(counts[rows] - counts[one]).sum(axis=1, dtype=np.int64) <= radius
        ok[ok] = np.bitwise_count(u[rows[ok]] ^ u[one]) <= radius
        return ok

    star = np.full(len(u), -1)
    pivots: list[int] = []
    links: list[tuple[int, int]] = []
    rest = np.arange(len(u))
    while len(rest):
        near = near_of(rest, rest[0])
        mine = rest[near]
        star[mine] = len(pivots)
        pivots.append(int(rest[0]))
        links += [(int(fp[rest[0]]), int(fp[i])) for i in mine[1:]]
        rest = rest[~near]
    if len(pivots) == 1:
        return links
    order = np.argsort(star, kind="stable")
    bounds = np.searchsorted(star[order], np.arange(len(pivots) + 1))
    for s in range(len(pivots) - 1):
        later = order[bounds[s + 1] :]
        for member in order[bounds[s] : bounds[s + 1]]:
            if not len(later):
                break
            hit = later[near_of(later, member)]
            if len(hit):
                met, first = np.unique(star[hit], return_index=True)
                links += [(int(fp[member]), int(fp[i])) for i in hit[first]]
                later = later[~np.isin(star[later], met)]
    return links


#: Grid points of up to so many fingerprints are handled together, all shifts at once.
SMALL_POINT = 16


def link_rows(point: np.ndarray, fp: np.ndarray, radius: int) -> set[tuple[int, int]]:
    """Spanning links inside each grid point of rows that are sorted by point."""
    found: set[tuple[int, int]] = set()
    new = np.concatenate([[True], point[1:] != point[:-1]])
    size = np.diff(np.append(np.flatnonzero(new), len(point)))
    each = np.repeat(size, size)
    some = (each > 1) & (each <= SMALL_POINT)
    p, f = point[some], fp[some]
    for shift in range(1, SMALL_POINT):
        same = np.flatnonzero(p[shift:] == p[:-shift])
        if not len(same):
            break
        a, b = f[same], f[same + shift]
        bound = manhattan(a, b) <= radius
        a, b = a[bound], b[bound]
        close = np.bitwise_count(a.astype(np.uint64) ^ b.astype(np.uint64)) <= radius
        found.update(zip(a[close].tolist(), b[close].tolist(), strict=True))
    large = size > SMALL_POINT
    for start, n in zip(np.flatnonzero(new)[large].tolist(), size[large].tolist(), strict=True):
        found.update(link_point(fp[start : start + n], radius))
    return found


def split_keys(fp: np.ndarray, point: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) by which a large point is dealt anew: the half it leaves open is cut into
    ``radius`` + 1 pieces, one of which is equal in any two fingerprints within the radius."""
    low = point < 3**SEGMENTS  # points of the first half, the low 32 bits; the high ones are open
    u = fp.astype(np.uint64)
    half = np.where(low, u >> np.uint64(32), u & np.uint64(0xFFFFFFFF))
    edges = np.linspace(0, 32, radius + 2).astype(int)
    rows, keys = [], []
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        piece = (half >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1)
        rows.append(np.arange(len(fp)))
        keys.append((point * 64 + i << 12) ^ piece.astype(np.int64))  # keys that coincide only share a task
    return np.concatenate(rows), np.concatenate(keys)


def links(prints: DataFrame, radius: int = 4, key: str = "fingerprint") -> DataFrame:
    """Distinct links (u, v) that join every two fingerprints at ``radius`` or fewer bits.

    Links span: fingerprints are connected by them exactly when they are connected by
    pairs within the radius.  ``prints`` must hold distinct fingerprints; none gives no links.
    """
    reach = -(-(radius // 2) // 2)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), 20_000):
                rows, points = grid_points(fp[i : i + 20_000], reach)
                yield pa.RecordBatch.from_pydict({"point": pa.array(points), "fp": pa.array(fp[i : i + 20_000][rows])})

    def rows_of(large: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"large": pa.array(np.full(len(a), large)), "u": pa.array(a), "v": pa.array(b)})

    def search(split: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: set[tuple[int, int]] = set()

            def emit() -> pa.RecordBatch:
                pairs = np.array(list(found), np.int64).reshape(-1, 2)
                found.clear()
                return rows_of(False, pairs.max(axis=1, initial=-(2**63)), pairs.min(axis=1, initial=2**63 - 1))

            def take(point: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
                if split and len(point) > SPLIT:
                    starts = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]]))
                    size = np.diff(np.append(starts, len(point)))
                    big = np.repeat(size, size) > SPLIT
                    if big.any():
                        for i in range(0, int(big.sum()), SPLIT):
                            some = fp[big][i : i + SPLIT]
                            rows, keys = split_keys(some, point[big][i : i + SPLIT], radius)
                            yield rows_of(True, keys, some[rows])
                        point, fp = point[~big], fp[~big]
                if len(point):
                    found.update(link_rows(point, fp, radius))
                if len(found) > 100_000:
                    yield emit()

            groups = Groups()
            for batch in batches:
                for cols in groups.add([batch.column(0).to_numpy(), batch.column(1).to_numpy()]):
                    yield from take(*cols)
            for cols in groups.rest():
                yield from take(*cols)
            if found:
                yield emit()

        return run

    kind = "large boolean, u long, v long"
    spread = prints.select(key).mapInArrow(expand, "point long, fp long")
    placed = spread.repartition("point").sortWithinPartitions("point", "fp")
    first = cut(placed.mapInArrow(search(True), kind).distinct())
    out = first.where("not large").select("u", "v")
    large = first.where("large")
    if large.isEmpty():
        return out
    again = large.select("u", "v").repartition("u").sortWithinPartitions("u", "v")
    return out.unionByName(again.mapInArrow(search(False), kind).select("u", "v")).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """(key, fingerprint long, component_id) of every row of ``df``.

    component_id is the smallest key reachable over fingerprints within ``radius`` bits,
    the row's own included.  Rows with equal fingerprints belong together; texts without
    words have fingerprint 0 and are linked like any other.  Repeated rows are kept.  A null
    key is no smallest key: a component of null keys alone has a null id.
    """
    prints = cut(fingerprints(df, key, text, k))
    least = cut(prints.groupBy("fingerprint").agg(F.min(key).alias("_least"), F.count("*").alias("_rows")))
    nodes = components(links(least, radius))
    home = nodes.join(least, nodes.node == least.fingerprint).select("fingerprint", "component", "_least")
    merged = home.groupBy("component").agg(F.min("_least").alias("_id"))
    moved = home.join(merged, "component").select("fingerprint", "_id")
    where = least.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("_id", "_least").alias("component_id"), "_rows")
    return salted_lookup(prints, where, "fingerprint", "_rows").select(key, "fingerprint", "component_id")


#: SimHashes over distinct words per text.
PRINTS = 3


def text_hash(text: str) -> Column:
    """Hash by which rows of one key are told apart: of the whole text as it is, null as empty."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", prints: int = PRINTS) -> DataFrame:
    """(key, text_hash, node, component) of every row: texts whose five-word shingle sets have a
    Jaccard similarity of 0.8 or more are in one component, as far as their fingerprints have a neighbour.

    ``node`` is a hash of the word sequence; ``component`` the least node of the component.  Every
    link is verified on whole shingle sets; which texts are compared is up to the fingerprints
    (``PRINTS`` of them over distinct words; the README has the recall).  Rows with equal word
    sequences have equal nodes, texts without words are one node; null keys and repeated rows
    have rows.
    """
    require(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2, PIECE_BYTES):
            node, n, marks = [], [], []
            for data in part.column(2).to_pylist():
                words = data.lower().split()
                node.append(xxhash.xxh64_digest(b" ".join(words), 42))
                n.append(len(words))
                marks.append(word_prints(data, prints))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.frombuffer(b"".join(node), ">i8").astype(np.int64)), pa.array(n, pa.int64()), pa.array(marks, pa.binary())],
                names=[key, "text_hash", "node", "n", "prints"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("k"), text_hash(text).alias("h"), blob(text).alias("t"))
    rows = cut(rows.mapInArrow(run, f"`{key}` {kind}, text_hash long, node long, n long, prints binary"))
    owner = F.min(F.struct(F.col(f"`{key}`").alias("k"), F.col("text_hash").alias("h")))
    nodes = cut(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("prints").alias("prints"), F.count("*").alias("_rows"), owner.alias("owner")))
    texts = df.select(F.col(f"`{key}`").alias("k"), text_hash(text).alias("h"), blob(text).alias("t"))
    home = components(similar.verified_links(nodes.where("n > 0"), texts)).withColumnRenamed("node", "_node")
    where = nodes.join(home, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("component"), "_rows")
    return salted_lookup(rows.select(key, "text_hash", "node"), where, "node", "_rows").select(key, "text_hash", "node", "component")


def keep_first(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with one row of each component of ``found`` (key, text_hash, component), the one with
    the smallest key (ties: the smallest text hash); same columns.

    Rows are judged and removed by key and text, so a key that occurs with several texts
    loses only the texts that have a copy elsewhere.
    """
    least = found.groupBy("component").agg(F.min(F.struct(F.col(f"`{key}`").alias("k"), F.col("text_hash").alias("h"))).alias("m"), F.count("*").alias("c")).where("c > 1")
    held = salted_lookup(found, least.select("component", "m", "c"), "component", "c").where("m is not null")
    first = (F.col(f"`{key}`") == F.col("m.k")) & (F.col("text_hash") == F.col("m.h"))
    tag = uuid.uuid4().hex[:8]
    k, n, mark = f"_k_{tag}", f"_n_{tag}", f"_hash_{tag}"
    gone = held.where(~first).select(F.col(f"`{key}`").alias(k), F.col("text_hash").alias(n)).distinct()
    same = (F.col(f"`{key}`") == F.col(k)) & (F.col(mark) == F.col(n))
    names = [F.col(f"`{c}`") for c in df.columns]
    left = df.withColumn(mark, text_hash(text)).join(gone, same, "left_anti")
    many = cut(held.where(first).groupBy(F.col(f"`{key}`").alias(k), F.col("text_hash").alias(n)).count().where("count > 1").select(k, n))
    if many.isEmpty():
        return left.select(*names)
    one = left.join(many, same, "left_semi").dropDuplicates([key, mark])
    return left.join(many, same, "left_anti").select(*names).unionByName(one.select(*names))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``near_copies``, the one with the smallest key; same columns.

    Rows with a null key form no group and all stay; of rows that agree in key and text one
    stays; an empty frame stays empty.
    """
    found = cut(near_copies(df.where(F.col(f"`{key}`").isNotNull()), key, text))
    return keep_first(df, found, key, text)
