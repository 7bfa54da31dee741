"""Near copies: texts that have a SimHash neighbour, verified on whole five-word shingle sets.

Every node (a distinct word sequence) stands at the grid points of its fingerprints.  A node
that passes the Manhattan bound and the popcount with another one at a point is a suspect;
the texts of suspects alone are read again, as sets of shingle hashes.  Which suspects are
similar is then decided exactly: under one order of all shingles, two sets of a Jaccard
similarity of 0.8 share one of their first ``n - ceil(0.8 n) + 1`` (rare shingles come first),
must be of like size and near each other in a parity sketch, and are compared as a whole.

In a large group of near copies a set is held against its first few candidates; sets that
have more are looked at again in a later round, but only across the components found so
far, so such a group costs a few pairs a set and no pair of different components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import cut, pieces, release
from rangeloom.llm.components import components
from rangeloom.llm.grid import SEGMENTS, Groups, grid_points, segment_counts

K = 5
PIECE_BYTES = 4_000_000
#: Bits of the shortest parity sketch.
SKETCH = 256
#: Bits of the sketch that goes with a set's candidate rows in the first round, at most.
SHORT = 256
#: Bits a shingle of the sketch in later rounds, where the sets left are much alike, and their most.
DENSE, WIDE = 8, 8_192
#: Differing bits of two fingerprints of neighbours.
RADIUS = 12
#: Grid points of one kind of fingerprint.
TOKENS = 2 * 3**SEGMENTS
#: Candidates that a set takes among those before it in a group, round by round.
ROUNDS = (1, 4, 2**62)
#: Groups of more members are searched from their first PIVOTS members until the last round.
WHOLE, PIVOTS = 1_024, 16
#: A shingle of so many sets of the sample is put last; the order never changes the result.
HOT, HOT_MAX = 4, 100_000
#: Node tables up to so many rows (a few words each) are broadcast.
FEW = 250_000


def shingles(data: bytes, k: int = K) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the k-word shingles (fewer words: the whole sequence)."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    ends = ends[min(k, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=False)], np.uint64).view(np.int64))


def sketch(tokens: np.ndarray, dense: int = 1, most: int = 2**62) -> np.ndarray:
    """Parity of the tokens by bit: two sketches differ in no more bits than their sets in tokens.

    The width is a power of two, at least ``dense`` bits a token up to ``most``; a wider sketch is
    folded to a narrower one.
    """
    width = min(most, max(SKETCH, 1 << (dense * len(tokens) - 1).bit_length())) if len(tokens) else SKETCH
    odd = np.bincount((tokens.view(np.uint64) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def sketch_bits(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Differing bits of the sketches of each pair, the wider one folded."""
    wx, wy = (np.array([len(b) // 8 for b in side], np.int64) for side in (x, y))
    out = np.zeros(len(x), np.int64)
    for p, q in {*zip(wx.tolist(), wy.tolist(), strict=True)}:
        at = np.flatnonzero((wx == p) & (wy == q))
        w = min(p, q)
        s, t = (np.bitwise_xor.reduce(np.frombuffer(b"".join([side[i] for i in at]), np.uint64).reshape(len(at), -1, w), axis=1) for side in (x, y))
        out[at] = np.bitwise_count(s ^ t).sum(axis=1, dtype=np.int64)
    return out


def fold(raw: bytes, bits: int) -> bytes:
    """A sketch folded to at most ``bits``."""
    words = np.frombuffer(raw, np.uint64)
    return raw if len(words) * 64 <= bits else np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0).tobytes()


def marks(nodes: DataFrame) -> DataFrame:
    """(node, f, print) for every fingerprint of (node, prints)."""
    each = F.expr("transform(sequence(0, length(prints) div 8 - 1), i -> cast(conv(hex(substring(prints, cast(8 * i + 1 as int), 8)), 16, -10) as bigint))")
    return nodes.select("node", F.posexplode(each).alias("f", "print")).select("node", F.col("f").cast("long").alias("f"), "print")


def expand(prints: DataFrame) -> DataFrame:
    """(token, print) for every grid point of every (f, print); the token holds f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                f, mark = (batch.column(c).slice(i, 2_000).to_numpy() for c in ("f", "print"))
                rows, points = grid_points(mark, 1)
                yield pa.RecordBatch.from_pydict({"token": pa.array(points + f[rows] * TOKENS), "print": pa.array(mark[rows])})

    return prints.select("f", "print").mapInArrow(run, "token long, print long")


def group_sizes(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the runs of equal tokens."""
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    return starts, np.diff(np.append(starts, len(token)))


def neighbours(token: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows inside the groups, shift by shift; groups of size 0 have none."""
    _, real = group_sizes(token)
    size = np.repeat(sizes, real)
    rank = np.arange(len(token)) - np.repeat(np.cumsum(real) - real, real)
    at, shift = np.flatnonzero(size > 1), 1
    while len(at := at[rank[at] + shift < size[at]]):
        yield at, at + shift
        shift += 1


def suspects(rows: DataFrame) -> DataFrame:
    """(f, print) that pass bound and popcount with another print at a grid point; at a point of
    over ``WHOLE`` prints all count as suspects, which costs time and changes no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[set[int]] = []
        groups = Groups()

        def note(token: np.ndarray, mark: np.ndarray) -> None:
            f = token // TOKENS
            for one in np.unique(f).tolist():
                while len(found) <= one:
                    found.append(set())
                found[one].update(mark[f == one].tolist())

        def add(cols: list[np.ndarray]) -> None:
            token, mark = cols
            sizes = group_sizes(token)[1]
            each = np.repeat(sizes, sizes)
            note(token[each > WHOLE], mark[each > WHOLE])
            keep = (each > 1) & (each <= WHOLE)
            token, mark = token[keep], mark[keep]
            if not len(token):
                return
            counts, bits = segment_counts(mark).reshape(len(mark), -1).astype(np.int8), mark.astype(np.uint64)
            hit = np.zeros(len(token), bool)
            for a, b in neighbours(token, group_sizes(token)[1]):
                open_ = ~(hit[a] & hit[b])
                a, b = a[open_], b[open_]
                ok = np.abs(counts[a] - counts[b]).sum(axis=1, dtype=np.int64) <= RADIUS
                a, b = a[ok], b[ok]
                ok = np.bitwise_count(bits[a] ^ bits[b]) <= RADIUS
                hit[a[ok]] = True
                hit[b[ok]] = True
            note(token[hit], mark[hit])

        for batch in batches:
            for cols in groups.add([c.to_numpy() for c in batch.columns]):
                add(cols)
        for cols in groups.rest():
            add(cols)
        for f, some in enumerate(found):
            out = np.array(list(some), np.int64)
            for i in range(0, len(out), 100_000):
                part = out[i : i + 100_000]
                yield pa.RecordBatch.from_pydict({"f": pa.array(np.full(len(part), f)), "print": pa.array(part)})

    placed = rows.repartition("token").sortWithinPartitions("token", "print")
    return placed.mapInArrow(run, "f long, print long")


def near_nodes(nodes: DataFrame) -> DataFrame:
    """(_n) of the nodes that have a SimHash neighbour: a fingerprint that is a suspect or that another
    node has too.  The grid join is over distinct fingerprints, so nodes that share one cost it once."""
    own = marks(nodes)
    prints = own.groupBy("f", "print").agg(F.count("*").alias("c"))
    found = suspects(expand(prints)).unionByName(prints.where("c > 1").select("f", "print"))
    found = found.select(F.col("f").alias("_f"), F.col("print").alias("_print"))
    return own.join(found, (F.col("f") == F.col("_f")) & (F.col("print") == F.col("_print")), "left_semi").select(F.col("node").alias("_n")).distinct()


def frequent(sets: DataFrame) -> np.ndarray:
    """Shingles to be put last, by their sets in a sample."""
    every = min(20, max(1, sets.count() // 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0, PIECE_BYTES):
            seen, count = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"token": pa.array(seen), "c": pa.array(count.astype(np.int64))})

    counts = sets.where(F.pmod("node", F.lit(every)) == 0).select("tokens").mapInArrow(run, "token long, c long")
    most = counts.groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT).orderBy(F.desc("c"), "token").limit(HOT_MAX)
    return np.sort(np.array([r.token for r in most.select("token").collect()], np.int64))


def prefix_rows(sets: DataFrame, last: np.ndarray, dense: bool) -> DataFrame:
    """(token, node, n, sketch, label) for the prefix of every set (node, n, sketch, tokens, label),
    with a dense sketch or a short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3, PIECE_BYTES // 4):
            node, n, raw, tokens, label = (c.to_pylist() for c in batch.columns)
            firsts = []
            for size, t in zip(n, tokens, strict=True):
                s = np.frombuffer(t, np.int64)
                if len(last):
                    hot = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                    s = np.concatenate([s[~hot], s[hot]])
                firsts.append(s[: size + (-4 * size // 5) + 1])  # n - ceil(0.8 n) + 1
            at = np.repeat(np.arange(len(node)), [len(s) for s in firsts])
            if dense:
                raw = [sketch(np.frombuffer(t, np.int64), DENSE, WIDE).tobytes() for t in tokens]
            else:
                raw = [fold(x, SHORT) for x in raw]
            short = pa.array(raw, pa.binary())
            for i in range(0, len(at), 20_000):
                some = at[i : i + 20_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "token": pa.array(np.concatenate(firsts)[i : i + 20_000]),
                        "node": pa.array(np.array(node, np.int64)[some]),
                        "n": pa.array(np.array(n, np.int64)[some]),
                        "sketch": short.take(pa.array(some)),
                        "label": pa.array(np.array(label, np.int64)[some]),
                    }
                )

    return sets.where("n > 0").select("node", "n", "sketch", "tokens", "label").mapInArrow(run, "token long, node long, n long, sketch binary, label long")


def meet(rows: DataFrame, most: int) -> DataFrame:
    """Distinct candidates (a, b), a < b, of prefix rows with different labels; a group
    with candidates that were put off comes as (token, token).

    A set takes the first ``most`` of its candidates among the sets before it in a group.
    """

    def take(token: np.ndarray, node: np.ndarray, n: np.ndarray, raw: list[bytes], label: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        starts, sizes = group_sizes(token)
        width = np.array([len(x) // 8 for x in raw])
        folded = {}
        for w in np.unique(width).tolist():  # every sketch of at least this width, folded to it
            wide = np.flatnonzero(width >= w)
            place = np.zeros(len(raw), np.int64)
            place[wide] = np.arange(len(wide))
            folded[w] = place, np.frombuffer(b"".join(fold(raw[i], 64 * w) for i in wide.tolist()), np.uint64).reshape(-1, w)
        left, right, off = [], [], []

        def hold(a: np.ndarray, b: np.ndarray) -> None:
            ok = (label[a] != label[b]) & (node[a] != node[b]) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
            a, b = a[ok], b[ok]
            both = np.minimum(width[a], width[b])
            for w in np.unique(both).tolist():
                place, table = folded[w]
                x, y = a[both == w], b[both == w]
                for i in range(0, len(x), 50_000):
                    p, q = x[i : i + 50_000], y[i : i + 50_000]
                    bits = np.bitwise_count(table[place[p]] ^ table[place[q]]).sum(axis=1, dtype=np.int64)
                    near = 9 * bits <= n[p] + n[q]
                    left.append(p[near])
                    right.append(q[near])

        whole = (sizes <= WHOLE) | (most == ROUNDS[-1])
        for a, b in neighbours(token, np.where(whole, sizes, 0)):
            hold(a, b)
        for start, size in zip(starts[~whole].tolist(), sizes[~whole].tolist(), strict=True):
            for pivot in range(start, start + PIVOTS):
                hold(np.full(start + size - pivot - 1, pivot), np.arange(pivot + 1, start + size))
            if (label[start : start + size] != label[start]).any():
                off.append(token[start : start + 1])
        if not left:
            return [np.zeros(0, np.int64)] * 2, off
        a, b = np.concatenate(left), np.concatenate(right)
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        fresh = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        kept = np.arange(len(b)) - np.repeat(fresh, np.diff(np.append(fresh, len(b)))) < most
        off.append(token[b[~kept]])
        return [node[a[kept]], node[b[kept]]], off

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        groups = Groups()

        def emit() -> pa.RecordBatch:
            out = np.array(list(pairs), np.int64).reshape(-1, 2)
            pairs.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array(out.min(axis=1)), "b": pa.array(out.max(axis=1))})

        def add(cols: list[np.ndarray]) -> None:
            starts, sizes = group_sizes(cols[0])
            some = np.repeat(sizes > 1, sizes)
            if not some.any():
                return
            token, node, n, raw, label = (c[some] for c in cols)
            (a, b), off = take(token, node, n, raw.tolist(), label)
            pairs.update(zip(a.tolist(), b.tolist(), strict=True))
            for tokens in off:
                pairs.update((x, x) for x in np.unique(tokens).tolist())

        for batch in batches:
            for cols in groups.add([c.to_numpy(zero_copy_only=False) for c in batch.columns]):
                add(cols)
            if len(pairs) > 200_000:
                yield emit()
        for cols in groups.rest():
            add(cols)
        if pairs:
            yield emit()

    placed = rows.repartition("token").sortWithinPartitions("token", "node")
    return placed.mapInArrow(run, "a long, b long").distinct()


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, n, sketch, tokens) of (node, t) rows; tokens as little-endian 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1, PIECE_BYTES):
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["node", "n", "sketch", "tokens"],
            )

    return texts.select("node", "t").mapInArrow(run, "node long, n long, sketch binary, tokens binary")


def verify(pairs: DataFrame, sets: DataFrame, bounded: bool) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more, as (u, v).

    Unless they are ``bounded`` by dense sketches already, pairs far apart in the sketches go first.
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = 9 * sketch_bits(batch.column("x").to_pylist(), batch.column("y").to_pylist()) <= batch.column("both").to_numpy()
                yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(ok)) for c in ("a", "b")})

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "x", PIECE_BYTES // 2):
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            ok = []
            for p, q in zip(x, y, strict=True):
                s, t = np.frombuffer(p, np.int64), np.frombuffer(q, np.int64)
                ok.append(9 * len(np.intersect1d(s, t, assume_unique=True)) >= 4 * (len(s) + len(t)))
            yield pa.RecordBatch.from_pydict({"u": pa.array([i for i, k in zip(a, ok, strict=True) if k], pa.int64()), "v": pa.array([i for i, k in zip(b, ok, strict=True) if k], pa.int64())})

    def attach(pairs: DataFrame, column: str, *more: str) -> DataFrame:
        side = lambda at, out: sets.select(F.col("node").alias(f"_{at}"), F.col(column).alias(out), *[F.col(m).alias(f"{m}_{out}") for m in more])
        return pairs.join(side("b", "y"), F.col("b") == F.col("_b")).join(side("a", "x"), F.col("a") == F.col("_a"))

    if bounded:
        return attach(pairs, "tokens").select("a", "b", "x", "y").mapInArrow(exact, "u long, v long")
    small = attach(pairs, "sketch", "n").select("a", "b", "x", "y", (F.col("n_x") + F.col("n_y")).alias("both"))
    left = cut(small.mapInArrow(bound, "a long, b long"))
    return attach(left, "tokens").select("a", "b", "x", "y").mapInArrow(exact, "u long, v long")


def placed(df: DataFrame, key: str) -> DataFrame:
    """``df`` materialised by partitions of ``key``, so that joins on it leave its rows where they are.

    A checkpoint remembers how its rows are dealt, but not if its plan is an adaptive one.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        conf.set(name, before)


def verified_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) of similarity 0.8 or more between the nodes (node, prints, owner, _rows) that have a
    SimHash neighbour, by which they are connected exactly when all such pairs connect them.

    ``owner`` names one row (k, h) that has the node; ``texts`` are (k, h, t).
    """
    spark = nodes.sparkSession
    found = cut(near_nodes(nodes))
    release(spark)  # the grid join's shuffle, the largest of all, is done with
    own = nodes.join(found, F.col("node") == F.col("_n"), "left_semi").select("node", F.col("owner.k").alias("_k"), F.col("owner.h").alias("_h"), (F.col("_rows") == 1).alias("single"))
    own = cut(own)
    own = F.broadcast(own) if own.count() <= FEW else own
    read = texts.join(own, F.col("k").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h")))
    # Only a node of several rows can have its owner twice; texts of the others need no shuffle.
    sets = placed(shingle_sets(read.where("single")).unionByName(shingle_sets(read.where("not single").dropDuplicates(["node"]))), "node")
    release(spark)
    last = frequent(sets)
    rows = prefix_rows(sets.withColumn("label", F.col("node")), last, dense=False)
    links = None
    for most in ROUNDS:
        met = cut(meet(rows, most))
        new = cut(verify(met.where("a < b"), sets, bounded=most != ROUNDS[0]))
        links = new if links is None else links.unionByName(new)
        release(spark)
        off = met.where("a = b").select(F.col("a").alias("_off"))
        if off.isEmpty():
            break
        # Every pair that was put off stands in such a group; its sets alone are looked at again, and there alone.
        held = rows.join(off, F.col("token") == F.col("_off"), "left_semi").select(F.col("node").alias("_held")).distinct()
        home = components(links)
        links = home.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u != v")
        home = home.withColumnRenamed("node", "_node")
        again = sets.join(held, F.col("node") == F.col("_held"), "left_semi").join(home, F.col("node") == F.col("_node"), "left")
        again = prefix_rows(again.withColumn("label", F.coalesce("component", "node")), last, dense=True).join(off, F.col("token") == F.col("_off"), "left_semi")
        # A group whose sets are all in one component is settled.
        open_ = again.groupBy(F.col("token").alias("_t")).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("_t")
        rows = cut(again.join(open_, F.col("token") == F.col("_t"), "left_semi"))
        if rows.isEmpty():
            break
    return links
