"""Benchmark decontamination with suffix arrays over the training text.

Every Arrow piece of the corpus is a shard.  A shard's words become integers of the
benchmark's vocabulary (0: a word that no benchmark item has, which ends every match), the
runs that are long enough to hold a window are laid end to end, and a suffix array over
them is built by prefix doubling.  Every test suffix that is long enough is then
binary-searched, word by word, for all of them at once; suffixes that agree in their first
window are one search, with the list of the items that have it, so a passage that many
items share costs one.  The longest verbatim match of a text is found by extending its
occurrences in the suffix array of the benchmark itself.

The operator is a map: nothing is shuffled and a lost executor only repeats its own
splits.  The benchmark travels with the closure in blocks whose bytes are counted before
they are gathered; a larger benchmark takes one pass per block over the same rows, and only
one block at a time is held on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.llm.common import ascii_words, blob, free_name, pieces, require

WINDOW = 10
BLOCK_BYTES = 16_000_000
SHARD_BYTES = 4_000_000


@dataclass
class TestSet:
    """The items of one benchmark block as integer sequences."""

    vocabulary: dict[bytes, int]
    words: np.ndarray  # all distinct items, each followed by 0s up to the deepest look-ahead
    start: np.ndarray  # a first word of each distinct window
    length: np.ndarray  # words of each window
    before: np.ndarray  # the window one word earlier if it is the same wherever this one stands, else -1
    post: np.ndarray  # item groups with window w: post[post_at[w] : post_at[w + 1]]
    post_at: np.ndarray
    begin: np.ndarray  # first word of each item group
    groups: list[list[str]]  # item ids (as strings) that share a word sequence
    order: np.ndarray  # suffix array of ``words``
    named: np.ndarray  # place of each suffix of ``order`` by (least item id, word)
    named_at: np.ndarray  # the same by the suffix's first word
    depth: int
    window: int

    @classmethod
    def build(cls, rows: list[tuple[str, bytes]], window: int) -> TestSet:
        groups: dict[tuple[bytes, ...], list[str]] = {}
        for item, data in rows:
            words = tuple(ascii_words(data))
            if words:
                groups.setdefault(words, []).append(item)
        vocabulary: dict[bytes, int] = {}
        flat: list[int] = []
        start, length, begin = [], [], []
        index: dict[tuple[int, ...], int] = {}
        posts: list[list[int]] = []
        before: list[int] = []
        for g, words in enumerate(groups):
            begin.append(len(flat))
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            previous = -1
            for i in range(len(ids) - size + 1):
                w = index.setdefault(tuple(ids[i : i + size]), len(index))
                if w == len(start):
                    start.append(len(flat) + i)
                    length.append(size)
                    posts.append([])
                    before.append(previous)
                elif before[w] != previous:
                    before[w] = -1
                if not posts[w] or posts[w][-1] != g:
                    posts[w].append(g)
                previous = w
            flat += [*ids, 0]
        depth = max(map(len, groups), default=0)
        as_int = lambda x: np.array(x, np.int64)
        words = as_int(flat + [0] * (depth + 1))
        order = suffix_array(words, depth) if len(flat) else as_int([])
        owner = np.searchsorted(as_int(begin), order, side="right") - 1
        least = [min(ids) for ids in groups.values()]
        rank = as_int(np.argsort(np.argsort(np.array(least, object), kind="stable"), kind="stable")) if least else as_int([])
        named = np.argsort(np.lexsort((order, rank[owner] if len(order) else order)), kind="stable")
        named_at = np.zeros(len(words), np.int64)
        named_at[order] = named
        post_at = np.concatenate([[0], np.cumsum([len(x) for x in posts])]).astype(np.int64)
        return cls(vocabulary, words, as_int(start), as_int(length), as_int(before), as_int(list(chain.from_iterable(posts))), post_at, as_int(begin), list(groups.values()), order, named, named_at, depth, window)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of non-zero words in order of their suffixes, compared up to ``depth`` words or the next 0."""
    rank = words.astype(np.int64)
    text = words != 0
    span = 1
    while span < depth and len(rank):
        ahead = np.zeros_like(rank)
        ahead[:-span or None] = rank[span:] if span < len(rank) else 0
        key = rank * (int(rank.max()) + 1) + ahead
        values, dense = np.unique(key[text], return_inverse=True)
        rank[text] = dense + 1
        span *= 2
        if len(values) == int(text.sum()):
            break
    at = np.flatnonzero(text)
    return at[np.argsort(rank[at], kind="stable")]


def _bound(words: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int | np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of ``wanted`` as word ``depth`` of the suffixes order[low:high], for all at once."""
    low, high = low.copy(), high.copy()
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live]) >> 1
        value = words[order[middle] + (depth if isinstance(depth, int) else depth[live])]
        up = value <= wanted[live] if right else value < wanted[live]
        low[live[up]] = middle[up] + 1
        high[live[~up]] = middle[~up]


def search(words: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences (position in ``words``, distinct window) of the windows; ``words`` ends in ``depth`` 0s."""
    order = suffix_array(words, tests.depth)
    n = len(tests.start)
    low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    live = np.arange(n)
    for depth in range(int(tests.length.max(initial=0))):
        live = live[(tests.length[live] > depth) & (low[live] < high[live])]
        if not len(live):
            break
        wanted = tests.words[tests.start[live] + depth]
        left = _bound(words, order, low[live], high[live], depth, wanted, right=False)
        high[live] = _bound(words, order, left, high[live], depth, wanted, right=True)
        low[live] = left
    size = high - low
    window = np.repeat(np.arange(n), size)
    ends = np.cumsum(size)
    return order[np.repeat(low - ends + size, size) + np.arange(len(window))], window


def longest(words: np.ndarray, tests: TestSet, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, benchmark word, words) of the longest match that begins at each occurrence, but
    for occurrences that only go on from the word before them: their matches are longer there.

    An item of fewer words than a window matches as a whole.  Of several places in the
    benchmark the one of the least item id counts, then the first.
    """
    whole = tests.length[window] < tests.window
    short = at[whole], tests.start[window[whole]], tests.length[window[whole]]
    at, window = at[~whole], window[~whole]
    earlier = np.full(len(words), -2)
    earlier[at] = window  # windows of full length: one a position
    follows = (at > 0) & (tests.before[window] >= 0) & (earlier[at - 1] == tests.before[window])
    at = np.unique(at[~follows])
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(tests.order), np.int64)
    size = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        wanted = words[at[live] + size[live]]
        live, wanted = live[wanted != 0], wanted[wanted != 0]
        if not len(live):
            break
        # All suffixes in a range agree up to ``size`` words, so each row searches its own depth.
        left = _bound(tests.words, tests.order, low[live], high[live], size[live], wanted, right=False)
        right = _bound(tests.words, tests.order, left, high[live], size[live], wanted, right=True)
        some = left < right
        live = live[some]
        low[live], high[live] = left[some], right[some]
        size[live] += 1
    first = np.array([int(tests.order[a + int(np.argmin(tests.named[a:b]))]) for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.int64)
    return tuple(np.concatenate([a, b]) for a, b in zip(short, (at, first, size), strict=True))


def scan_shard(texts: list[bytes], tests: TestSet) -> list[tuple[int, list[tuple[int, int]], list[str], tuple[int, str, int, int] | None]]:
    """For each text: number of words, hit spans, item ids, longest match (words, item, item word, text word)."""
    split = [ascii_words(t) for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    out: list = [(int(n), [], [], None) for n in counts]
    total = int(counts.sum())
    if not total or not len(tests.start):
        return out
    ids = np.fromiter(map(tests.vocabulary.get, chain.from_iterable(split), repeat(0)), np.int64, total)
    begin = np.cumsum(counts) - counts
    known = ids != 0
    edge = np.zeros(total + 1, bool)
    edge[begin[counts > 0]] = True
    starts = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    stops = np.flatnonzero(known & (np.concatenate([edge[1:-1], [True]]) | ~np.concatenate([known[1:], [False]]))) + 1
    enough = stops - starts >= int(tests.length.min())
    starts, stops = starts[enough], stops[enough]
    if not len(starts):
        return out
    sizes = stops - starts + 1  # with the 0 behind each run
    ends = np.cumsum(sizes)
    place = np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]))
    words = ids[np.minimum(place, total - 1)]
    words[ends - 1] = 0
    words = np.concatenate([words, np.zeros(tests.depth + 1, np.int64)])
    at, window = search(words, tests)
    if not len(at):
        return out
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, place[at], 1)
    np.add.at(cover, place[at] + tests.length[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    side = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    opens, closes = np.flatnonzero(side == 1), np.flatnonzero(side == -1)
    doc_of = lambda p: np.searchsorted(begin, p, side="right") - 1  # noqa: E731  (empty texts share a begin with the next)
    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):  # a span may run over several texts
        while a < b:
            d = int(doc_of(a))
            stop = min(b, int(begin[d] + counts[d]))
            out[d][1].append((a - int(begin[d]), stop - int(begin[d])))
            a = stop
    owner = doc_of(place[at])
    met = np.unique(owner * len(tests.start) + window)
    edges = np.flatnonzero(np.diff(met // len(tests.start))) + 1
    for part in np.split(met, edges):
        d, of = int(part[0] // len(tests.start)), part % len(tests.start)
        post = np.unique(np.concatenate([tests.post[tests.post_at[w] : tests.post_at[w + 1]] for w in of.tolist()]))
        out[d][2].extend(chain.from_iterable(tests.groups[g] for g in post.tolist()))
    m_at, m_q, m_size = longest(words, tests, at, window)
    m_doc = doc_of(place[m_at])
    pick = np.lexsort((tests.named_at[m_q], place[m_at], -m_size, m_doc))
    docs, firsts = np.unique(m_doc[pick], return_index=True)
    for d, i in zip(docs.tolist(), pick[firsts].tolist(), strict=True):
        g = int(np.searchsorted(tests.begin, m_q[i], side="right") - 1)
        out[d] = (*out[d][:3], (int(m_size[i]), min(tests.groups[g]), int(m_q[i] - tests.begin[g]), int(place[m_at[i]] - begin[d])))
    return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())]))
MATCH = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("word", T.LongType())])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", SPAN),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("longest", MATCH),
    ]
)


#: Buckets of the benchmark at first; more are made while one that could be split exceeds a block.
BUCKETS = 64


def test_sets(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> Iterator[TestSet]:
    """The benchmark in blocks of at most ``block_bytes`` (an item that is larger alone is a block
    of its own), one after the other.

    Items fall into hash buckets by id and text; the bytes of every bucket are counted on
    the executors and buckets are packed into blocks before a block is gathered.
    """
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), blob(text).alias("data"))
    hashed = F.xxhash64("item", "data")
    n = BUCKETS
    while True:
        sizes = sorted(tuple(r) for r in rows.groupBy(F.pmod(hashed, F.lit(n)).alias("b")).agg(F.sum(F.octet_length("data") + 16), F.countDistinct(hashed)).collect())
        if all(size <= block_bytes or rest == 1 for _, size, rest in sizes):
            break
        n *= 8
    blocks: list[list[int]] = []
    room = 0
    for b, size, _ in sizes:
        if not blocks or size > room:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(b)
        room -= size
    for block in blocks or [[]]:
        part = rows if len(blocks) < 2 else rows.where(F.pmod(hashed, F.lit(n)).isin(block))
        part = part.distinct()  # repeated items add nothing
        yield TestSet.build([(r[0] if r[0] is not None else "", bytes(r[1])) for r in part.collect()], window)


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The longer of two matches (words, item, item word, word); ties: first in the text, least item id, first in the item."""
    order = lambda m: (-m[0], m[3], m[1], m[2])
    return min((m for m in (a, b) if m), key=order, default=None)


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, out: str = "_found", keep_text: bool = True) -> DataFrame:
    """``df`` with a struct column ``out``: n_words, n_hit, spans, items, items_sha256, longest.

    Texts of ``window`` consecutive words of an item are hits (an item of fewer words, but
    not none, is one window).  ``spans`` are the maximal hit word ranges, ``items`` the ids
    with occurring windows as sorted strings (a null id is the empty string), ``longest`` the
    longest verbatim match with its places (ties: first in the text, then the least item id,
    then first in the item), null where nothing occurs; the block size changes none of them.
    Without ``keep_text`` the text column is left out.  Null and empty texts have no words;
    repeated rows each get their result; an empty benchmark hits nothing.
    """
    require(df, text)
    require(benchmark, item, item_text)
    names = [c for c in df.columns if keep_text or c != text]
    if out in df.columns:
        raise ValueError(f"column {out} exists; choose another name")
    data = free_name(df, "_text")
    kept = [T.StructField(c, df.schema[c].dataType, True) for c in names]
    current = df.select(*[F.col(f"`{c}`") for c in names], blob(text).alias(data), F.lit(None).cast(FOUND).alias(out))
    width = len(names)
    schema = T.StructType([*kept, T.StructField(data, T.BinaryType()), T.StructField(out, FOUND)])
    for tests in test_sets(benchmark, item, item_text, window, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], tests: TestSet = tests) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches, width, SHARD_BYTES):
                found = []
                before = part.column(width + 1).to_pylist()
                for (n, spans, items, best), old in zip(scan_shard(part.column(width).to_pylist(), tests), before, strict=True):
                    if old:
                        spans = merge_spans(spans + [(s["first"], s["stop"]) for s in old["spans"]])
                        items = items + old["items"]
                        o = old["longest"]
                        best = better(best, o and (o["n_words"], o["item_id"], o["item_word"], o["word"]))
                    items = sorted(set(items))
                    found.append(
                        {
                            "n_words": n,
                            "n_hit": sum(y - x for x, y in spans),
                            "spans": [{"first": x, "stop": y} for x, y in spans],
                            "items": items,
                            "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(),
                            "longest": best and dict(zip(("n_words", "item_id", "item_word", "word"), best, strict=True)),
                        }
                    )
                yield pa.RecordBatch.from_arrays([*part.columns[: width + 1], pa.array(found, part.schema.field(width + 1).type)], names=[*names, data, out])

        current = current.mapInArrow(run, schema)
    return current.drop(data)


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` without the rows whose text holds a window of a benchmark item; same columns.

    Null and empty texts have no words and stay; repeated rows are judged alike.
    """
    found = free_name(df, "_found")
    marked = find_contamination(df, benchmark, text, window=window, out=found)
    return marked.where(F.col(found)["n_hit"] == 0).select(*[F.col(f"`{c}`") for c in df.columns])
