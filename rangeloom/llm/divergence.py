"""Divergence of sources within a language, by sort-based streaming over term occurrences.

Occurrences, one row per document and term, are partitioned by term and sorted by (lang, term,
source, document); a task's rows leave it in that order, so the sort is a merge of runs.  Before they
leave, a task adds up what it has of a (lang, term, source): its count goes with its first document, and of
the other documents only as many rows remain as decide whether a term is kept.  Scanning
the runs gives every (lang, term, source) its count and its document frequency, exact up to that
many documents.  A term that fills
more than a part of a partition is dealt over several by its documents' hash, so the scan yields partial
rows, summed afterwards; which terms these are is read off a sample and changes no result.  A
second scan, over the sorted counts, yields per run of a term the partial sums of all pairs of its sources.

A pair's value is a sum over all kept terms of the language, most of which a source does not have.
With ``z`` the share of an absent term and ``f`` the value of one term, it is
    sum over terms of both   f(p, q) - f(p, z_q) - f(z_p, q) + f(z_p, z_q)
  + sum over terms of p's    f(p, z_q)
  + sum over terms of q's    f(z_p, q)
  + (V - terms of p's - terms of q's) f(z_p, z_q),
where the second and third sums need only how often each count occurs in a source.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm.common import blob, pieces, require, shared_folder

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
#: Rows of the table of groups up to which it is broadcast.
GROUPS_BROADCAST = 100_000
SALTS = 16
#: Share of the documents that tells frequent terms, and the part of a partition from which a term is one.
SAMPLE = 0.01
HOT_PART = 0.25
PIECE_BYTES = 4_000_000
#: Terms of a (lang, source) that a task holds before it lets their rows go; they take about 300 bytes each.
HELD_TERMS = 500_000
#: Pairs of rows that the second scan holds at once, and partial sums a task keeps before it yields them.
PAIRS_AT_ONCE = 1 << 20
HELD_SUMS = 1 << 20
#: Sums of 64-bit values are carried in two halves, so that none can overflow.
HALF = 30
#: Every byte that is no term byte becomes a space, A-Z become a-z; bytes from 0x80 stay.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
KEYS = ["lang", "term", "source"]


def terms(data: bytes) -> Counter:
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased, with their counts."""
    return Counter(data.translate(TERM_BYTES).split())


class Held:
    """What a task has added up: per (lang, source) each term's count and its first documents, at most ``least``."""

    def __init__(self, least: int):
        self.least = least
        self.groups: dict[tuple[str, str], dict[bytes, list]] = {}
        self.size = 0

    def add(self, lang: str, source: str, document: int, found: Counter) -> None:
        """The terms of one document, which goes by its place among the documents that are held."""
        group = self.groups.setdefault((lang, source), {})
        before, most = len(group), self.least + 1
        for term, n in found.items():
            entry = group.get(term)
            if entry is None:
                group[term] = [n, document]
            else:
                entry[0] += n
                if len(entry) < most and document not in entry[1:]:
                    entry.append(document)
        self.size += len(group) - before

    def rows(self, documents: pa.Array, hashes: np.ndarray, salts: Callable) -> pa.RecordBatch:
        """(lang, term, source, document, n, salt) in order; a term's count is in the row of its first document."""
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), group in ((k, g) for k, g in self.groups.items() if g):
            sizes = [len(e) - 1 for e in group.values()]
            at = np.repeat(np.arange(len(group)), sizes)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            n = np.zeros(len(at), np.int64)
            n[first] = [e[0] for e in group.values()]
            term = pa.array(group, pa.binary()).cast(pa.string()).take(pa.array(at))
            place = np.fromiter((d for e in group.values() for d in e[1:]), np.int64, len(at))
            for column, part in zip(columns, (pa.array([lang], pa.string()).take(pa.array(np.zeros(len(at), np.int64))), term, pa.array([source], pa.string()).take(pa.array(np.zeros(len(at), np.int64))), pa.array(place), pa.array(n)), strict=True):
                column.append(part)
        lang, term, source, place, n = (pa.concat_arrays(c) for c in columns)
        salt = salts(lang, term, hashes[place.to_numpy()])
        rows = pa.RecordBatch.from_arrays([lang, term, source, documents.take(place), n, pa.array(salt, pa.int32())], names=["lang", "term", "source", "document", "n", "salt"])
        return rows.take(pc.sort_indices(rows, sort_keys=[("lang", "ascending"), ("term", "ascending"), ("source", "ascending")]))


def occurrences(df: DataFrame, text: str, lang: str, source: str, key: str, least: int, spread: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """lang, term, source, document, n and salt: rows per document and term, added up in their task (see ``Held``).

    The salt is 0, or for a (lang, term) in ``spread`` one of that many, by the document's hash, so
    rows of one document meet wherever they come from.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"lang string, term string, source string, document {kind}, n long, salt int"
    frequent = pa.array(sorted({t for _, t in spread or ()}), pa.string())

    def salts(lang: pa.Array, term: pa.Array, mixed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(term), np.int32)
        some = np.flatnonzero(pc.is_in(term, value_set=frequent).to_numpy(zero_copy_only=False)) if len(frequent) else ()
        if len(some):
            names = zip(lang.take(pa.array(some)).to_pylist(), term.take(pa.array(some)).to_pylist(), strict=True)
            out[some] = mixed[some] % np.array([spread.get(x, 1) for x in names])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, hashes, number, read = Held(least), [], [], {}, 0

        def rows() -> Iterator[pa.RecordBatch]:
            if held.size:
                whole = held.rows(pa.concat_arrays(documents), np.concatenate(hashes), salts)
                yield from (whole.slice(i, 50_000) for i in range(0, whole.num_rows, 50_000))

        for part in pieces(batches, "t", PIECE_BYTES):
            documents.append(part.column("k"))
            hashes.append(part.column("h").to_numpy(zero_copy_only=False))
            for l, s, k, t in zip(*(part.column(c).to_pylist() for c in "lskt"), strict=True):
                # A key that comes again is the same document of its group, under its first row's place.
                held.add(l, s, number.setdefault((l, s, k), read), terms(t))
                read += 1
            if held.size > HELD_TERMS:
                yield from rows()
                held, documents, hashes, number, read = Held(least), [], [], {}, 0
        yield from rows()

    whole = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (lang, source)]
    picked = [whole[0].alias("l"), whole[1].alias("s"), F.col(f"`{key}`").alias("k"), F.xxhash64(f"`{key}`").alias("h"), blob(text).alias("t")]
    return df.select(*picked).mapInArrow(run, schema)


def frequent_terms(rows: DataFrame, partitions: int, part: float = HOT_PART) -> dict[tuple[str, str], int]:
    """(lang, term) of more than ``part`` of an even partition's rows, with the number of parts to deal it into.

    There are at most ``partitions / part`` of them.
    """
    counts = rows.groupBy("lang", "term").agg(F.count("*").alias("m"))
    total = counts.agg(F.sum("m")).first()[0] or 0
    hot = counts.where(F.col("m") * partitions > F.lit(total) * part).collect()
    return {(r["lang"], r["term"]): -int(-r["m"] * partitions // (total * part)) for r in hot}


def run_starts(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Places where a row differs from the one before in any of the columns; the first row begins a run."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in names:
        column = batch.column(batch.schema.get_field_index(name))
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        if column.null_count:
            none = column.is_null().to_numpy(zero_copy_only=False)
            same = same | (none[1:] & none[:-1])
        new[1:] |= ~same
    return np.flatnonzero(new)


def scan_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, term, source, df, n) of sorted occurrences; a run that a batch boundary cuts yields two.

    A document's rows are counted once, so the last document of a batch is remembered.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [*KEYS, "document"]
        documents = run_starts(batch, names)
        starts = run_starts(batch, KEYS)
        df = np.add.reduceat(np.isin(np.arange(batch.num_rows), documents, assume_unique=True).astype(np.int64), starts)
        first = [batch.column(batch.schema.get_field_index(c))[0].as_py() for c in names]
        if first == last:
            df[0] -= 1
        last = [batch.column(batch.schema.get_field_index(c))[-1].as_py() for c in names]
        n = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
        some = pa.array(starts)
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(some) for c in KEYS), pa.array(df), pa.array(np.add.reduceat(n, starts))], names=[*KEYS, "df", "n"])


def value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of whole numbers up to 2^31."""
    return (p - q) ** 2 // q


def value_column(p: Column, q: Column) -> Column:
    """``value`` over columns of positive longs; the difference's square stays below 2^63."""
    return F.call_function("div", (p - q) * (p - q), q)


class PairSums:
    """Partial sums of ordered pairs of sources, kept by worker-wide numbers of (lang, source)."""

    def __init__(self) -> None:
        self.number: dict[tuple[str, str], int] = {}
        self.keys = np.zeros(0, np.int64)
        self.sums = np.zeros((0, 2), np.int64)

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        """Numbers of the rows' (lang, source)."""
        pair = pa.StructArray.from_arrays([batch.column(0), batch.column(2)], names=["l", "s"])
        lang, source = (batch.column(i).dictionary_encode() for i in (0, 2))
        mixed = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        _, first, back = np.unique(mixed, return_index=True, return_inverse=True)
        names = [(x["l"], x["s"]) for x in pair.take(pa.array(first)).to_pylist()]
        return np.array([self.number.setdefault(x, len(self.number)) for x in names], np.int64)[back]

    def add(self, left: np.ndarray, right: np.ndarray, f: np.ndarray) -> None:
        key = left << 32 | right
        low = f & ((1 << HALF) - 1)
        keys = np.concatenate([self.keys, key])
        sums = np.concatenate([self.sums, np.stack([f >> HALF, low], axis=1)])
        self.keys, back = np.unique(keys, return_inverse=True)
        self.sums = np.zeros((len(self.keys), 2), np.int64)
        np.add.at(self.sums, back, sums)

    def flush(self) -> pa.RecordBatch:
        names = list(self.number)
        left, right = ([names[i] for i in ids.tolist()] for ids in (self.keys >> 32, self.keys & 0xFFFFFFFF))
        columns = [[x[0] for x in left], [x[1] for x in left], [x[1] for x in right]]
        out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(self.sums[:, 0]), pa.array(self.sums[:, 1])], names=["lang", "source", "item", "high", "low"])
        self.keys, self.sums = self.keys[:0], self.sums[:0]
        return out


def scan_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of f(p, q) - f(p, z_q) - f(z_p, q) + f(z_p, z_q) over the terms that two sources share.

    Reads rows (lang, term, source, p, z) sorted by term.  Holds the sources of one term, of
    which the result has the square anyway, and a bounded number of sums.
    """
    sums = PairSums()
    held: list[pa.RecordBatch] = []

    def pairs(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = sums.codes(whole)
        p, z = (whole.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        starts = run_starts(whole, KEYS[:2])
        sizes = np.diff(np.append(starts, len(p)))
        first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        ends = np.cumsum(size)
        at = 0
        while at < len(p):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            some = size[at:to]
            left = np.repeat(np.arange(at, to), some)
            right = np.arange(len(left)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(first[at:to], some)
            left, right = left[left != right], right[left != right]
            f = value(p[left], p[right]) - value(p[left], z[right]) - value(z[left], p[right]) + value(z[left], z[right])
            sums.add(code[left], code[right], f)
            at = to
            if len(sums.keys) > HELD_SUMS:
                yield sums.flush()

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(run_starts(batch, KEYS[:2])[-1])
        goes_on = held and [held[-1].column(i)[-1].as_py() for i in (0, 1)] == [batch.column(i)[0].as_py() for i in (0, 1)]
        if held and (last or not goes_on):
            whole = [*held, batch.slice(0, last)] if goes_on else held
            yield from pairs(pa.Table.from_batches(whole).combine_chunks().to_batches()[0])
            if not goes_on and last:
                yield from pairs(batch.slice(0, last))
            held = []
        elif last:
            yield from pairs(batch.slice(0, last))
        held.append(batch.slice(last))
    if held:
        yield from pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    if len(sums.keys):
        yield sums.flush()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)); null where a language keeps no term."""
    whole = lambda c: c.cast("decimal(28,0)")
    return F.when(kept > 0, F.call_function("div", (whole(n) + 1) * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(whole(total) + whole(kept), F.lit(0).cast("decimal(28,0)"))) + 1)


def exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


class Audit:
    """The counts of a corpus, kept in the session's shared folder, and the two parts made of them.

    ``kept``: (lang, term, source, n, lang_n) of every term in at least ``least`` documents of its
    language, n occurrences in the source, lang_n in the language.  ``groups``: every (lang,
    source) with the sums that its shares need.
    """

    def __init__(self, df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id", least: int = LEAST_DOCUMENTS, broadcast_rows: int = GROUPS_BROADCAST):
        require(df, text, lang, source, key)
        self.spark = df.sparkSession
        folder = f"{shared_folder(self.spark)}/divergence-{uuid.uuid4().hex}"
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = frequent_terms(occurrences(df.sample(SAMPLE, seed=7), text, lang, source, key, least).select("lang", "term"), partitions)
        dealt = occurrences(df, text, lang, source, key, least, spread).repartition("lang", "term", "salt").drop("salt")
        runs = dealt.sortWithinPartitions(*KEYS, "document")
        partial = runs.mapInArrow(scan_counts, "lang string, term string, source string, df long, n long")
        counts = partial.repartition("lang", "term").groupBy(*KEYS).agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
        term = Window.partitionBy("lang", "term")
        kept = counts.withColumn("lang_df", F.sum("df").over(term)).withColumn("lang_n", F.sum("n").over(term)).withColumn("lead", F.row_number().over(term.orderBy("source")) == 1)
        kept.where(F.col("lang_df") >= least).select(*KEYS, "n", "lang_n", "lead").write.parquet(f"{folder}/kept")
        self.kept = self.spark.read.parquet(f"{folder}/kept")
        there = df.select(F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source")).distinct()
        sums = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("own"), F.sum(F.col("lead").cast("long")).alias("leads"))
        of_lang = Window.partitionBy("lang")
        full = there.join(sums, ["lang", "source"], "left").na.fill(0, ["n", "own", "leads"])
        full = full.select("lang", "source", F.col("n").alias("total"), "own", F.sum("leads").over(of_lang).alias("terms"), F.sum("n").over(of_lang).alias("lang_total"))
        full.withColumn("z", share(F.lit(0), F.col("total"), F.col("terms"))).write.parquet(f"{folder}/groups")
        self.groups = self.spark.read.parquet(f"{folder}/groups")
        self.small = self.groups.limit(broadcast_rows + 1).count() <= broadcast_rows

    def shares(self) -> DataFrame:
        """``kept`` with p and z, the shares of the term and of an absent term in the source, and q, that of the term in the language."""
        groups = self.groups.select("lang", "source", "total", "terms", "lang_total", "z")
        joined = self.kept.join(F.broadcast(groups) if self.small else groups, ["lang", "source"])
        return joined.select(*KEYS, share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "z", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))

    def _beside(self, left: DataFrame) -> DataFrame:
        """``left`` with every other source of its language: item, its number of terms ``_own`` and its ``_z``.

        The table of groups is broadcast while it is small; beyond, rows of a language are dealt by their source."""
        right = self.groups.select(F.col("lang").alias("_lang"), F.col("source").alias("item"), F.col("own").alias("_own"), F.col("z").alias("_z"))
        meets = (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("item"))
        if self.small:
            return left.repartition("lang", "source").join(F.broadcast(right), meets).drop("_lang")
        left = left.withColumn("_salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)))
        right = right.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.join(right, meets & (F.col("_salt") == F.col("_salted"))).drop("_lang", "_salt", "_salted")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) of every ordered pair of a language's sources."""
        rows = self.shares().select(*KEYS, "p", "z")
        ordered = rows.repartition("lang", "term").sortWithinPartitions(*KEYS)
        both = ordered.mapInArrow(scan_pairs, "lang string, source string, item string, high long, low long")
        both = both.select("lang", "source", "item", (exact(F.col("high")) * F.lit(1 << HALF) + F.col("low")).alias("v"))
        often = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
        met = self._beside(often)
        there, back = (exact(F.col("m")) * value_column(*x) for x in ((F.col("p"), F.col("_z")), (F.col("_z"), F.col("p"))))
        one = met.select("lang", F.inline(F.array(F.struct("source", "item", there.alias("v")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), back.alias("v")))))
        none = self._beside(self.groups.select("lang", "source", "own", "terms", "z"))
        absent = exact(F.col("terms") - F.col("own") - F.col("_own")) * value_column(F.col("z"), F.col("_z"))
        none = none.select("lang", "source", "item", F.coalesce(absent, F.lit(0)).alias("v"))
        parts = [x.select("lang", "source", "item", exact(F.col("v")).alias("v")) for x in (both, one, none)]
        every = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return every.groupBy("lang", "source", "item").agg(F.sum("v").cast("long").alias("value"))

    def terms(self) -> DataFrame:
        """(lang, source, item, value) of every term that a source has above its language's share."""
        return self.shares().where("p > q").select("lang", "source", F.col("term").alias("item"), value_column(F.col("p"), F.col("q")).alias("value"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, broadcast_rows: int = GROUPS_BROADCAST) -> DataFrame:
    """Divergence of sources: lang, source, part (``pair`` or ``term``), item, value, rank.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms above the language's
    share; ranks count from 1 by falling value, then by item.  Null texts, languages and sources
    count as empty ones; a group without terms has its pairs all the same, and pairs of a language that keeps
    no term are 0.  Rows of equal (lang, source, ``key``) are one document, null keys too.  An empty table
    gives an empty result; further columns of ``df`` are ignored.
    """
    made = Audit(df, text, lang, source, key, least, broadcast_rows)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    parts = [x.withColumn("part", F.lit(name)).withColumn("rank", place) for name, x in (("pair", made.pairs()), ("term", made.terms()))]
    return parts[0].unionByName(parts[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
