"""URL filter: host rules plus a Bloom filter cascade over the corpus's own hosts.

The cascade's first level holds the listed keys that the corpus has, the next one the
unlisted keys that the first level takes by mistake, the next one the listed keys that the
second takes by mistake, and so on until a level makes no mistake.  As every level is
built against the complete key universe, membership is exact for every key of the corpus,
and a page is judged by a few bit probes, without a join on keys.

Keys are cut by hash into ranges of at most ``PART_BYTES`` of filter, each with a cascade
of its own; a level is a side table (range, bits as 64-bit words) in the shared folder.
Small cascades reach the pages as a scalar subquery.  Larger ones are looked up by range:
the side table is broadcast in groups of at most ``GROUP_BYTES``, so pages stay where they
are at any size of the list and the cascade always decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import cut, free_name, require

#: Bytes of filter for one hash range, of a cascade that is sent with the plan, and of one broadcast.
PART_BYTES = 256_000
INLINE_BYTES = 4_000_000
GROUP_BYTES = 64_000_000
MAX_LEVELS = 60


@dataclass(frozen=True)
class Level:
    """One Bloom filter for each hash range: ``bits`` positions, ``hashes`` probes."""

    bits: int
    hashes: int
    seed: int

    @property
    def column(self) -> str:
        return f"w{self.seed}"


@dataclass
class Cascade:
    """Levels over ``parts`` hash ranges; ``table`` has ``part`` and one array of words per level."""

    parts: int
    levels: list[Level]
    table: DataFrame | None

    def size(self, levels: list[Level]) -> int:
        """Bytes of some levels, over all ranges."""
        return self.parts * sum(x.bits // 8 for x in levels)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    then up to ``?``, ``#`` or the end.  Null or no ``://``: both empty."""
    rest = F.when(url.isNull() | (F.instr(url, "://") == 0), F.lit("")).otherwise(F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest ``host/path`` rule that fits, else nulls.

    A rule fits its host and all subdomains where the url's path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, kind in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried first
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)).cast("int")


def _position(key: Column, level: Level, probe: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level.seed), F.lit(probe), key), F.lit(level.bits))


def might_contain(key: Column, words: Column, level: Level) -> Column:
    """True where all probes of a key hit a set bit of its range's words."""
    hit = F.lit(True)
    for probe in range(level.hashes):
        at = _position(key, level, probe)
        hit &= F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1
    return hit


def with_words(df: DataFrame, key: Column, table: DataFrame, parts: int, levels: list[Level], out: str, inline: int) -> DataFrame:
    """``df`` with a struct column ``out``: the words of each level for the key's hash range."""
    names = [x.column for x in levels]
    words = F.struct(*names)
    bytes_ = parts * sum(x.bits // 8 for x in levels)
    if bytes_ <= inline:
        every = table.agg(F.array_sort(F.collect_list(F.struct("part", words.alias("w")))).alias("all")).scalar()
        return df.withColumn(out, F.get(every, _part(key, parts))["w"])
    groups = -(-bytes_ // GROUP_BYTES)
    side = table.select(F.col("part").alias("_part"), words.alias("_w"))
    found = F.lit(None)
    for g in range(groups):  # each a broadcast of a counted size; a row finds its range in one of them
        own = side.select(F.col("_part").alias(f"_part{g}"), F.col("_w").alias(f"_w{g}")).where(F.col(f"_part{g}") % groups == g)
        df = df.join(F.broadcast(own), _part(key, parts) == F.col(f"_part{g}"), "left")
        found = F.coalesce(f"_w{g}", found) if g else F.col("_w0")
    return df.withColumn(out, found).drop(*[f"_{x}{g}" for x in ("part", "w") for g in range(groups)])


def build_level(keys: DataFrame, level: Level, parts: int) -> DataFrame:
    """(part, words) of the Bloom filter of the ``key`` column.

    Bits are gathered by an aggregation over 64-bit words; a range's words, of ``PART_BYTES``
    at most, meet in one row.
    """
    words = level.bits // 64
    at = F.explode(F.array(*[_position(F.col("key"), level, p) for p in range(level.hashes)]))
    ones = keys.select("part", at.alias("at")).groupBy("part", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    every = keys.sparkSession.range(parts * words).select((F.col("id") / words).cast("int").alias("part"), (F.col("id") % words).alias("word"), F.lit(0).cast("long").alias("bits"))
    filled = ones.unionByName(every).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    rows = filled.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("all"))
    return rows.select("part", F.transform("all", lambda x: x["bits"]).alias(level.column))


def level_for(n: int, rate: float, seed: int) -> Level:
    """A level for ``n`` keys of a range that takes other keys by mistake at ``rate``."""
    bits = max(64, 64 * math.ceil(n * math.log(1 / rate) / math.log(2) ** 2 / 64))
    return Level(bits, min(16, max(1, round(bits / max(1, n) * math.log(2)))), seed)


def cascade(keys: DataFrame, part_bytes: int = PART_BYTES, inline_bytes: int = INLINE_BYTES) -> Cascade:
    """Levels that tell the listed keys from all others: ``keys`` has distinct ``key``, ``listed``.

    No listed key: no levels.  Each level about halves the keys that are still open, and
    only those are read again.
    """
    count = {r[0]: r[1] for r in keys.groupBy("listed").count().collect()}
    inside, outside = count.get(True, 0), count.get(False, 0)
    first = min(0.5, max(1e-6, inside * math.sqrt(0.5) / outside)) if outside else 0.5
    parts = max(1, math.ceil(inside * math.log(1 / first) / math.log(2) ** 2 / 8 / part_bytes))
    found = Cascade(parts, [], None)
    side = True
    open_keys = keys.select("key", "listed", _part(F.col("key"), parts).alias("part"))
    while inside if side else outside:
        if len(found.levels) == MAX_LEVELS:
            raise RuntimeError("the cascade did not settle")
        mine = open_keys.where(F.col("listed") == side)
        n = mine.groupBy("part").count().agg(F.max("count")).first()[0]
        level = level_for(n, 0.5 if found.levels else first, len(found.levels))
        table = cut(build_level(mine, level, parts))
        found.levels.append(level)
        found.table = table if found.table is None else found.table.join(F.broadcast(table), "part")
        # Keys of the other side stay open where this level takes them by mistake.
        probed = with_words(open_keys, F.col("key"), table, parts, [level], "_words", inline_bytes)
        open_keys = cut(probed.where((F.col("listed") == side) | might_contain(F.col("key"), F.col("_words")[level.column], level)).drop("_words"))
        wrong = open_keys.where(F.col("listed") != side).count()
        inside, outside = (inside, wrong) if side else (wrong, outside)
        side = not side
    if found.levels:
        found.table = cut(found.table)
    return found


def member(key: Column, words: Column, levels: list[Level]) -> Column:
    """Exact membership of a key of the universe: the first level that misses decides.

    A miss in an even level (listed keys) means unlisted, a miss in an odd one listed;
    passing every level means what the last one holds.
    """
    verdict = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        verdict = F.when(~might_contain(key, words[levels[i].column], levels[i]), F.lit(i % 2 == 1)).otherwise(verdict)
    return verdict


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame | None = None, url: str = "url", part_bytes: int = PART_BYTES, inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """``pages`` with ``_host``, ``_path``, ``_rule``, ``_verdict`` (allow or block) and ``_listed``.

    ``listed`` is the block list, a frame of hosts (column ``key``; nulls and repeats do no
    harm).  A listed host is blocked unless a rule says otherwise.  A null url, one without
    ``://`` or without a host has an empty host and is allowed.  Repeated rows are kept; an
    empty frame stays empty.  Where ``pages`` has a column of a result's name, the result
    has one more underscore in front.
    """
    require(pages, url)
    names = [F.col(f"`{c}`") for c in pages.columns]
    host_, path_, rule_, verdict_, listed_, words_ = (free_name(pages, x) for x in ("_host", "_path", "_rule", "_verdict", "_listed", "_words"))
    host, path = split_url(F.col(f"`{url}`"))
    out = pages.select(*names, host.alias(host_), path.alias(path_))
    found = Cascade(1, [], None)
    if listed is not None:
        universe = out.where(F.col(host_) != "").select(F.col(host_).alias("key")).distinct()
        marks = listed.select(F.col("key").alias("_k")).where("_k is not null").distinct()
        universe = cut(universe.join(marks, F.col("key") == F.col("_k"), "left").select("key", F.col("_k").isNotNull().alias("listed")))
        found = cascade(universe, part_bytes, inline_bytes)
    if found.levels:
        probed = with_words(out, F.col(host_), found.table, found.parts, found.levels, words_, inline_bytes)
        hit = (F.col(host_) != "") & member(F.col(host_), F.col(words_), found.levels)
        out = probed.select(*names, host_, path_, hit.alias(listed_))
    else:
        out = out.withColumn(listed_, F.lit(False))
    rule, verdict = rule_for(F.col(host_), F.col(path_), rules)
    return out.select("*", rule.alias(rule_), F.coalesce(verdict, F.when(F.col(listed_), F.lit("block")).otherwise(F.lit("allow"))).alias(verdict_))
