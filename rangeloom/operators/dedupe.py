"""Mirrored pairs, best rows, membership lists, backbone neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _same(keys: list[str], other: str = "_r_") -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(other + k)) for k in keys])


def conflict_score(bonds: list[str], shifts: list[str] = ()) -> Column:
    """Sum of bond lengths over 4 (null: nothing) plus the signed shifts."""
    return sum((F.coalesce(F.col(b) - 4.0, F.lit(0.0)) for b in bonds), F.lit(0.0)) + sum((F.col(s) for s in shifts), F.lit(0.0))


def best_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def mark_best(df: DataFrame, key: list[str], order: list[Column], accepted: str = "accepted") -> DataFrame:
    """All rows, the best of each key marked.  One window does what a join back would."""
    return df.withColumn(accepted, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def accept_joined(df: DataFrame, chosen: DataFrame, key: list[str], accepted: str = "accepted") -> DataFrame:
    """All rows with whether their null-safe key is among ``chosen``."""
    keys = chosen.select(*[F.col(k).alias(f"_r_{k}") for k in key], F.lit(True).alias("_hit")).distinct()
    return df.join(keys, _same(key), "left").select(*df.columns, F.coalesce("_hit", F.lit(False)).alias(accepted))


def drop_mirrored(df: DataFrame, left: list[str], right: list[str], family: str, swapped: Column, order: list[Column]) -> DataFrame:
    """One row of each pair that the table holds in both orders.

    Two rows mirror each other when sides are exchanged and ``swapped`` of one's family is
    the other's.  Both get one canonical key, the smaller of the two spellings, so a single
    window keeps the first in ``order``: no self-join.
    """
    part = lambda cs, f: F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cs)], f.alias("f")), {"ignoreNullFields": "false"})
    own, other = part([*left, *right], F.col(family)), part([*right, *left], swapped)
    out = df.withColumn("_pair", F.least(own, other))
    return best_per_key(out, ["_pair"], order).drop("_pair")


#: How a family's name is spelt, families read from the less wanted side, and the order of bases.
FAMILY_NAME = "^(n?[ct])([WHSBwhsb])([WHSBwhsb])([a-z]*)$"
REVERSED_EDGES = "^(?i)n?(c|t)(SH|HW|SW|BW)a?$"
SMALL_FIRST = "^n?[ct][whsb][WHSB]a?$"
BASE_RANK = {"A": 1, "G": 2, "C": 3, "U": 4, "T": 4}
UNORDERED_FAMILIES = ("tss", "css")


def reversed_family(family: Column) -> Column:
    """A family's name seen from the other side: its two edges exchanged; other names stay."""
    return F.regexp_replace(family, FAMILY_NAME, "$1$3$2$4")


def drop_mirrored_passes(df: DataFrame, left: list[str], right: list[str], shared: list[str], family: str, loose: tuple[str, str], passes: list[Column]) -> DataFrame:
    """Rows that no pass drops as the less wanted reading of a mirrored pair.

    A row is matched by those that have its family reversed, its ``shared`` columns, and its sides exchanged;
    ``loose`` names a column of each side (the residue's name) of which only the first side's must equal the other's
    second.  A pass drops the rows that its condition holds for and that are matched, unless they
    are themselves the match of a row that it holds for: then neither reading is preferred.  Later
    passes see what earlier ones left.

    Every row that bears on another has the same two sites, so one shuffle by them serves all
    passes; a pass is two sets of match keys per group and a look into each.  Nulls are equal.
    """
    key = lambda cs: F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cs)]), {"ignoreNullFields": "false"})
    cols = lambda names: [F.col(n) for n in names]
    bare = lambda side, name: [c for c in side if c != name]
    one, two = key(cols(bare(left, loose[0]))), key(cols(bare(right, loose[1])))
    out = df.withColumns(
        {
            "_group": key([*cols(shared), F.least(one, two), F.greatest(one, two)]),
            "_wants": key([F.col(family), F.col(loose[0]), *cols(bare(left, loose[0])), *cols(bare(right, loose[1]))]),
            "_is": key([reversed_family(F.col(family)), F.col(loose[1]), *cols(bare(right, loose[1])), *cols(bare(left, loose[0]))]),
        }
    )
    group = Window.partitionBy("_group")
    for condition in passes:
        holds = F.coalesce(condition, F.lit(False))
        out = out.withColumn("_holds", holds).withColumns({"_there": F.collect_set("_is").over(group), "_held": F.collect_set(F.when(F.col("_holds"), F.col("_wants"))).over(group)})
        goes = F.col("_holds") & F.array_contains("_there", F.col("_wants")) & ~F.array_contains("_held", F.col("_is"))
        out = out.where(~goes).drop("_holds", "_there", "_held")
    return out.drop("_group", "_wants", "_is")


def mirror_passes(family: str, base1: Column, base2: Column) -> list[Column]:
    """The three preferences between two readings: the nobler edge first, a small letter second, the lower base first."""
    rank = lambda b: reduce(lambda c, kv: c.when(b == kv[0], kv[1]), BASE_RANK.items(), F.when(b.isNull(), 0)).otherwise(0)
    return [
        F.col(family).rlike(REVERSED_EDGES),
        F.col(family).rlike(SMALL_FIRST),
        ~F.lower(F.col(family)).isin(*UNORDERED_FAMILIES) & (rank(base1) > rank(base2)),
    ]


def keep_least_broken(df: DataFrame, left: list[str], right: list[str], shared: list[str], family: str, bases: Column, lengths: list[str], annotations: list[str] = (), ties: list[str] = ()) -> DataFrame:
    """One row per family, bases and unordered pair of sites: fewest missing bonds first, then the least sum of
    lengths (a missing one as 4, each missing annotation as 0.03), then the lower first side, then ``ties``."""
    site = lambda cs: F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cs)]), {"ignoreNullFields": "false"})
    missing = sum((F.col(c).isNull().cast("int") for c in lengths), F.lit(0))
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(4.0)) for c in lengths), F.lit(0.0)) + sum((F.col(c).isNull().cast("double") * 0.03 for c in annotations), F.lit(0.0))
    out = df.withColumns({"_bases": bases, "_one": F.least(site(left), site(right)), "_two": F.greatest(site(left), site(right))})
    return best_per_key(out, [family, *shared, "_bases", "_one", "_two"], [missing, score, *[F.col(c) for c in [*left, *right, *ties]]]).drop("_bases", "_one", "_two")


def membership(df: DataFrame, lists: dict[str, DataFrame], sides: list[list[str]]) -> DataFrame:
    """A flag per list: whether either side is on it.  Lists are made distinct first."""
    for name, members in lists.items():
        cols = members.columns
        hits = []
        for i, side in enumerate(sides):
            m = members.distinct().select(*[F.col(c).alias(f"_r_{s}") for c, s in zip(cols, side, strict=True)], F.lit(True).alias(f"_in{i}"))
            df = df.join(m, _same(side), "left").drop(*[f"_r_{s}" for s in side])
            hits.append(F.coalesce(F.col(f"_in{i}"), F.lit(False)))
        df = df.withColumn(name, reduce(lambda a, b: a | b, hits)).drop(*[f"_in{i}" for i in range(len(sides))])
    return df


def not_in(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """SQL's NOT IN over a one-column frame: an equi-join, with the null rules as scalar tests.

    A null member leaves nothing; a null key stays only where there are no members.
    """
    m = members.toDF("_m")
    some, null = m.agg(F.count("*")).scalar(), m.agg(F.count(F.when(F.col("_m").isNull(), 1))).scalar()
    return df.where((some == 0) | (F.col(key).isNotNull() & (null == 0))).join(m.where("_m is not null").distinct(), F.col(key) == F.col("_m"), "left_anti")


def family_candidates(df: DataFrame, families: DataFrame) -> DataFrame:
    """Every row with every candidate family (a fixed, small list)."""
    if len(families.head(65)) > 64:
        raise ValueError("the candidate list is a small constant")
    return df.crossJoin(F.broadcast(families))


def backbone(df: DataFrame, structure: str, left: str, right: str) -> DataFrame:
    """``is_dinucleotide`` and tri-state ``is_parallel`` of residue index pairs.

    A pair (i, j) is parallel if (i+1, j+1) or (i-1, j-1) is a pair, antiparallel if
    (i+1, j-1) or (i-1, j+1) is; both or neither gives null.  Neighbours share i - j or
    i + j, so a lag and a lead along each diagonal find them without a join.
    """
    out = df
    for name, diag, step in (("_p", F.col(left) - F.col(right), 1), ("_a", F.col(left) + F.col(right), 1)):
        w = Window.partitionBy(structure, diag).orderBy(left)
        # Repeated pairs share an index: ranges of values, not of rows.
        near = F.count("*").over(w.rangeBetween(-step, step)) - F.count("*").over(w.rangeBetween(0, 0))
        out = out.withColumn(name, near > 0)
    parallel = F.when(F.col("_p") & ~F.col("_a"), True).when(F.col("_a") & ~F.col("_p"), False)
    return out.select(*df.columns, (F.abs(F.col(left) - F.col(right)) == 1).alias("is_dinucleotide"), parallel.alias("is_parallel"))


def either_way_lookup(df: DataFrame, table: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """``value`` of (a, b), else of (b, a); the table must be unique by (a, b)."""
    one = table.select(F.col(a).alias("_r_a"), F.col(b).alias("_r_b"), F.col(value).alias("_v1"))
    two = table.select(F.col(b).alias("_q_a"), F.col(a).alias("_q_b"), F.col(value).alias("_v2"))
    out = df.join(one, F.col(a).eqNullSafe(F.col("_r_a")) & F.col(b).eqNullSafe(F.col("_r_b")), "left").join(two, F.col(a).eqNullSafe(F.col("_q_a")) & F.col(b).eqNullSafe(F.col("_q_b")), "left")
    return out.select(*df.columns, F.coalesce("_v1", "_v2").alias(value))


def expand_variants(df: DataFrame, variants: DataFrame, sides: dict[str, tuple[str, str]]) -> DataFrame:
    """Every row once for each variant of each side: ``sides`` maps a new column to (key in df, key in variants).

    ``variants`` has the residue key and ``alt``; a residue that is not listed has the one
    variant null.  Repeated entries count once.
    """
    for out, (mine, theirs) in sides.items():
        v = variants.select(F.col(theirs).alias("_k"), F.col("alt").alias(out)).distinct()
        df = df.join(v, F.col(mine).eqNullSafe(F.col("_k")), "left").drop("_k")
    return df


def per_residue(df: DataFrame, sides: list[list[str]], compute) -> DataFrame:
    """Columns that ``compute`` adds to the distinct residues of both sides, joined to both.

    ``sides`` lists each side's key columns, the first naming the dimension's; the new
    columns get the suffixes 1 and 2.  Each residue is worked on once, not once a pair.
    """
    names = [f"_k{i}" for i in range(len(sides[0]))]
    keys = reduce(lambda a, b: a.union(b), [df.select(*[F.col(c).alias(n) for c, n in zip(s, names, strict=True)]) for s in sides]).distinct()
    made = compute(keys.select(*[F.col(n).alias(c) for n, c in zip(names, sides[0], strict=True)]))
    new = [c for c in made.columns if c not in sides[0]]
    for i, side in enumerate(sides, 1):
        dim = made.select(*[F.col(c).alias(f"_r_{s}") for c, s in zip(sides[0], side, strict=True)], *[F.col(c).alias(f"{c}{i}") for c in new])
        df = df.join(dim, _same(side), "left").drop(*[f"_r_{s}" for s in side])
    return df


#: Bases in order of preference for the first place of a symmetric class.
BASE_ORDER = ("A", "DA", "G", "DG", "C", "DC", "U", "DU", "T", "DT")


def preferred_orientation(family: Column, base1: Column, base2: Column, families: list[str]) -> Column:
    """Whether a pair stands in the preferred order of its sides.

    Symmetric classes (equal edges) go by ``BASE_ORDER``, known bases before others and
    others by the alphabet; the rest must be among ``families``, whatever the case.
    """
    rank = lambda b: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, BASE_ORDER)), b), F.lit(0)), F.lit(len(BASE_ORDER) + 1))
    by_base = F.when(rank(base1) != rank(base2), rank(base1) < rank(base2)).otherwise(base1 <= base2)
    symmetric = F.substr(family, F.lit(2), F.lit(1)) == F.substr(family, F.lit(3), F.lit(1))
    return F.when(symmetric, by_base).otherwise(F.lower(family).isin([f.lower() for f in families]))
