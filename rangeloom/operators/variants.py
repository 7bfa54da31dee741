"""Alternative locations of atoms, resolved for each variant of a residue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Atoms of the backbone, of which any location will do.
BACKBONE = ("P", "OP1", "OP2", "OP3", "O5'", "C5'", "C4'", "O4'", "C3'", "O3'", "O2'", "C2'", "C1'")
#: Two locations nearer than this in every coordinate, and a relative hair, are one.
SAME = 0.05
HAIR = 1e-5


def variants_of(atoms: DataFrame, residue: list[str], alt: str = "alt") -> DataFrame:
    """(residue, variant): the named locations of each residue, or one blank variant where none is named."""
    named = F.array_sort(F.collect_set(F.nullif(F.trim(alt), F.lit(""))))
    found = atoms.groupBy(*residue).agg(named.alias("_v"))
    return found.select(*residue, F.explode(F.when(F.size("_v") == 0, F.array(F.lit(""))).otherwise(F.col("_v"))).alias("variant"))


def resolve_variants(atoms: DataFrame, residue: list[str], wanted: DataFrame | None = None, atom: str = "atom", alt: str = "alt", order: str = "serial", xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(residue, variant, atom, chosen, xyz): one location of every atom for every variant of its residue.

    ``wanted`` are (residue, variant) rows; without it they are ``variants_of`` the table.  For a named
    variant an atom's location of that name counts; an atom that has only the blank one falls
    back to it; one that has other names but not this is unresolved.  For the blank variant an atom with one
    location has that; of a hydrogen or backbone atom the first in ``order`` counts, as it does
    where the first two agree within ``SAME``; others are unresolved.  What is unresolved has
    null for ``chosen`` and its place.  A variant that no atom of the residue names has no rows.

    Of repeated rows of an atom and location the first counts.  Two windows over (residue, atom)
    and one over (residue, variant), whose groups are a residue's atoms.
    """
    name = F.coalesce(F.trim(alt), F.lit(""))
    rows = atoms.select(*residue, F.col(atom).alias("atom"), name.alias("_alt"), F.col(order).alias("_order"), *xyz)
    place = Window.partitionBy(*residue, "atom", "_alt").orderBy("_order", *xyz)
    rows = rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
    own = Window.partitionBy(*residue, "atom").orderBy("_order", "_alt")
    whole = Window.partitionBy(*residue, "atom")
    nth = lambda c, n: F.max(F.when(F.col("_at") == n, F.col(c))).over(whole)
    rows = rows.withColumns({"_at": F.row_number().over(own), "_many": F.count("*").over(whole), "_blank_only": F.count_if(F.col("_alt") != "").over(whole) == 0})
    agree: Column = F.lit(True)
    for c in xyz:
        agree = agree & (F.abs(nth(c, 1) - nth(c, 2)) <= SAME + HAIR * F.abs(nth(c, 2)))
    rows = rows.withColumn("_agree", F.coalesce(agree, F.lit(False)))
    variants = (variants_of(atoms, residue, alt) if wanted is None else wanted.select(*residue, "variant").distinct()).withColumnsRenamed({r: f"_v_{r}" for r in residue})
    same = F.lit(True)
    for r in residue:
        same = same & F.col(r).eqNullSafe(F.col(f"_v_{r}"))
    met = rows.join(variants, same)
    any_will_do = F.col("atom").startswith("H") | F.col("atom").isin(*BACKBONE) | F.col("_agree")
    blank = F.when((F.col("_many") == 1) | ((F.col("_at") == 1) & any_will_do), 0)
    fits = F.when(F.col("variant") == "", blank).when(F.col("_alt") == F.col("variant"), 0).when(F.col("_blank_only"), 1)
    met = met.withColumn("_rank", fits)
    best = Window.partitionBy(*residue, "variant", "atom").orderBy(F.col("_rank").asc_nulls_last(), "_order", "_alt")
    met = met.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    named = F.max((F.col("variant") == "") | (F.col("_alt") == F.col("variant")) & F.col("_rank").isNotNull()).over(Window.partitionBy(*residue, "variant"))
    met = met.withColumn("_named", named).where("_named")
    there = lambda c: F.when(F.col("_rank").isNotNull(), F.col(c))
    return met.select(*residue, "variant", "atom", there("_alt").alias("chosen"), *[there(c).alias(c) for c in xyz])
