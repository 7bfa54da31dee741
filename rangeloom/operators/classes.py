"""Pair classes found in the data, and what their bond definitions say of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Families read from the side that is preferred, and the order of bases.
PREFERRED_FAMILIES = ("cww", "tww", "cwh", "twh", "cws", "tws", "chh", "thh", "chs", "ths", "css", "tss", "cwb")
BASES = ("A", "G", "C", "U", "T")


def read_bond_definitions(spark: SparkSession, *files: str) -> DataFrame:
    """(family, base1, base2, place, atom1, atom2): the bonds of each class, a row each, in file order.

    The files are comma-separated with free text above the line that begins with ``TYPE``: type
    (``cis W/S``), two bases, donor and hydrogen or ``-`` and acceptor, ``---``, then acceptor or
    hydrogen, and ``-`` or donor.  ``atom1`` and ``atom2`` are the heavy atoms of the two sides.  A type of
    another form is left out; of a class's equal bonds the first counts.  A definition table
    has a few hundred lines; a line that is out of form is an error when read.
    """
    lines = spark.read.text(list(files)).select("value", F.monotonically_increasing_id().alias("_at"), F.input_file_name().alias("_file"))
    heads = lines.where(F.split("value", ",")[0] == "TYPE").groupBy("_file").agg(F.min("_at").alias("_head")).withColumnRenamed("_file", "_of")
    part = lambda i: F.trim(F.get(F.split("value", ","), F.lit(i)))
    rows = lines.join(heads, (F.col("_file") == F.col("_of")) & (F.col("_at") > F.col("_head"))).where(F.trim("value") != "").select("_at", *[part(i).alias(f"p{i}") for i in range(8)])
    kind = "(?i)^(cis|trans) ([WSH])/([WSHB])(a?)"
    of = lambda i: F.regexp_extract("p0", kind, i)
    family = F.concat(F.lower(F.substring(of(1), 1, 1)), F.upper(of(2)), F.upper(of(3)), of(4))
    known = rows.where(F.col("p0").rlike(kind))
    fine = (F.col("p5") == "---") & ((F.col("p3") == "-") | (F.col("p7") == "-"))
    checked = known.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a bond: "), F.concat_ws(",", *[f"p{i}" for i in range(8)]))).cast("boolean")))
    bonds = checked.select("_at", family.alias("family"), F.col("p1").alias("base1"), F.col("p2").alias("base2"), F.when(F.col("p3") == "-", F.col("p4")).otherwise(F.col("p3")).alias("atom1"), F.when(F.col("p3") == "-", F.col("p7")).otherwise(F.col("p6")).alias("atom2"), (F.col("p3") == "-").alias("_turned"))
    once = bonds.groupBy("family", "base1", "base2", "atom1", "atom2", "_turned").agg(F.min("_at").alias("_at"))
    place = F.row_number().over(Window.partitionBy("family", "base1", "base2").orderBy("_at")) - 1
    return once.withColumn("place", place).select("family", "base1", "base2", "place", "atom1", "atom2")


def swapped(family: Column) -> Column:
    """A plain family (letter, two edges, variant) with its edges exchanged."""
    return F.concat(F.substring(family, 1, 1), F.substring(family, 3, 1), F.substring(family, 2, 1), F.regexp_extract(family, "^.{3}(.*)$", 1))


def with_swaps(bonds: DataFrame) -> DataFrame:
    """Definitions under both orders of the sides; a class that is defined itself keeps its own."""
    other = bonds.select(swapped(F.col("family")).alias("family"), F.col("base2").alias("base1"), F.col("base1").alias("base2"), "place", F.col("atom2").alias("atom1"), F.col("atom1").alias("atom2"))
    key = ["family", "base1", "base2"]
    return bonds.select(*key, "place", "atom1", "atom2").unionByName(other.join(bonds.select(*key).distinct(), key, "left_anti"))


def class_numbers(classes: DataFrame, bonds: DataFrame, rna: str = "rna") -> DataFrame:
    """``classes`` (family, base1, base2, a flag ``rna``) with ``class_number``: 1 to 3, null for a class without bonds.

    1: two distinct atoms on either side in bonds of neither carbon nor sugar; 2: one such, two when
    sugar counts, and RNA; 3: the rest.  A near class (n...) and lower-case edges go by
    the plain one's definition, an undefined class by its swap's.
    """
    carbon = F.col("atom1").startswith("C") | F.col("atom2").startswith("C")
    sugar = F.col("atom1").endswith("'") | F.col("atom2").endswith("'")
    least = lambda cond: F.least(F.count_distinct(F.when(cond, F.col("atom1"))), F.count_distinct(F.when(cond, F.col("atom2"))))
    sums = with_swaps(bonds).groupBy("family", "base1", "base2").agg(least(~carbon & ~sugar).alias("_good"), least(~carbon).alias("_plain"))
    sums = sums.withColumnsRenamed({"family": "_family", "base1": "_base1", "base2": "_base2"})
    bare = F.regexp_replace("family", "^n", "")
    plain = F.concat(F.substring(bare, 1, 1), F.upper(F.substring(bare, 2, 2)), F.regexp_extract(bare, "^.{3}(.*)$", 1))
    met = classes.withColumn("_plainly", plain).join(sums, (F.col("_plainly") == F.col("_family")) & (F.col("base1") == F.col("_base1")) & (F.col("base2") == F.col("_base2")), "left")
    number = F.when(F.col("_good").isNull(), None).when(F.col("_good") >= 2, 1).when(F.col(rna) & (F.col("_good") >= 1) & (F.col("_plain") >= 2), 2).otherwise(3)
    return met.select(*classes.columns, number.cast("int").alias("class_number"))


def preferred(family: Column, base1: Column, base2: Column) -> Column:
    """Whether a class is read from the side that is preferred: its own family or, where both edges are one, the earlier base."""
    place = lambda b: F.array_position(F.array(*map(F.lit, BASES)), b)
    bare = F.regexp_replace(family, "^n", "")
    return F.when((swapped(bare) == bare), place(base1) <= place(base2)).otherwise(F.lower(F.substring(bare, 1, 3)).isin(*PREFERRED_FAMILIES))


def discover_classes(df: DataFrame, bonds: DataFrame, family: str = "family", base1: str = "base1", base2: str = "base2") -> DataFrame:
    """(family, base1, base2, count, share): the classes that the rows have, each once.

    Left out are classes of other bases than ACGUT; one whose swap is there too and preferred, unless the
    definitions give both a meaning of their own; and a family whose first edge is the second's
    in lower case.  ``share`` is of all rows.  The rows are counted once; the rest works on classes.
    """
    counted = df.groupBy(F.col(family).alias("family"), F.col(base1).alias("base1"), F.col(base2).alias("base2")).agg(F.count("*").alias("count"))
    counted = counted.withColumn("_total", F.sum("count").over(Window.partitionBy()))
    near = F.regexp_extract("family", "^(n?)", 1)
    bare = F.regexp_replace("family", "^n", "")
    counted = counted.withColumns({"_swap": F.concat(near, swapped(bare)), "_good": preferred(F.col("family"), F.col("base1"), F.col("base2"))})
    there = counted.select(F.lower("family").alias("_f"), F.col("base1").alias("_b1"), F.col("base2").alias("_b2"), F.lit(True).alias("_there")).distinct()
    known = bonds.select(F.col("family").alias("_df"), F.col("base1").alias("_d1"), F.col("base2").alias("_d2")).distinct()
    own = known.withColumn("_own", F.lit(True))
    other = known.toDF("_sf", "_s1", "_s2").withColumn("_other", F.lit(True))
    met = counted.join(there, (F.lower("_swap") == F.col("_f")) & (F.col("base2") == F.col("_b1")) & (F.col("base1") == F.col("_b2")), "left")
    met = met.join(own, (F.col("family") == F.col("_df")) & (F.col("base1") == F.col("_d1")) & (F.col("base2") == F.col("_d2")), "left")
    met = met.join(other, (F.col("_swap") == F.col("_sf")) & (F.col("base2") == F.col("_s1")) & (F.col("base1") == F.col("_s2")), "left")
    redundant = F.coalesce(F.col("_there"), F.lit(False)) & ~F.col("_good") & ~(F.coalesce(F.col("_own"), F.lit(False)) & F.coalesce(F.col("_other"), F.lit(False)))
    edge = lambda i: F.substring(F.regexp_replace("family", "^n", ""), i, 1)
    small = (edge(2) != F.upper(edge(2))) & (edge(3) == F.upper(edge(2)))
    weird = ~(F.col("base1").isin(*BASES) & F.col("base2").isin(*BASES))
    out = met.where(~F.coalesce(weird, F.lit(True)) & ~F.coalesce(redundant, F.lit(False)) & ~small)
    return out.select("family", "base1", "base2", "count", (F.col("count") / F.col("_total")).alias("share"))
