"""Panels over one scan: every panel's filter as a bit, and all histograms and moments in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.operators.stats import bin_of

#: Panels of a word of the bitmap; the sign bit is left alone.
WORD = 62


@dataclass(frozen=True)
class Variable:
    """A column of a panel, its own filter (SQL text), and its bins."""

    name: str
    column: str
    low: float
    high: float
    bins: int = 40
    filter: str | None = None


def panel_condition(panel: list[Variable]) -> Column:
    """What all variables of a panel share: every filter holds (null counts as no) and no value is null or NaN."""
    filters = [F.coalesce(F.expr(v.filter), F.lit(False)) for v in panel if v.filter]
    there = [F.expr(v.column).isNotNull() & ~F.isnan(F.expr(v.column).cast("double")) for v in panel]
    return reduce(lambda a, b: a & b, [*filters, *there])


def with_bitmap(df: DataFrame, panels: list[list[Variable]], name: str = "_mask") -> DataFrame:
    """``df`` with ``name``, an array of longs: bit i of the whole says whether a row is in panel i."""
    words = []
    for start in range(0, len(panels), WORD):
        bits = [F.when(panel_condition(p), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, p in enumerate(panels[start : start + WORD])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return df.withColumn(name, F.array(*words))


def in_panel(i: int, name: str = "_mask") -> Column:
    """Whether a row's bitmap has panel ``i``."""
    return F.get(name, F.lit(i // WORD)).bitwiseAND(F.lit(1 << (i % WORD)).cast("long")) != 0


def panel_histograms(df: DataFrame, panels: list[list[Variable]]) -> DataFrame:
    """(panel, variable, bin, count, total, mean, std): occupied bins of every variable, with its count, mean
    and population deviation in the panel.

    Conditions are evaluated once a row, as a bitmap; one aggregation by (panel, variable, bin)
    serves all panels, and moments are combined from the bins' own.  A variable that no
    row reaches has no row.
    """
    if not panels or any(not p for p in panels):
        raise ValueError("a panel needs a variable")
    rows = []
    for i, panel in enumerate(panels):
        for v in panel:
            x = F.expr(v.column).cast("double")
            rows.append(F.when(in_panel(i), F.struct(F.lit(i).alias("panel"), F.lit(v.name).alias("variable"), bin_of(x, v.low, (v.high - v.low) / v.bins, v.bins).alias("bin"), x.alias("x"))))
    picked = with_bitmap(df, panels).select(F.explode(F.array(*rows)).alias("_r")).where("_r is not null").select("_r.*")
    per_bin = picked.groupBy("panel", "variable", "bin").agg(F.count("*").alias("count"), F.avg("x").alias("_m"), F.var_pop("x").alias("_v"))
    whole = Window.partitionBy("panel", "variable")  # as many rows as a variable has bins
    n = F.sum("count").over(whole)
    out = per_bin.withColumn("total", n).withColumn("mean", F.sum(F.col("count") * F.col("_m")).over(whole) / F.col("total"))
    spread = F.sum(F.col("count") * (F.col("_v") + (F.col("_m") - F.col("mean")) * (F.col("_m") - F.col("mean")))).over(whole)
    return out.withColumn("std", F.sqrt(spread / F.col("total"))).select("panel", "variable", "bin", "count", "total", "mean", "std")
