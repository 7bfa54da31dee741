"""Comparing two result sets, and counting over dynamic grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.functions.scalars import round_sig

BASE, CURRENT = "comparison_in_baseline", "comparison_in_current"
MODES = ("union", "difference", "missing", "new")


def compare_sets(baseline: DataFrame, current: DataFrame, mode: str, key: list[str], dedupe: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Differential query over two frames.

    union: one row per ``dedupe`` key with flags for both sets (the flags are taken over
    ``key``, the row from current if it is there); difference: those in one set only;
    missing: baseline rows whose key current lacks; new: the reverse.  ``order`` breaks ties
    among rows of one key.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode in ("missing", "new"):
        a, b = (baseline, current) if mode == "missing" else (current, baseline)
        keys = b.select(*[F.col(k).alias(f"_x_{k}") for k in key]).distinct()
        out = a.join(keys, [F.col(k).eqNullSafe(F.col(f"_x_{k}")) for k in key], "left_anti")
        return out.select("*", F.lit(mode == "missing").alias(BASE), F.lit(mode == "new").alias(CURRENT))
    flag = lambda df, b: df.select("*", F.lit(b).alias(BASE), F.lit(not b).alias(CURRENT))
    both = flag(baseline, True).unionByName(flag(current, False), allowMissingColumns=True)
    over = Window.partitionBy(*key)
    dedupe = dedupe or key
    first = Window.partitionBy(*dedupe).orderBy(F.col("_current").desc(), *[F.col(o).asc_nulls_last() for o in order or []])
    out = both.withColumn("_current", F.col(CURRENT)).withColumns({BASE: F.bool_or(BASE).over(over), CURRENT: F.bool_or(CURRENT).over(over)})
    out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_current")
    return out if mode == "union" else out.where(f"NOT ({BASE} AND {CURRENT})")


def compare_filters(df: DataFrame, baseline: Column, current: Column, mode: str) -> DataFrame:
    """The same over one frame and two conditions: one scan, no join; null conditions are false."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    out = df.select("*", F.coalesce(baseline, F.lit(False)).alias(BASE), F.coalesce(current, F.lit(False)).alias(CURRENT))
    want = {"union": f"{BASE} OR {CURRENT}", "difference": f"{BASE} <> {CURRENT}", "missing": f"{BASE} AND NOT {CURRENT}", "new": f"{CURRENT} AND NOT {BASE}"}
    return out.where(want[mode])


def comparison_summary(flagged: DataFrame, classes: list[str]) -> DataFrame:
    """Counts per class with dropped and added rows, ``-a +b`` text and percents at two figures."""
    b, c = (F.coalesce(F.col(x), F.lit(False)) for x in (BASE, CURRENT))
    n = lambda x: F.count(F.when(x, 1))
    out = flagged.groupBy(*classes).agg(n(b).alias("baseline"), n(c).alias("current"), n(b & ~c).alias("dropped"), n(c & ~b).alias("added"))
    ratio = lambda x: round_sig(F.try_divide(F.col(x) * F.lit(100.0), F.col("baseline")), 2)
    return out.select("*", F.format_string("-%d +%d", "dropped", "added").alias("change"), ratio("dropped").alias("dropped_percent"), ratio("added").alias("added_percent"))


def comparison_totals(summary: DataFrame) -> DataFrame:
    """Grand totals and the mean class ratio; classes without a baseline count in no mean."""
    return summary.agg(
        *[F.sum(c).alias(c) for c in ("baseline", "current", "dropped", "added")],
        F.avg(F.try_divide(F.col("dropped").cast("double"), F.col("baseline"))).alias("mean_dropped"),
    )


def group_sets(df: DataFrame, sets: list[list[str]], exprs: dict[str, str] | None = None, aggs: dict[str, str] | None = None) -> DataFrame:
    """GROUPING SETS over named expressions; ``grouping_set`` tells the sets apart.

    ``exprs`` gives SQL for set members that are no columns; ``aggs`` name -> SQL aggregate,
    by default the row count.
    """
    exprs, aggs = exprs or {}, aggs or {"count": "count(*)"}
    names = list(dict.fromkeys(n for s in sets for n in s))
    base = df.selectExpr("*", *[f"{exprs[n]} AS {n}" for n in names if n in exprs])
    if not names:
        return base.selectExpr(*[f"{a} AS {n}" for n, a in aggs.items()])
    text = ", ".join("(" + ", ".join(s) + ")" for s in sets)
    return df.sparkSession.sql(
        f"SELECT {', '.join(names)}, cast(grouping_id({', '.join(names)}) as bigint) AS grouping_set, {', '.join(f'{a} AS {n}' for n, a in aggs.items())} FROM {{base}} GROUP BY GROUPING SETS ({text})",
        base=base,
    )
