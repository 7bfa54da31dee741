"""Exact order statistics in bounded memory.

A first pass brackets every wanted rank by a sketch of bounded size whose rank error is proven.
A second counts what lies below each bracket and the distinct values inside it, and the
wanted values are read off their running counts.  While a bracket could hold more values than one
task should order, further passes narrow it by finer percentiles of what is inside.  All
classes, columns and ranks share the passes; no buffer grows with a class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A sketch's ranks are wrong by at most 1 / ACCURACY of the rows.
ACCURACY = 10_000
#: Values of a bracket that one task orders.
SMALL = 1_000_000
#: Percentiles that narrow a bracket.
GRID = 256
#: Classes up to which their brackets are kept on the driver and broadcast.
CLASSES = 20_000
METHODS = ("linear", "lower", "higher")


def _on(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys], F.lit(True))


def _settled(df: DataFrame) -> DataFrame:
    """``df`` read once and broadcast if it is small; else as it is, to be joined by a shuffle."""
    few = df.head(CLASSES + 1)
    return F.broadcast(df.sparkSession.createDataFrame(few, df.schema)) if len(few) <= CLASSES else df


def _places(rows: DataFrame, keys: list[str], ends: DataFrame, targets: int, points: int) -> DataFrame:
    """(keys, t, x): for every bracket the values inside it, and null for each value below."""
    met = rows.join(ends, _on(keys, "_of_"))
    pick = []
    for t in range(targets):
        v = F.col(f"_v{t // points}")
        inside = F.when(v >= F.col("_lo")[t], v)
        pick.append(F.when(v <= F.col("_hi")[t], F.struct(F.lit(t).alias("t"), inside.alias("x"))))
    return met.select(*keys, F.explode(F.array(*pick)).alias("_p")).where("_p is not null").select(*keys, "_p.t", "_p.x")


def _narrowed(rows: DataFrame, keys: list[str], ends: DataFrame, targets: int, points: int, accuracy: int) -> DataFrame:
    """``ends`` with narrower brackets, by percentiles of what is inside; a bracket keeps an end that no percentile betters."""
    grid = [i / GRID for i in range(GRID + 1)]
    got = _places(rows, keys, ends, targets, points).groupBy(*keys, "t").agg(F.count_if(F.col("x").isNull()).alias("below"), F.count("x").alias("inside"), F.percentile_approx("x", grid, accuracy).alias("grid"))
    packed = got.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("below", "inside", "grid")))).alias("_got")).withColumnsRenamed({k: f"_g_{k}" for k in keys})
    met = ends.join(packed, reduce(lambda a, b: a & b, [F.col(f"_of_{k}").eqNullSafe(F.col(f"_g_{k}")) for k in keys], F.lit(True)), "left")

    def end(t: int, high: bool) -> Column:
        x, old = F.col("_got")[t], F.col("_hi" if high else "_lo")[t]
        room = (x["inside"] / accuracy + 2) * (1 if high else -1)  # the sketch's error, and ranks between two rows
        share = (F.col("_rank")[t] - x["below"] + room) / x["inside"] * GRID
        at = (F.ceil(share) + 1 if high else F.floor(share) - 1).cast("int")
        return F.coalesce(F.when((at > 0) & (at < GRID), F.get(x["grid"], at)), old)

    width = [F.coalesce(F.ceil(F.col("_got")[t]["inside"] * (4.0 / GRID + 4.0 / accuracy)) + 6, F.lit(0)).cast("long") for t in range(targets)]
    columns = [F.array(*[end(t, False) for t in range(targets)]).alias("_lo"), F.array(*[end(t, True) for t in range(targets)]).alias("_hi"), F.array(*width).alias("_width")]
    return _settled(met.select(*[f"_of_{k}" for k in keys], "_n", "_rank", *columns))


def order_statistics(
    df: DataFrame, keys: list[str], columns: dict[str, Column], points: dict[str, tuple[float, str]], extra: list[Column] = (), accuracy: int = ACCURACY, small: int = SMALL
) -> DataFrame:
    """(keys, extra, ``{column}_{point}``): exact percentiles of each class, one row a class.

    ``points`` names a share from 0 to 1 and how it is read between two ranks: linear, lower or
    higher.  ``extra`` are further aggregates of the same first pass.  Nulls and NaN do not
    count; a class without values has null.  With no keys the whole frame is one class.
    """
    if bad := [m for _, m in points.values() if m not in METHODS]:
        raise ValueError(f"no such method: {bad}")
    margin = 2.0 / accuracy
    shares = sorted({0.0, 1.0} | {min(1.0, max(0.0, q + s)) for q, _ in points.values() for s in (-margin, margin)})
    wanted = [(i, q, m) for i in range(len(columns)) for q, m in points.values()]
    values = [F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"_v{i}") for i, c in enumerate(columns.values())]
    rows = df.select("*", *values)
    sketches = [c for i in range(len(columns)) for c in (F.count(f"_v{i}").alias(f"_n{i}"), F.percentile_approx(f"_v{i}", shares, accuracy).alias(f"_s{i}"))]
    first = _settled(rows.groupBy(*keys).agg(*extra, *sketches))
    rank = [F.lit(q) * (F.col(f"_n{i}") - 1) for i, q, _ in wanted]
    # The margin covers the sketch's error and a rank more once there are enough rows; before, a bracket is the whole class.
    few = lambda i: F.col(f"_n{i}") < 4 * accuracy
    width = [F.when(few(i), F.col(f"_n{i}")).otherwise(F.ceil(F.col(f"_n{i}") * (2 * margin + 2.0 / accuracy))).cast("long") for i, _, _ in wanted]
    end = lambda i, q, s: F.col(f"_s{i}")[F.when(few(i), 0 if s < 0 else len(shares) - 1).otherwise(shares.index(min(1.0, max(0.0, q + s))))]
    ends = first.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        F.array(*[F.col(f"_n{i}") for i, _, _ in wanted]).alias("_n"),
        F.array(*rank).alias("_rank"),
        F.array(*[end(i, q, -margin) for i, q, _ in wanted]).alias("_lo"),
        F.array(*[end(i, q, margin) for i, q, _ in wanted]).alias("_hi"),
        F.array(*width).alias("_width"),
    )
    ends = _settled(ends)
    most = lambda: ends.agg(F.max(F.array_max("_width"))).first()[0] or 0
    held = most()
    while held > small:
        ends = _narrowed(rows, keys, ends, len(wanted), len(points), accuracy)
        now = most()
        if now > 0.9 * held:  # equal values do not part, and are one value in what follows
            break
        held = now
    counted = _places(rows, keys, ends, len(wanted), len(points)).groupBy(*keys, "t", "x").agg(F.count("*").alias("m"))
    order = Window.partitionBy(*keys, "t").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counted.withColumn("upto", F.sum("m").over(order)).join(ends.select(*[f"_of_{k}" for k in keys], "_rank"), _on(keys, "_of_"))
    at = F.get("_rank", F.col("t"))
    low, high = F.floor(at), F.ceil(at)
    found = run.groupBy(*keys, "t").agg(
        F.min(F.when(F.col("x").isNotNull() & (F.col("upto") > low), F.col("x"))).alias("low"),
        F.min(F.when(F.col("x").isNotNull() & (F.col("upto") > high), F.col("x"))).alias("high"),
        F.max(F.when(F.col("x").isNull(), F.col("upto") > low)).alias("over"),
        F.first(at).alias("at"),
    )
    wrong = F.coalesce(F.col("over"), F.lit(False)) | F.col("low").isNull() | F.col("high").isNull()
    between = F.when(F.floor("at") == F.ceil("at"), F.col("low")).otherwise((F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high"))
    read = {"linear": between, "lower": F.col("low"), "higher": F.col("high")}
    value = reduce(lambda c, t: c.when(F.col("t") == t, read[wanted[t][2]]), range(len(wanted)), F.when(wrong, F.raise_error(F.lit("a rank is outside its bracket")).cast("double")))
    names = [f"{c}_{p}" for c in columns for p in points]
    wide = found.withColumn("v", value).groupBy(*keys).agg(*[F.max(F.when(F.col("t") == t, F.col("v"))).alias(n) for t, n in enumerate(names)])
    wide = wide.withColumnsRenamed({k: f"_w_{k}" for k in keys})
    made = [c for c in first.columns if not (c[:2] in ("_n", "_s") and c[2:].isdigit())]
    return first.join(wide, _on(keys, "_w_"), "left").select(*made, *names)
