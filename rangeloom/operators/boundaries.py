"""Filtering by a table of per-class ranges, and deriving such tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.functions.ranges import in_limits
from rangeloom.functions.scalars import circular_mean, wrap180

TOLERANCE = 0.01
#: A boundary table of more rows is joined by a shuffle.
BROADCAST_ROWS = 20_000


def limited(boundaries: DataFrame, params: list[str]) -> Column:
    """Whether a class has any limit at all."""
    ends = [F.col(f"{p}_{e}") for p in params for e in ("min", "max") if f"{p}_{e}" in boundaries.columns]
    return reduce(lambda a, b: a | b, [e.isNotNull() for e in ends], F.lit(False))


def apply_boundaries(
    df: DataFrame,
    boundaries: DataFrame,
    params: dict[str, Column],
    keys: tuple[str, ...] = ("family", "variant"),
    null_is_fine: bool = False,
    accepted: str | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Rows of ``df`` inside all ranges of their class; or, with ``accepted``, all rows marked.

    ``params`` names the boundary columns ``<name>_min`` and ``<name>_max`` and what they
    limit; names without boundary columns are skipped.  Classes compare without regard to
    case; a class that is absent or has no limits accepts nothing; of a repeated class its
    first row counts, in the order of the boundary frame.
    """
    used = [p for p in params if {f"{p}_min", f"{p}_max"} & set(boundaries.columns)]
    ends = {f"{p}_{e}": (F.col(f"{p}_{e}") if f"{p}_{e}" in boundaries.columns else F.lit(None)).cast("double") for p in used for e in ("min", "max")}
    folded = [f"_b_{k}" for k in keys]
    side = boundaries.where(limited(boundaries, used)).select(*[F.upper(k).alias(f"_b_{k}") for k in keys], *[v.alias(f"_b_{n}") for n, v in ends.items()], F.monotonically_increasing_id().alias("_at"))
    side = side.withColumn("_n", F.row_number().over(Window.partitionBy(*folded).orderBy("_at"))).where("_n = 1").drop("_n", "_at")
    few = side.head(BROADCAST_ROWS + 1)
    if len(few) <= BROADCAST_ROWS:  # read once; the local rows are what is broadcast
        side = F.broadcast(df.sparkSession.createDataFrame(few, side.schema))
    on = reduce(lambda a, b: a & b, [F.upper(F.col(k)) == F.col(f"_b_{k}") for k in keys])
    tests = [in_limits(params[p], F.col(f"_b_{p}_min"), F.col(f"_b_{p}_max"), tolerance, null_is_fine) for p in used]
    ok = reduce(lambda a, b: a & b, tests, F.col(f"_b_{keys[0]}").isNotNull())
    names = [F.col(c) for c in df.columns if c != accepted]
    if accepted is None:
        return df.join(side, on).where(ok).select(*names)
    return df.join(side, on, "left").select(*names, F.coalesce(ok, F.lit(False)).alias(accepted))


def outward(value: Column, kind: str, up: bool) -> Column:
    """Boundary rounding: tenths for lengths and shifts, fives for angles, always outwards."""
    unit = 0.1 if kind == "linear" else 5.0
    scaled = (value * 10 if kind == "linear" else value / unit)
    whole = (F.ceil(scaled) if up else F.floor(scaled)).cast("double")
    return whole / 10 if kind == "linear" else whole * unit


def derive_boundaries(df: DataFrame, keys: list[str], linear: list[str], angular: list[str], most_null: float = 0.1) -> DataFrame:
    """Long table (keys, param, boundary min/max, value) of each class's extent.

    A parameter with more than ``most_null`` nulls, or with one value or none, has no
    boundary.  Angles are centred on their circular mean, so their range may wrap around.
    """
    means = df.groupBy(*keys).agg(*[circular_mean(a).alias(f"_c_{a}") for a in angular]) if angular else None
    base = df
    if means is not None:
        k2 = means.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_c_{a}" for a in angular])
        base = df.join(F.broadcast(k2) if len(means.head(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS else k2, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]))
    value = lambda p: wrap180(F.col(p) - F.col(f"_c_{p}")) if p in angular else F.col(p)
    aggs = []
    for p in [*linear, *angular]:
        v = value(p)
        enough = (F.avg(v.isNull().cast("double")) <= most_null) & (F.count(v) > 1)
        centre = F.first(f"_c_{p}") if p in angular else F.lit(0.0)
        kind = "angular" if p in angular else "linear"
        lo, hi = F.min(v) + centre, F.max(v) + centre
        if p in angular:
            lo, hi = wrap180(lo), wrap180(hi)
        aggs.append(F.when(enough, F.struct(outward(F.round(lo, 9), kind, False).alias("min"), outward(F.round(hi, 9), kind, True).alias("max"))).alias(p))
    wide = base.groupBy(*keys).agg(*aggs)
    pairs = [F.struct(F.lit(p).alias("param"), F.lit(e).alias("boundary"), F.col(p)[e].alias("value")) for p in [*linear, *angular] for e in ("min", "max")]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def widen_boundaries(long: DataFrame, keys: list[str], params: list[str]) -> DataFrame:
    """Pivot to one row per class with ``<param>_min`` and ``<param>_max``."""
    names = [f"{p}_{e}" for p in params for e in ("min", "max")]
    return long.withColumn("_n", F.concat_ws("_", "param", "boundary")).groupBy(*keys).pivot("_n", names).agg(F.first("value"))
