"""Class statistics: aggregates, circular statistics, histograms, percentiles, ranks, KDE."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.functions.scalars import circular_mean, row_mean, row_sum, wrap180
from rangeloom.operators.selection import order_statistics


def parameter_stats(df: DataFrame, keys: list[str], params: list[str]) -> DataFrame:
    """avg, min, max, median, sample stddev and count of each parameter; medians by distributed selection."""
    aggs = []
    for p in params:
        aggs += [F.avg(p).alias(f"{p}_avg"), F.min(p).alias(f"{p}_min"), F.max(p).alias(f"{p}_max"), F.stddev(p).alias(f"{p}_stddev"), F.count(p).alias(f"{p}_count")]
    return order_statistics(df, keys, {p: F.col(p) for p in params}, {"median": (0.5, "linear")}, aggs)


def population_stats(df: DataFrame, keys: list[str], params: list[str]) -> DataFrame:
    """mean and population stddev; null for no value, stddev null for one."""
    aggs = []
    for p in params:
        aggs += [F.avg(p).alias(f"{p}_mean"), F.when(F.count(p) > 1, F.stddev_pop(p)).alias(f"{p}_std")]
    return order_statistics(df, keys, {p: F.col(p) for p in params}, {"p90": (0.9, "linear")}, aggs)


def _with_centre(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """``df`` with ``_centre``; classes are few, yet the join lets the planner choose."""
    centre = df.groupBy(*keys).agg(circular_mean(angle).alias("_centre")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_centre")
    return df.join(centre, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]))


def circular_stats(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """Circular mean, stddev about it (null for one value or none), and extent as min and max."""
    d = wrap180(F.col(angle) - F.col("_centre"))
    c = F.first("_centre")
    return _with_centre(df, keys, angle).groupBy(*keys).agg(
        c.alias("mean"), F.when(F.count(angle) > 1, F.sqrt(F.avg(d * d))).alias("std"), wrap180(c + F.min(d)).alias("min"), wrap180(c + F.max(d)).alias("max")
    )


def circular_percentiles(df: DataFrame, keys: list[str], angle: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(keys, min, max): the angles' percentiles about their circular mean, the low one rounded down to a value
    that is there, the high one up; 0 and 1 give the extent.  A class without angles has null."""
    d = wrap180(F.col(angle) - F.col("_centre"))
    got = order_statistics(_with_centre(df, keys, angle), keys, {"d": d}, {"low": (low, "lower"), "high": (high, "higher")}, [F.first("_centre").alias("_c")])
    return got.select(*keys, wrap180(F.col("_c") + F.col("d_low")).alias("min"), wrap180(F.col("_c") + F.col("d_high")).alias("max"))


def bin_of(x: Column, low: float, width: float, bins: int) -> Column:
    """Bin number, values outside the domain in the outer bins."""
    return F.least(F.greatest(F.floor((x - low) / width), F.lit(0)), F.lit(bins - 1)).cast("long")


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int, by: Column | None = None) -> DataFrame:
    """(label, bin, count) with empty bins as 0; without ``by`` the label is 0.  Nulls and NaN are left out."""
    label = F.lit(0) if by is None else by
    counted = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(label.cast("long").alias("label"), bin_of(F.col(x), low, (high - low) / bins, bins).alias("bin")).count()
    grid = counted.select("label").distinct().select(F.col("label").alias("_l"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")).alias("_b"))
    return grid.join(counted, (F.col("label") == F.col("_l")) & (F.col("bin") == F.col("_b")), "left").select(F.col("_l").alias("label"), F.col("_b").alias("bin"), F.coalesce("count", F.lit(0)).alias("count"))


def histogram_2d(df: DataFrame, x: str, y: str, domain: tuple[float, float, float, float], bins: int = 60) -> DataFrame:
    """(x_bin, y_bin, count) of the occupied cells; cells are rounded to the nearest grid point."""
    x0, x1, y0, y1 = domain
    cell = lambda c, a, b: F.least(F.greatest(F.floor((F.col(c) - a) / ((b - a) / bins) + 0.5), F.lit(0)), F.lit(bins - 1)).cast("long")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cell(x, x0, x1).alias("x_bin"), cell(y, y0, y1).alias("y_bin")).count()


#: Stripes of a class's range of values; each is ordered by a task of its own.
STRIPES = 256


def striped(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """``df`` with ``_stripe``: the place of x in its class's range, 0 for the greatest values, a
    stripe of its own for null and NaN.

    Equal values are in one stripe and a greater value is in no later one, so stripes can be
    ordered apart and their totals added up.  The ranges are one small row a class.
    """
    number = F.col(x).cast("double")
    fine = F.when(~F.isnan(number), number)
    ends = df.groupBy(*keys).agg(F.min(fine).alias("_low"), F.max(fine).alias("_high")).select(*[F.col(k).alias(f"_e_{k}") for k in keys], "_low", "_high")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys])
    place = F.floor(F.coalesce(F.try_divide(F.col("_high") - number, F.col("_high") - F.col("_low")), F.lit(0.0)) * (STRIPES - 1))
    stripe = F.when(number.isNull(), STRIPES).when(F.isnan(number), -1).otherwise(place).cast("int")
    return df.join(ends, on, "left").select(*df.columns, stripe.alias("_stripe"))


def before_stripe(df: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """(keys as _o_<key>, _s, _before, _all): the sum of ``total`` over earlier stripes and over the class."""
    sums = df.groupBy(*keys, "_stripe").agg(total.alias("_sum"))
    w = Window.partitionBy(*keys)  # STRIPES + 2 rows a class at most
    before = F.coalesce(F.sum("_sum").over(w.orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_stripe").alias("_s"), before.alias("_before"), F.sum("_sum").over(w).alias("_all"))


def rank_quantile(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """Descending average rank mapped to 0..1 within the class.

    Equal values share a rank, so they are counted before anything is ordered: only
    distinct values are ranked, stripe by stripe of the class's range, and the result is
    joined back to the rows.
    """
    counted = striped(df.groupBy(*keys, x).agg(F.count("*").alias("_n")), keys, x)
    offsets = before_stripe(counted, keys, F.sum("_n"))
    at = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]) & (F.col("_stripe") == F.col("_s"))
    inside = Window.partitionBy(*keys, "_stripe").orderBy(F.col(x).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, at)
    value = (F.col("_before") + F.col("_in") + (F.col("_n") - 1) / 2.0) / F.greatest(F.col("_all") - 1, F.lit(1))
    ranked = counted.select(*[F.col(c).alias(f"_r_{c}") for c in [*keys, x]], value.alias(out))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in [*keys, x]])
    return df.join(ranked, on, "left").select(*df.columns, out)


def masked_quantile(df: DataFrame, keys: list[str], x: str, ties: list[Column], accepted: str, out: str) -> DataFrame:
    """Share of the class's accepted rows that stand at or before the row, by descending x (nulls
    last) and ``ties``.

    Stripes of the class's range are ordered by tasks of their own; a row's sum is that of
    the stripes before it and of its place in its own.
    """
    flag = F.coalesce(F.col(accepted).cast("int"), F.lit(0))
    rows = striped(df, keys, x)
    offsets = before_stripe(rows, keys, F.sum(flag))
    at = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]) & (F.col("_stripe") == F.col("_s"))
    inside = Window.partitionBy(*keys, "_stripe").orderBy(F.col(x).desc_nulls_last(), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_in", F.sum(flag).over(inside)).join(offsets, at)
    return rows.select(*df.columns, F.try_divide((F.col("_before") + F.col("_in")).cast("double"), F.col("_all").cast("double")).alias(out))


def combine_quantiles(cols: list[str]) -> dict[str, Column]:
    """mean, harmonic mean, product, least and second least of quantile columns."""
    cs = [F.col(c) for c in cols]
    return {
        "quantile_mean": row_mean(*cs),
        "quantile_hmean": F.lit(1.0) / row_mean(*[F.lit(1.0) / (c + 0.01) for c in cs]) - 0.01,
        "quantile_prod": reduce(lambda a, b: a * b, [F.coalesce(c, F.lit(1.0)) for c in cs]),
        "quantile_min": F.least(*cs),
        "quantile_min2": F.element_at(F.array_sort(F.array(*cs)), 2),
    }


def mode_deviation(params: dict[str, tuple[Column, Column]], angular: set[str] = frozenset()) -> dict[str, Column]:
    """abs(x - mode) / std per parameter and ``mode_deviations``, their mean with nulls as 2."""
    out = {}
    for p, (mode, std) in params.items():
        d = F.col(p) - mode
        out[f"{p}_mode_deviation"] = F.try_divide(F.abs(wrap180(d) if p in angular else d), std)
    out["mode_deviations"] = row_sum(*[F.coalesce(c, F.lit(2.0)) for c in out.values()]) / len(params)
    return out


def nicest_rows(df: DataFrame, keys: list[str], score: Column, accepted: str, ties: list[str]) -> DataFrame:
    """The accepted row of highest score per class; ties by the given columns."""
    w = Window.partitionBy(*keys).orderBy(score.desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties])
    return df.where(accepted).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


KDE_SAMPLE = 15_000


def kde_log_likelihood(x: np.ndarray, sample: np.ndarray, factor: float = 1.5, block: int = 2_000) -> np.ndarray:
    """Log density at ``x`` of a Gaussian KDE over ``sample``, Scott's rule times ``factor``."""
    n = len(sample)
    h = n ** (-0.2) * factor * sample.std(ddof=1)
    if not h > 0:
        return np.full(len(x), np.nan)
    out = np.empty(len(x))
    for i in range(0, len(x), block):
        z = -0.5 * ((x[i : i + block, None] - sample) / h) ** 2
        top = z.max(axis=1)
        out[i : i + block] = top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - np.log(n * h * np.sqrt(2 * np.pi))
    return out


def lowest_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each class; ``_salt`` deals a class to tasks that each keep ``n`` first."""
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = df.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n)
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def kde_likelihood(df: DataFrame, keys: list[str], row: list[str], x: str, angular: bool = False, sample: int | None = KDE_SAMPLE, rows_per_task: int = 1_000_000) -> DataFrame:
    """(keys, row, ``log_likelihood``, ``mode``): density of each value within its class.

    The density is that of a deterministic sample (lowest hashes of ``row``) of at most
    ``sample`` values, a size bound that goes with the method (None: all values of the class,
    which must then fit into a task); every row is evaluated.
    Rows are dealt to salted parts of their class, each with a copy of the sample, so no
    class has to fit into one task.  Fewer than five values or no spread: null.  Angles are
    mirrored by a turn on both sides.  ``mode`` is the sample value of highest density.
    """
    named = df.where(F.col(x).isNotNull()).select(*keys, *row, F.col(x).cast("double").alias("_x"))
    salts = max(1, -(-named.count() // rows_per_task))
    order = F.xxhash64(*[F.col(r).cast("string") for r in row])
    chosen = named if sample is None else lowest_rows(named.withColumn("_salt", F.pmod(order, F.lit(salts)).cast("int")), keys, [order, *map(F.col, row)], sample).drop("_salt")
    samples = chosen.select(*keys, F.col("_x").alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    dealt = named.withColumn("_salt", F.pmod(order, F.lit(salts)).cast("int"))
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, *row]) + ", log_likelihood double, mode double"

    def evaluate(rows: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = rows[[*keys, *row]].copy()
        s = np.sort(part["_s"].to_numpy(float))
        value, mode = np.full(len(rows), np.nan), None
        if len(s) >= 5:
            data = np.concatenate([s - 360, s, s + 360]) if angular else s
            value = kde_log_likelihood(rows["_x"].to_numpy(float), data)
            at = kde_log_likelihood(s, data)
            mode = None if np.isnan(at).all() else float(s[np.argmax(at)])
        out["log_likelihood"] = pd.Series(value, index=rows.index).astype(object).where(~np.isnan(value), None)
        out["mode"] = mode
        return out

    return dealt.groupBy(*keys, "_salt").cogroup(samples.groupBy(*keys, "_salt")).applyInPandas(evaluate, schema)


def percentile_bands(df: DataFrame, keys: list[str], params: list[str], points: dict[str, float]) -> DataFrame:
    """Linear percentiles of each parameter, named ``{parameter}_{point}``."""
    return order_statistics(df, keys, {p: F.col(p) for p in params}, {n: (q, "linear") for n, q in points.items()})


def trim_quantiles(df: DataFrame, cols: list[str], q: float) -> DataFrame:
    """Rows within the q and 1 - q percentiles, one column after the other.

    Each column's limits come from what the columns before it left; nulls go.
    """
    for c in cols:
        ends = order_statistics(df, [], {"_": F.col(c)}, {"low": (q, "linear"), "high": (1 - q, "linear")}).first()
        df = df.where(F.col(c).between(ends["__low"], ends["__high"]))
    return df


def rolling_bucket_means(df: DataFrame, x: str, y: str, low: float, width: float) -> DataFrame:
    """(bucket, mean, count): means of y over overlapping buckets, each two widths of x long."""
    b = F.floor((F.col(x) - low) / width)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.explode(F.array(b, b + 1)).alias("bucket"), F.col(y).alias("_y"))
    return rows.groupBy("bucket").agg(F.avg("_y").alias("mean"), F.count("*").alias("count"))


def merge_symmetric(df: DataFrame, keys: list[str], mirrored: dict[str, str]) -> DataFrame:
    """Both readings of symmetric pairs in the same columns: each row as it is and mirrored.

    ``mirrored`` maps each column to the one that takes its place when the sides are
    exchanged.  One scan; the two readings are an array of two structs.
    """
    own = F.struct(*[F.col(c).alias(c) for c in mirrored])
    other = F.struct(*[F.col(m).alias(c) for c, m in mirrored.items()])
    return df.select(*keys, F.explode(F.array(own, other)).alias("_r")).select(*keys, "_r.*")


def stddev_or_one(x: str) -> Column:
    """Sample stddev, 1 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(1.0))


def class_counts(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Total and one count per flag, with ``score`` = high + medium / 100 where both are flags."""
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return out.withColumn("score", F.col("high") + F.col("medium") / 100) if {"high", "medium"} <= set(flags) else out


def curve_summary(sample: np.ndarray, points: int = 200, share: float = 0.05) -> tuple[float | None, float | None, float | None]:
    """(mode, low, high) of a KDE: the densest sample value around the curve's top, and the
    points that leave ``share`` of the curve's area on either side.  Fewer than five values
    or no spread: nulls.
    """
    if len(sample) < 5 or not np.ptp(sample) > 0:
        return None, None, None
    grid = np.linspace(sample.min(), sample.max(), points)
    density = kde_log_likelihood(grid, sample)
    top = int(np.argmax(density))
    near = sample[(sample >= grid[max(0, top - 1)]) & (sample <= grid[min(points - 1, top + 1)])]
    mode = float(near[np.argmax(kde_log_likelihood(near, sample))]) if len(near) else float(grid[top])
    area = np.cumsum(np.exp(density))
    low, high = np.interp([share, 1 - share], area / area[-1], grid)
    return mode, float(low), float(high)


def kde_curve(df: DataFrame, keys: list[str], row: list[str], x: str, sample: int | None = KDE_SAMPLE, rows_per_task: int = 1_000_000) -> DataFrame:
    """(keys, ``mode``, ``low``, ``high``) of each class's KDE over the sample of ``kde_likelihood``."""
    named = df.where(F.col(x).isNotNull()).select(*keys, *row, F.col(x).cast("double").alias("_x"))
    order = F.xxhash64(*[F.col(r).cast("string") for r in row])
    salts = max(1, -(-named.count() // rows_per_task))
    chosen = named if sample is None else lowest_rows(named.withColumn("_salt", F.pmod(order, F.lit(salts)).cast("int")), keys, [order, *map(F.col, row)], sample)
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys) + ", mode double, low double, high double"

    def summarise(part: pd.DataFrame) -> pd.DataFrame:
        got = curve_summary(np.sort(part["_x"].to_numpy(float)))
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, **{n: pd.Series([v], dtype=object) for n, v in zip(("mode", "low", "high"), got, strict=True)}})

    return chosen.select(*keys, "_x").groupBy(*keys).applyInPandas(summarise, schema)
