"""Scalar expressions: angles, rounding, row-wise reductions, identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wrap180(angle: Column | str) -> Column:
    """Degrees to [-180, 180)."""
    return F.pmod(col(angle) + 180.0, F.lit(360.0)) - 180.0


def round_sig(x: Column | str, figures: int) -> Column:
    """Round to significant figures; 0 and null stay."""
    x = col(x)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (figures - 1))
    return F.when(x == 0, x.cast("double")).otherwise(F.round(x / unit) * unit)


def row_min(*cs: Column | str) -> Column:
    """Least of the non-null values."""
    return F.least(*map(col, cs)) if len(cs) > 1 else col(cs[0])


def row_sum(*cs: Column) -> Column:
    return reduce(lambda a, b: a + b, cs)


def row_mean(*cs: Column | str) -> Column:
    """Mean of the non-null values; null if there is none."""
    cs = tuple(map(col, cs))
    return F.try_divide(row_sum(*[F.coalesce(c, F.lit(0.0)) for c in cs]), row_sum(*[c.isNotNull().cast("int") for c in cs]))


def is_dna(residue: Column | str) -> Column:
    return col(residue).startswith("D")


def null_if_blank(c: Column | str) -> Column:
    """Insertion and variant codes: '', ' ', '?' and NUL mean none."""
    t = F.trim(col(c))
    return F.when(t.isin("", "?", "\0"), F.lit(None)).otherwise(t)


def pair_id(pdbid: Column, model: Column, sides: list[tuple[Column, Column, Column, Column]]) -> Column:
    """pdbid-model-chain_alt nr ins-... with missing parts empty; a side is (chain, alt, nr, ins)."""
    e = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [F.concat(e(c), F.lit("_"), e(a), e(n), e(i)) for c, a, n, i in sides]
    return F.concat_ws("-", pdbid, model.cast("string"), *parts)


def circular_mean(angle: Column | str) -> Column:
    """Aggregate: mean direction in degrees."""
    a = F.radians(col(angle))
    return F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))))


def packed_flags(*flags: Column) -> Column:
    """Bit i is set where flag i is true."""
    return row_sum(*[F.coalesce(f, F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(flags)])
