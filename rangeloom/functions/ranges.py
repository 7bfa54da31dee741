"""Numeric ranges as columns and as SQL text, including wrap-around ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NumRange:
    """Closed range; a missing end is open; least > most wraps around (angles)."""

    least: float | None = None
    most: float | None = None

    @property
    def empty(self) -> bool:
        return self.least is None and self.most is None

    @property
    def inverted(self) -> bool:
        return self.least is not None and self.most is not None and self.least > self.most

    @property
    def symmetric(self) -> bool:
        """Whether the ends are the same distance from 0, but for a thousandth; such a range is one of magnitudes."""
        return self.least is not None and self.most is not None and self.least < self.most and self.most > 0 and abs(self.least + self.most) <= 0.001 * self.most

    def widened(self, by: float) -> NumRange:
        """Both ends moved outwards; a range that wraps around grows as well."""
        move = lambda x, d: None if x is None else x + d
        return NumRange(move(self.least, -by), move(self.most, by))


def range_condition(c: Column, r: NumRange) -> Column | None:
    """Condition of a range, pushed to the scan as plain comparisons; None for an open one."""
    if r.empty:
        return None
    if r.inverted:
        return ~c.between(r.most, r.least)
    if r.least is not None and r.least == r.most:
        return c == r.least
    if r.least is None:
        return c <= r.most
    if r.most is None:
        return c >= r.least
    if r.symmetric:
        return c.between(-r.most, r.most)
    return c.between(r.least, r.most)


def number(x: float) -> str:
    return f"{x:g}" if x == float(f"{x:g}") else repr(x)


def range_sql(name: str, r: NumRange) -> list[str]:
    """The same condition as SQL text: no or one string."""
    if r.empty:
        return []
    if r.inverted:
        return [f"{name} NOT BETWEEN {number(r.most)} AND {number(r.least)}"]
    if r.least is not None and r.least == r.most:
        return [f"{name} = {number(r.least)}"]
    if r.symmetric:
        return [f"abs({name}) <= {number(r.most)}"]
    if r.least is None:
        return [f"{name} <= {number(r.most)}"]
    if r.most is None:
        return [f"{name} >= {number(r.least)}"]
    return [f"{name} BETWEEN {number(r.least)} AND {number(r.most)}"]


def in_limits(c: Column, least: Column, most: Column, tolerance: float, null_is_fine: bool) -> Column:
    """Range test whose ends are columns; a null end is open, ends in the wrong order wrap around.

    The tolerance widens a plain range and, as the annotation pipeline has it, also moves
    the ends of a wrap-around one inwards.
    """
    lo, hi = least - tolerance, most + tolerance
    plain = (least.isNull() | (c >= lo)) & (most.isNull() | (c <= hi))
    around = ~c.between(most - tolerance, least + tolerance)
    ok = F.when(least.isNull() & most.isNull(), F.lit(True)).when(F.coalesce(least > most, F.lit(False)), around).otherwise(plain)
    ok = F.coalesce(ok, F.lit(False))
    return (ok | c.isNull()) if null_is_fine else ok
