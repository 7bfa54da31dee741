"""Declared constraints, checked in the scan that reads the rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

POLICIES = ("fail", "drop", "count")


@dataclass(frozen=True)
class Constraint:
    """A named condition (SQL text) that rows keep; null counts as kept only with ``null_is_fine``."""

    name: str
    condition: str
    policy: str = "count"
    null_is_fine: bool = False

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"no such policy: {self.policy}")

    def kept(self) -> Column:
        return F.coalesce(F.expr(self.condition), F.lit(self.null_is_fine))


def violations(constraints: list[Constraint]) -> list[Column]:
    """One count per constraint, and ``rows``: aggregates for a single pass."""
    return [F.count(F.lit(1)).alias("rows"), *[F.count_if(~c.kept()).alias(c.name) for c in constraints]]


def checked(df: DataFrame, constraints: list[Constraint], observed: Observation | None = None) -> DataFrame:
    """``df`` without the rows that a ``drop`` constraint refuses; a row that a ``fail`` constraint refuses
    is an error when it is read.

    With ``observed`` all constraints are counted, over all rows, by the same pass that serves the result; the
    counts are there after its first action.
    """
    if observed is not None:
        df = df.observe(observed, *violations(constraints))
    for c in (c for c in constraints if c.policy == "fail"):
        told = F.concat(F.lit(f"{c.name} does not hold: "), F.to_json(F.struct(*[F.col(f"`{n}`") for n in df.columns])))
        df = df.where(F.when(c.kept(), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    drops = [c.kept() for c in constraints if c.policy == "drop"]
    return df.where(reduce(lambda a, b: a & b, drops)) if drops else df


def report(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """(name, policy, violations, rows) of every constraint, from one pass."""
    sums = df.agg(*violations(constraints))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(c.policy).alias("policy"), F.col(c.name).alias("violations"), F.col("rows").alias("rows")) for c in constraints])))


def one_value(df: DataFrame, value: Column) -> DataFrame:
    """(same, least, most): whether all rows have one value, nulls aside; an empty frame has."""
    ends = df.agg(F.min(value).alias("least"), F.max(value).alias("most"))
    return ends.select(F.coalesce(F.col("least") == F.col("most"), F.lit(True)).alias("same"), "least", "most")


def one_schema(*frames: DataFrame) -> list[set[str]]:
    """The columns that each frame lacks of all that occur."""
    every = set().union(*[f.columns for f in frames])
    return [every - set(f.columns) for f in frames]
