"""The filter model: a serialisable filter as conditions, SQL text and query."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.ranges import NumRange, range_condition, range_sql
from rangeloom.functions.scalars import is_dna, row_min


@dataclass(frozen=True)
class PairFilter:
    """Ranges of named parameters and the few predicates beside them."""

    ranges: dict[str, NumRange] = field(default_factory=dict)
    min_bond_length: NumRange = NumRange()
    bonds: tuple[str, ...] = ("hb_0", "hb_1", "hb_2")
    accepted: str | None = None
    kind: str | None = None  # "DNA" or "RNA"
    residues: tuple[str, str] = ("res1", "res2")
    sql: tuple[str, ...] = ()

    def conditions(self) -> list[Column]:
        out = [F.col(self.accepted)] if self.accepted else []
        for name, r in self.ranges.items():
            c = range_condition(F.col(name), r)
            if c is not None:
                out.append(c)
        bond = range_condition(row_min(*self.bonds), self.min_bond_length)
        if bond is not None:
            out.append(bond)
        if self.kind:
            dna = [is_dna(r) for r in self.residues]
            out.append((dna[0] | dna[1]) if self.kind == "DNA" else (~dna[0] | ~dna[1]))
        return out + [F.expr(s) for s in self.sql]

    def sql_conditions(self) -> list[str]:
        out = [self.accepted] if self.accepted else []
        for name, r in self.ranges.items():
            out += range_sql(name, r)
        out += range_sql(f"least({', '.join(self.bonds)})", self.min_bond_length)
        if self.kind:
            a, b = self.residues
            out.append(f"({a} {'' if self.kind == 'DNA' else 'NOT '}LIKE 'D%' or {b} {'' if self.kind == 'DNA' else 'NOT '}LIKE 'D%')")
        return out + list(self.sql)

    def condition(self) -> Column:
        out = F.lit(True)
        for c in self.conditions():
            out &= c
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        for c in self.conditions():
            df = df.where(c)
        return df


def join_conditions(conditions: list[str], operator: str = "AND") -> str:
    """Conditions as one SQL expression; those with an OR or a subquery get parentheses."""
    if not conditions:
        return "true" if operator.upper() == "AND" else "false"
    wrap = lambda c: f"({c})" if any(w in c.lower().split() for w in ("or", "select")) and not (c.startswith("(") and c.endswith(")")) else c
    return f" {operator} ".join(map(wrap, conditions))


def build_select(source: str, cols: str = "*", where: list[str] | None = None, order_by: str | None = None, limit: int | None = None) -> str:
    """SELECT text."""
    out = f"SELECT {cols} FROM {source}"
    if where:
        out += f" WHERE {join_conditions(where)}"
    if order_by:
        out += f" ORDER BY {order_by}"
    return out + (f" LIMIT {limit}" if limit is not None else "")


def filter_sql(f: PairFilter, source: str, **select) -> str:
    return build_select(source, where=f.sql_conditions(), **select)


def filter_difference(a: PairFilter, b: PairFilter) -> tuple[list[str], list[str]]:
    """(added, removed) conditions from a to b, each in its own order."""
    x, y = a.sql_conditions(), b.sql_conditions()
    return [c for c in y if c not in x], [c for c in x if c not in y]


def capped_bonds(f: PairFilter, atoms: dict[str, tuple[str, str]], plain: float = 4.0, wide: float = 4.2) -> PairFilter:
    """Length caps per bond: ``wide`` with a carbon or O2' atom and from the third bond on, else ``plain``."""
    ranges = dict(f.ranges)
    for i, bond in enumerate(f.bonds):
        cap = wide if i >= 2 or any(a.startswith("C") or a == "O2'" for a in atoms.get(bond, ())) else plain
        r = ranges.get(bond, NumRange())
        ranges[bond] = NumRange(r.least, cap if r.most is None else min(cap, r.most))
    return replace(f, ranges=ranges)


#: Orders by name as ORDER BY text; fixed values of the gallery's order menu.  The empty one keeps the stored order.
ORDERS: dict[str, str] = {
    "pdbid": "",
    "pdbidD": "pdbid DESC, model DESC, chain1 DESC, nr1 DESC",
    "resolutionA": "resolution NULLS LAST, pdbid, model, chain1, nr1",
    "modedevA": "mode_deviations",
    "modedevD": "-mode_deviations",
    "LLD": "-log_likelihood",
    "LLA": "log_likelihood",
    "rmsdA": "(rmsd_edge1+rmsd_edge2)",
    "rmsdD": "(rmsd_edge1+rmsd_edge2) DESC",
    "quantile_hmean_Q": "quantile_hmean_Q DESC",
    "quantile_hmean_QA": "quantile_hmean_Q ASC",
    "quantile_mean_Q": "quantile_mean_Q DESC",
    "quantile_mean_QA": "quantile_mean_Q ASC",
}
DIRECTION = re.compile(r"^(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?$", re.I | re.S)


def split_list(text: str) -> list[str]:
    """Parts of a SQL list, cut at commas outside of parentheses and quotes."""
    parts, depth, quote = [""], 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        else:
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                parts.append("")
                continue
        parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def sort_keys(text: str) -> list[Column]:
    """Sort columns of ORDER BY text: expressions, ASC or DESC, NULLS FIRST or LAST (by default last)."""
    keys = []
    for part in split_list(text):
        expr, way, nulls = DIRECTION.match(part).groups()
        down, first = (way or "").lower() == "desc", (nulls or "").lower() == "first"
        c = F.expr(expr)
        keys.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return keys


def order_by(df: DataFrame, preset: str) -> DataFrame:
    """A named order (``ORDERS``) or any ORDER BY text; nulls come last unless it says otherwise."""
    keys = sort_keys(ORDERS.get(preset, preset))
    return df.orderBy(*keys) if keys else df


def page(df: DataFrame, order: str, size: int, number: int = 0) -> DataFrame:
    """One page of an ordered result; pages are numbered from 0."""
    return order_by(df, order).offset(size * number).limit(size)


def select_columns(df: DataFrame, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """Columns whose whole name fits ``keep`` and not ``drop``, two regular expressions."""
    names = [c for c in df.columns if (keep is None or re.fullmatch(keep, c)) and not (drop and re.fullmatch(drop, c))]
    return df.select(*[F.col(f"`{c}`") for c in names])


def both_in(sides: tuple[str, str], values: list, second: list | None = None) -> Column:
    """Whether both residues are among the values, the other one among ``second`` where that is given; null counts as no."""
    return F.coalesce(F.col(sides[0]).isin(values) & F.col(sides[1]).isin(values if second is None else second), F.lit(False))


def identity_and_stats(df: DataFrame, ids: list[str], comparison: tuple[str, ...] = ("comparison_in_baseline", "comparison_in_current"), stats: str = r".*(_quantile|_likelihood|_deviations?|quantile_.*)") -> DataFrame:
    """Identity columns, comparison flags that are there, and the columns of computed statistics."""
    flags = [c for c in comparison if c in df.columns]
    rest = [c for c in df.columns if c not in ids and c not in flags and re.fullmatch(stats, c)]
    return df.select(*ids, *flags, *rest)


def limits_verdict(df: DataFrame, ranges: dict[str, NumRange]) -> DataFrame:
    """Columns ``<name>_in_range``: null for an open range, else true or false; a null value is outside."""
    in_range = lambda c, r: F.lit(None).cast("boolean") if r.empty else F.coalesce(range_condition(c, r), F.lit(False))
    return df.select("*", *[in_range(F.col(n), r).alias(f"{n}_in_range") for n, r in ranges.items()])


def describe_row(df: DataFrame, keys: list[str], params: list[str]) -> DataFrame:
    """Wide to long: (keys, name, value, value_quantile) with the quantile column where there is one."""
    rows = [F.struct(F.lit(p).alias("name"), F.col(p).cast("double").alias("value"), (F.col(f"{p}_quantile") if f"{p}_quantile" in df.columns else F.lit(None)).cast("double").alias("value_quantile")) for p in params]
    return df.select(*keys, F.inline(F.array(*rows)))


def without_symmetric(df: DataFrame, first: str, second: str, any_side: bool = False) -> DataFrame:
    """Drop pairs whose sides both are symmetry copies, or with ``any_side`` those with one."""
    a, b = F.col(first).isNull(), F.col(second).isNull()
    return df.where(a & b if any_side else a | b)


def quality_flags(fine: list[str], coarse: list[str]) -> dict[str, Column]:
    """high (on a list of fine structures), medium (on a coarse one) and some (either)."""
    on = lambda cs: F.exists(F.array(*cs), lambda x: F.coalesce(x, F.lit(False)))
    return {"high": on(fine), "medium": on(coarse), "some": on([*fine, *coarse])}


def any_bond_below(bonds: list[str], most: float) -> Column:
    """Whether any bond that is there is shorter than ``most``; all null: false."""
    return F.exists(F.array(*bonds), lambda x: F.coalesce(x < most, F.lit(False)))
