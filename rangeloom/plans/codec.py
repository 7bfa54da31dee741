"""Filters as URLs and class selectors as predicates."""

from __future__ import annotations

import re
from decimal import Decimal
from math import isfinite
from urllib.parse import parse_qsl, quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeloom.functions.ranges import NumRange
from rangeloom.operators.filters import PairFilter

#: Short names of bond parameters in URLs.
BOND_KEYS = {"L": "length", "DA": "donor_angle", "AA": "acceptor_angle", "OOPA1": "OOPA1", "OOPA2": "OOPA2"}


#: Data sources that old links name by the letters f (filtered) and n (near pairs too).
LEGACY_SOURCES = {"": "fr3d", "f": "fr3d-f", "n": "fr3d-n", "fn": "fr3d-nf"}


def range_end(text: str) -> float | None:
    """One end of a range; nothing is an open end, and what is no finite number is an error."""
    if not text:
        return None
    value = float(text)
    if not isfinite(value):
        raise ValueError(f"not an end of a range: {text}")
    return value


def parse_range(text: str) -> NumRange:
    """``least..most``, either end open; no text at all is an open range, any other text an error."""
    least, dots, most = text.strip().partition("..")
    if least and not dots:
        raise ValueError(f"not a range: {text}")
    return NumRange(range_end(least), range_end(most))


def range_text(r: NumRange) -> str:
    """The range in plain decimals, to the last digit."""
    end = lambda x: "" if x is None else f"{Decimal(repr(float(x))).normalize():f}"
    return f"{end(r.least)}..{end(r.most)}"


def to_url(family: str, f: PairFilter, source: str = "") -> str:
    """Path and query of a filter: ``class/hb0_L=..3.4&range_x=1..2&sql=...``."""
    short = {v: k for k, v in BOND_KEYS.items()}
    parts = [f"ds={source}"] if source else []
    for name, r in f.ranges.items():
        m = re.match(r"^hb_(\d+)_(\w+)$", name)
        key = f"hb{m[1]}_{short[m[2]]}" if m and m[2] in short else f"range_{name}"
        parts.append(f"{key}={range_text(r)}")
    if not f.min_bond_length.empty:
        parts.append(f"min_bond={range_text(f.min_bond_length)}")
    if f.kind:
        parts.append(f"kind={f.kind}")
    if f.accepted:
        parts.append(f"accepted={f.accepted}")
    parts += [f"sql={quote(s, safe='')}" for s in f.sql]
    return "/".join([quote(family, safe="-"), "&".join(parts)])


def parse_url(url: str) -> tuple[str, PairFilter, str]:
    """(class, filter, data source) of a URL; what is no filter part is ignored.

    A limit that is no range is an error, so no filter is lost.  Of old links ``f=`` gives the source and
    the kind; a source that ends in D or R is one of DNA or RNA.
    """
    path, _, query = url.partition("/")
    ranges: dict[str, NumRange] = {}
    least, kind, accepted, source, sql = NumRange(), None, None, "", []
    for key, value in parse_qsl(query, keep_blank_values=True):
        m = re.match(r"^hb(\d+)_(\w+)$", key)
        if m and m[2] in BOND_KEYS:
            ranges[f"hb_{m[1]}_{BOND_KEYS[m[2]]}"] = parse_range(value)
        elif key.startswith("range_"):
            ranges[key[6:]] = parse_range(value)
        elif key == "min_bond":
            least = parse_range(value)
        elif key == "kind":
            kind = value
        elif key == "accepted":
            accepted = value
        elif key == "ds":
            source = value[:-1] if value[-1:] in ("D", "R") else value
            kind = {"D": "DNA", "R": "RNA"}.get(value[-1:], kind)
        elif key == "f":
            source = source or LEGACY_SOURCES["".join(x for x in "fn" if x in value)]
            kind = "DNA" if "D" in value else "RNA" if "R" in value else kind
        elif key == "sql":
            sql.append(value)
    return unquote(path), PairFilter(ranges, min_bond_length=least, accepted=accepted, kind=kind, sql=tuple(sql)), source


def panels_to_url(panels: list[tuple[str, str | None]]) -> str:
    """Statistics panels: each a column with an optional condition."""
    return "&".join("stat=" + quote(c if not where else f"{c} WHERE {where}", safe="") for c, where in panels)


def panels_from_url(query: str) -> list[tuple[str, str | None]]:
    out = []
    for key, value in parse_qsl(query):
        if key == "stat":
            col, _, where = value.partition(" WHERE ")
            out.append((col, where or None))
    return out


CLASS = re.compile(r"^(n?)([ct])([WHSB])([WHSB])(a?)(?:-([ACGUT])-([ACGUT]))?$", re.I)


def parse_class(text: str) -> tuple[str, str, str, str, str] | None:
    """(near, orientation and edges, variant, base 1, base 2) of ``cWW-A-U``, ``A-U-cWW`` or ``cWW``."""
    m = CLASS.match(text) or CLASS.match("-".join([*text.split("-")[2:], *text.split("-")[:2]]))
    if not m:
        return None
    return (m[1].lower(), m[2].lower() + m[3] + m[4], m[5].lower(), (m[6] or "").upper(), (m[7] or "").upper())


def class_selector(text: str, family: Column, bases: Column) -> Column:
    """Predicate of a list such as ``*,n*,!cSS,c*HS,cWW-AC``.

    Items are families (``*`` matches one character of a class name, alone everything that
    is not near) with optional bases; ``!`` excludes.  A pair item beats a family item, a
    family item the default; of equal ones the later wins.  Nothing listed means all.
    """
    items = [i.strip() for i in text.split(",") if i.strip()]
    pair, fam = [], []
    default = not items or all(i.startswith("!") for i in items)
    for item in items:
        keep = not item.startswith("!")
        name, _, base = item.lstrip("!").partition("-")
        if name == "*":
            cond = ~F.lower(family).startswith("n")
        elif name == "n*":
            cond = F.lower(family).startswith("n")
        else:
            cond = F.lower(family).rlike("^" + re.escape(name.lower()).replace(r"\*", ".") + "$")
        if base:
            pair.append((cond & (F.upper(bases) == base.replace("-", "").upper()), keep))
        else:
            fam.append((cond, keep))
    out = F.lit(default)
    for cond, keep in [*fam, *pair]:
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(keep)).otherwise(out)
    return out
