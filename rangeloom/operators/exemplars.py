"""Distances of pairs to exemplars of their class, fitted from sums.

Atoms meet the exemplar's by an equi-join.  What a best fit needs of a pair is a handful of sums, made by one
aggregation for all variants; the rotations of a batch of pairs are one stacked decomposition.
The fits then go back to the atoms, whose distances are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
#: Exemplar atoms up to which they are broadcast.
EXEMPLARS_BROADCAST = 100_000


@dataclass(frozen=True)
class Variant:
    """A fit and the atoms it is measured on, as SQL conditions over the atoms' columns.

    Without ``frame`` the fit is the best one over the atoms of ``fit``; with it, the one that lays a
    frame on the exemplar's, where ``frame`` says of an atom whether it is the origin (0), the end of the y axis (1)
    or the atom towards which x points (2).
    """

    name: str
    fit: str = "true"
    measure: str = "true"
    frame: str | None = None


#: Atoms that define a base's frame, and the bond's neighbours it is measured on; purines, then pyrimidines.
PURINE, PYRIMIDINE = ("A", "G", "DA", "DG"), ("C", "U", "T", "DC", "DU", "DT")


def base_variants(res: str = "res", edge: str = "edge", base: str = "base") -> list[Variant]:
    """The six variants of a pair table whose atoms have ``side`` (1, 2), ``atom``, the residue's name, and flags
    for atoms of the pairing edge and of the base."""
    n = f"case when {res} in {PURINE} then 'N9' when {res} in {PYRIMIDINE} then 'N1' end"
    beside = f"case when {res} in {PURINE} then 'C8' when {res} in {PYRIMIDINE} then 'C6' end"
    across = f"case when {res} in {PURINE} then 'C4' when {res} in {PYRIMIDINE} then 'C2' end"
    frame = lambda side: f"case when side <> {side} then null when atom = {n} then 0 when atom = 'C1''' then 1 when atom = {beside} then 2 end"
    core = f"(atom = 'C1''' or atom = {n} or atom = {beside} or atom = {across})"
    return [
        Variant("C1N_frames1", measure=f"side = 2 and {core}", frame=frame(1)),
        Variant("C1N_frames2", fit=f"side = 2 and {core}", measure=f"side = 1 and {core}"),
        Variant("edge1", fit=f"side = 1 and {base}", measure=f"side = 2 and {edge}"),
        Variant("edge2", fit=f"side = 2 and {base}", measure=f"side = 1 and {edge}"),
        Variant("edge_C1N_frame", fit=edge, measure=core),
        Variant("all_base", fit=base, measure=base),
    ]


def rotations(h: np.ndarray) -> np.ndarray:
    """Of each 3x3 cross-covariance the rotation r that brings rows a to b as a @ r."""
    u, _, vt = np.linalg.svd(h)
    turn = np.sign(np.linalg.det(u @ vt))
    turn[turn == 0] = 1.0
    u[:, :, 2] *= turn[:, None]
    return u @ vt


def frames(origin: np.ndarray, y_to: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Right-handed axes of many frames, as rows; NaN where three points define none."""
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
        y = unit(origin - y_to)
        p = plane - origin
        x = unit(p - (p * y).sum(axis=1, keepdims=True) * y)
    return np.stack([x, y, np.cross(x, y)], axis=1)


def _clean(atoms: DataFrame, keys: list[str], xyz: tuple[str, str, str], more: list[str]) -> DataFrame:
    """One row per atom, of repeated ones that of least coordinates; atoms without all coordinates go."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in xyz])
    least = F.min(F.struct(*[F.col(c).cast("double").alias(n) for c, n in zip(xyz, XYZ, strict=True)], *[F.col(c) for c in more]))
    return atoms.where(full).groupBy(*keys).agg(least.alias("_p")).select(*keys, *[F.col(f"_p.{n}").alias(n) for n in XYZ], *[F.col(f"_p.{c}").alias(c) for c in more])


def rmsd_variants(atoms: DataFrame, pair: list[str], label: str, exemplars: DataFrame, variants: list[Variant], atom: list[str] = ("side", "atom"), xyz: tuple[str, str, str] = XYZ, more: list[str] = ()) -> DataFrame:
    """(pair, label, ``rmsd_<variant>``): mean distance of each pair's atoms to its class's exemplar after the fit.

    ``exemplars`` has (label, atom, xyz).  Atoms that one side lacks count in neither.  A fit over fewer than three
    atoms, a frame that three points do not define, nothing to measure, or a class without exemplar: null.  ``more`` are
    columns of ``atoms`` that the variants' conditions use.  The column is a mean of distances, as named.
    """
    atom, more = list(atom), list(more)
    keys = [*pair, label]
    told = _clean(exemplars, [label, *atom], xyz, []).withColumnsRenamed({label: "_label"} | {a: f"_{a}" for a in atom} | {n: f"b{i}" for i, n in enumerate(XYZ)})
    if told.limit(EXEMPLARS_BROADCAST + 1).count() <= EXEMPLARS_BROADCAST:
        told = F.broadcast(told)
    same = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"_{a}") for a in atom], F.col(label) == F.col("_label"))
    met = _clean(atoms, [*keys, *atom], xyz, more).withColumnsRenamed({n: f"a{i}" for i, n in enumerate(XYZ)}).join(told, same)
    points = [F.col(f"{s}{i}") for s in "ab" for i in range(3)]

    def parts(condition: str) -> Column:
        rows = [F.when(F.expr(getattr(v, condition) if v.frame is None or condition == "measure" else f"({v.frame}) is not null"), F.struct(F.lit(n).alias("v"), (F.expr(v.frame) if v.frame and condition == "fit" else F.lit(None)).cast("int").alias("role"))) for n, v in enumerate(variants)]
        return F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("_r")

    used = met.select(*keys, *points, parts("fit")).select(*keys, *points, "_r.v", "_r.role")
    sums = [F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(points)], *[F.sum(points[i] * points[3 + j]).alias(f"h{i}{j}") for i in range(3) for j in range(3)]]
    corners = [F.max(F.when(F.col("role") == r, p)).alias(f"r{r}{i}") for r in range(3) for i, p in enumerate(points)]
    framed = [bool(v.frame) for v in variants]
    summed = used.groupBy(*keys, "v").agg(*sums, *(corners if any(framed) else []))
    kinds = dict(met.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", v int, " + ", ".join(f"q{i}{j} double" for i in range(3) for j in range(3)) + ", d0 double, d1 double, d2 double"

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # a row a pair and variant
            if not len(pdf):
                continue
            n = pdf["n"].to_numpy(float)
            mean = np.stack([pdf[f"s{i}"].to_numpy(float) / n for i in range(6)], axis=1)
            h = np.stack([pdf[f"h{i}{j}"].to_numpy(float) for i in range(3) for j in range(3)], axis=1).reshape(-1, 3, 3) - n[:, None, None] * mean[:, :3, None] * mean[:, None, 3:]
            rot, fine = rotations(h), n >= 3
            shift = mean[:, 3:] - np.einsum("ni,nij->nj", mean[:, :3], rot)
            own = np.array(framed)[pdf["v"].to_numpy(int)]
            if own.any():
                at = [np.stack([pdf[f"r{r}{i}"].to_numpy(float) for i in range(6)], axis=1)[own] for r in range(3)]
                a, b = (frames(*[p[:, s : s + 3] for p in at]) for s in (0, 3))
                rot[own] = np.einsum("nki,nkj->nij", a, b)
                shift[own] = at[0][:, 3:] - np.einsum("ni,nij->nj", at[0][:, :3], rot[own])
                fine[own] = np.isfinite(rot[own]).all(axis=(1, 2))
            out = pdf.loc[fine, [*keys, "v"]].copy()
            for i in range(3):
                for j in range(3):
                    out[f"q{i}{j}"] = rot[fine, i, j]
            for j in range(3):
                out[f"d{j}"] = shift[fine, j]
            yield out

    fits = summed.mapInPandas(fit, schema).withColumnsRenamed({k: f"_f_{k}" for k in [*keys, "v"]})
    measured = met.select(*keys, *points, parts("measure")).select(*keys, *points, "_r.v")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in [*keys, "v"]])
    off = [sum((F.col(f"a{i}") * F.col(f"q{i}{j}") for i in range(3)), F.col(f"d{j}")) - F.col(f"b{j}") for j in range(3)]
    far = measured.join(fits, on).select(*keys, "v", F.sqrt(sum((c * c for c in off), F.lit(0.0))).alias("far"))
    wide = far.groupBy(*keys).agg(*[F.avg(F.when(F.col("v") == n, F.col("far"))).alias(f"rmsd_{v.name}") for n, v in enumerate(variants)]).withColumnsRenamed({k: f"_w_{k}" for k in keys})
    back = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys])
    return atoms.select(*keys).distinct().join(wide, back, "left").select(*keys, *[f"rmsd_{v.name}" for v in variants])


def exemplar_atoms(atoms: DataFrame, chosen: DataFrame, pair: list[str], label: str) -> DataFrame:
    """The atoms of the pairs that ``chosen`` (pair, label) names, one pair a class, without the pair's columns."""
    side = chosen.select(*[F.col(p).alias(f"_c_{p}") for p in pair], F.col(label).alias("_c_label"))
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_c_{p}")) for p in pair], F.col(label) == F.col("_c_label"))
    return atoms.join(side, same, "left_semi").drop(*pair)
