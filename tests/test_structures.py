"""Constraints, alternative locations, classes, planes and exemplar fits against plain Python."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rangeloom.operators import classes, constraints, spatial, variants
from rangeloom.plans import catalogue


def test_constraints_count_drop_and_fail(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 9.0), (4, 3.0)], "id int, x double")
    rules = [constraints.Constraint("short", "x < 5", "drop", null_is_fine=True), constraints.Constraint("there", "x is not null"), constraints.Constraint("small", "id < 10", "fail")]
    seen = Observation()
    assert sorted(r.id for r in constraints.checked(df, rules, seen).collect()) == [1, 2, 4]
    assert seen.get == {"rows": 4, "short": 1, "there": 1, "small": 0}
    assert {r.name: r.violations for r in constraints.report(df, rules).collect()} == {"short": 1, "there": 1, "small": 0}
    with pytest.raises(Exception, match="small does not hold"):
        constraints.checked(df.withColumn("id", F.col("id") * 5), rules).collect()
    with pytest.raises(ValueError):
        constraints.Constraint("x", "true", "ignore")
    assert constraints.one_value(df, F.col("x")).first().same is False
    assert constraints.one_value(df.where("false"), F.col("x")).first().same is True
    assert constraints.one_schema(df, df.drop("x")) == [set(), {"x"}]


def test_alternative_locations(spark):
    rows = [
        ("r", "N1", "", 1, 0.0), ("r", "C2", "A", 2, 1.0), ("r", "C2", "B", 3, 2.0), ("r", "O4", "A", 4, 3.0), ("r", "O4", "C", 5, 4.0),
        ("s", "N1", " ", 6, 0.0), ("s", "P", "", 7, 5.0), ("s", "P", None, 8, 6.0),
    ]
    df = spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], "residue string, atom string, alt string, serial int, x double, y double, z double")
    got = {(r.residue, r.variant, r.atom): (r.chosen, r.x) for r in variants.resolve_variants(df, ["residue"]).collect()}
    assert got == {
        ("r", "A", "N1"): ("", 0.0), ("r", "A", "C2"): ("A", 1.0), ("r", "A", "O4"): ("A", 3.0),
        ("r", "B", "N1"): ("", 0.0), ("r", "B", "C2"): ("B", 2.0), ("r", "B", "O4"): (None, None),
        ("r", "C", "N1"): ("", 0.0), ("r", "C", "C2"): (None, None), ("r", "C", "O4"): ("C", 4.0),
        ("s", "", "N1"): ("", 0.0), ("s", "", "P"): ("", 5.0),
    }
    wanted = spark.createDataFrame([("r", ""), ("r", "Z")], "residue string, variant string")
    near = df.where("residue = 'r'").withColumn("x", F.when(F.col("atom") == "C2", F.col("x") / 100).otherwise(F.col("x")))
    got = {(r.variant, r.atom): r.chosen for r in variants.resolve_variants(near, ["residue"], wanted).collect()}
    assert got == {("", "N1"): "", ("", "C2"): "A", ("", "O4"): None}  # C2's two are one place; Z names nothing


def test_bond_definitions(spark, tmp_path):
    text = "some words\nmore\n\nTYPE,Bases,,ATOM 1,ATOM 2 ,H-bond,ATOM 3 ,ATOM 4,\ncis W/w,A,C,N6,H61,---,N3,-,\ncis W/W,A,C,-,N1,---,H2,C2,  *** a note\ncis W/W,A,C,N6,H62,---,N3,-,\ntrans H/Sa,G,A,N2,H21,---,O2',-,\nodd,A,A,N6,H61,---,N1,-,\n"
    (tmp_path / "d.csv").write_text(text)
    got = sorted(tuple(r) for r in classes.read_bond_definitions(spark, str(tmp_path / "d.csv")).collect())
    assert got == [("cWW", "A", "C", 0, "N6", "N3"), ("cWW", "A", "C", 1, "N1", "C2"), ("tHSa", "G", "A", 0, "N2", "O2'")]
    (tmp_path / "bad.csv").write_text("TYPE,,,\ncis W/W,A,C,N6,H61,--,N3,-,\n")
    with pytest.raises(Exception, match="not a bond"):
        classes.read_bond_definitions(spark, str(tmp_path / "bad.csv")).collect()


def test_class_numbers_and_discovery(spark):
    bonds = spark.createDataFrame(
        [("cWW", "G", "C", 0, "N1", "N3"), ("cWW", "G", "C", 1, "O6", "N4"), ("cWS", "A", "G", 0, "N6", "O2'"), ("cWS", "A", "G", 1, "N1", "N2"), ("tHH", "A", "A", 0, "C2", "N7"), ("cWH", "U", "A", 0, "N3", "N7"), ("cHW", "A", "U", 0, "N7", "N3")],
        "family string, base1 string, base2 string, place int, atom1 string, atom2 string",
    )
    seen = [("cWW", "C", "G", True), ("ncWW", "G", "C", False), ("cSW", "G", "A", True), ("cWs", "A", "G", False), ("tHH", "A", "A", True), ("cWW", "A", "A", True)]
    got = {(r.family, r.base1): r.class_number for r in classes.class_numbers(spark.createDataFrame(seen, "family string, base1 string, base2 string, rna boolean"), bonds).collect()}
    assert got == {("cWW", "C"): 1, ("ncWW", "G"): 1, ("cSW", "G"): 2, ("cWs", "A"): 3, ("tHH", "A"): 3, ("cWW", "A"): None}
    rows = [("cWW", "G", "C")] * 3 + [("cWW", "C", "G")] * 2 + [("cHW", "A", "U"), ("cWH", "U", "A"), ("cSW", "A", "G"), ("cWS", "G", "A"), ("tsS", "A", "A"), ("cWW", "N", "A"), (None, "A", "A")]
    found = classes.discover_classes(spark.createDataFrame(rows, "family string, base1 string, base2 string"), bonds)
    assert {(r.family, r.base1, r.base2): r["count"] for r in found.where("family is not null").collect()} == {("cWW", "G", "C"): 3, ("cHW", "A", "U"): 1, ("cWH", "U", "A"): 1, ("cWS", "G", "A"): 1}


def grouped(rows, key="vec_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], {})[r["atom"]] = np.array([r["x"], r["y"], r["z"]])
    return out


def test_plane_fit_query_is_the_least_eigenvector(spark, data):
    own = grouped(catalogue.atoms(spark, data).collect())
    for r in catalogue.QUERIES["plane_fit"](spark, data).collect():
        p = np.array(list(own[r.vec_id].values()))
        values, vectors = np.linalg.eigh((p - p.mean(axis=0)).T @ (p - p.mean(axis=0)))
        normal = vectors[:, 0] * np.sign(vectors[np.argmax(np.abs(vectors[:, 0])), 0])
        assert np.allclose([r.nx, r.ny, r.nz], normal, atol=1e-6) and r.deviation == pytest.approx(values[0], abs=1e-9)
        assert r.accepted == (values[0] <= 0.5 * len(p))


def plain_rmsd(a, b, fit, measure):
    common = [n for n in fit if n in a and n in b]
    if len(common) < 3:
        return None
    rot, shift = spatial.kabsch(np.array([a[n] for n in common]), np.array([b[n] for n in common]))
    return float(np.mean([np.linalg.norm(a[n] @ rot + shift - b[n]) for n in measure if n in a and n in b]))


def test_rmsd_queries_equal_one_fit_at_a_time(spark, data):
    own = grouped(catalogue.atoms(spark, data).collect())
    square = {"A0": (0.0, 0.0, 0.0), "A1": (0.1, 0.0, 0.0), "A2": (0.1, 0.1, 0.0), "A3": (0.0, 0.1, 0.1)}
    line = {"A0": (0.0, 0.0, 0.0), "A1": (0.1, 0.0, 0.0), "A2": (0.2, 0.01, 0.0)}
    as_points = lambda e: {k: np.array(v) for k, v in e.items()}
    for r in catalogue.QUERIES["rmsd_exemplar"](spark, data).collect():
        assert r.rmsd == pytest.approx(plain_rmsd(own[r.vec_id], as_points(square), square, square), abs=1e-8)
    told = {"c0": square, "c1": line}
    for r in catalogue.QUERIES["rmsd_by_class"](spark, data).collect():
        e = told.get(r.label)
        assert r.rmsd == (None if e is None else pytest.approx(plain_rmsd(own[r.vec_id], as_points(e), e, e), abs=1e-7))


def test_six_variants_equal_one_fit_at_a_time(spark, data):
    names = ["C1'", "N1", "C2", "C6", "N3", "O2"]
    own, label, score = {}, {}, {}
    for r in spark.read.parquet(f"{data}/embeddings.parquet").collect():
        own[r.vec_id] = {(s + 1, n): np.array(r.embedding[18 * s + 3 * i : 18 * s + 3 * i + 3], float) for s in range(2) for i, n in enumerate(names)}
        label[r.vec_id], score[r.vec_id] = r.label, r.embedding[63]
    best = {c: max((v for v in own if label[v] == c), key=lambda v: (score[v], -v)) for c in set(label.values())}
    both = [(s, n) for s in (1, 2) for n in names]
    of = lambda side, some: [(s, n) for s, n in both if s in side and n in some]
    core, edge, base = ["C1'", "N1", "C2", "C6"], ["C2", "N3", "O2"], names[1:]
    sets = {
        "C1N_frames2": (of([2], core), of([1], core)), "edge1": (of([1], base), of([2], edge)), "edge2": (of([2], base), of([1], edge)),
        "edge_C1N_frame": (of([1, 2], edge), of([1, 2], core)), "all_base": (of([1, 2], base), of([1, 2], base)),
    }

    def axes(p):
        unit = lambda v: v / np.linalg.norm(v)
        y = unit(p[1, "N1"] - p[1, "C1'"])
        x = p[1, "C6"] - p[1, "N1"]
        x = unit(x - (x @ y) * y)
        return np.stack([x, y, np.cross(x, y)])

    rows = catalogue.QUERIES["rmsd_six_variants"](spark, data).collect()
    assert len(rows) == len(own)
    for r in rows:
        a, b = own[r["vec_id"]], own[best[r["class"]]]
        for name, (fit, measure) in sets.items():
            assert r[f"rmsd_{name}"] == pytest.approx(plain_rmsd(a, b, fit, measure), abs=1e-6), name
        rot = axes(a).T @ axes(b)
        moved = {k: (v - a[1, "N1"]) @ rot + b[1, "N1"] for k, v in a.items()}
        assert r["rmsd_C1N_frames1"] == pytest.approx(np.mean([np.linalg.norm(moved[k] - b[k]) for k in of([2], core)]), abs=1e-6)
