"""Selection, two-sided contacts, bonded components, mirrored passes and panels against plain Python."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.operators import dedupe, panels, spatial
from rangeloom.operators.selection import order_statistics

POINTS = {"low": (0.05, "lower"), "mid": (0.5, "linear"), "p90": (0.9, "linear"), "top": (1.0, "higher"), "high": (0.95, "higher"), "first": (0.0, "linear")}


def wanted(values, q, method):
    return float(np.percentile(values, q * 100, method=method)) if len(values) else None


@pytest.mark.parametrize(("accuracy", "small"), [(10_000, 1_000_000), (20, 5), (100, 1)])
def test_order_statistics_are_exact(spark, accuracy, small):
    random.seed(accuracy)
    rows = [("a", random.gauss(0, 1), float(i % 7)) for i in range(3000)]
    rows += [("b", random.choice([1e300, -1e300, 0.1, 0.2, 5e-324]), 1.0) for _ in range(700)]  # far outliers, ties
    rows += [(None, float(i), None) for i in range(11)] + [("c", None, float("nan")), ("d", 3.5, -1.0)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r for r in order_statistics(df, ["k"], {"x": F.col("x"), "y": F.col("y")}, POINTS, [F.count("*").alias("n")], accuracy, small).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for k, r in got.items():
        own = [x for x in rows if x[0] == k]
        assert r["n"] == len(own)
        for at, c in ((1, "x"), (2, "y")):
            values = [x[at] for x in own if x[at] is not None and not math.isnan(x[at])]
            for p, (q, m) in POINTS.items():
                want = wanted(values, q, m)
                assert r[f"{c}_{p}"] == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-300)), (k, c, p)


def test_order_statistics_of_a_whole_frame_and_of_nothing(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "x double")
    row = order_statistics(df, [], {"x": F.col("x")}, {"q": (0.25, "linear")}).first()
    assert row["x_q"] == 25.0
    assert order_statistics(df.where("false"), [], {"x": F.col("x")}, {"q": (0.5, "linear")}).first()["x_q"] is None
    with pytest.raises(ValueError):
        order_statistics(df, [], {"x": F.col("x")}, {"q": (0.5, "nearest")})


@pytest.mark.parametrize("crowded", [0, 3, 1000])
@pytest.mark.parametrize("closed", [True, False])
def test_near_equals_all_pairs(spark, crowded, closed):
    random.seed(crowded)
    # Whole numbers, so that distances equal to the reach are common; half of the points crowd one place.
    place = lambda i: [random.randint(-6, 6) if i % 2 else random.randint(0, 2) for _ in range(3)]
    a = [(i % 2, i, *map(float, place(i))) for i in range(60)] + [(0, 99, None, 1.0, 1.0)]
    b = [(i % 2, i, *map(float, place(i))) for i in range(70)]
    left = spark.createDataFrame(a, "s int, l int, x double, y double, z double")
    right = spark.createDataFrame(b, "s int, r int, x double, y double, z double")
    got = sorted((x["l"], x["r"]) for x in spatial.near(left, right, 2.0, ["s"], crowded=crowded, closed=closed).collect())
    d = lambda p, q: sum((u - v) ** 2 for u, v in zip(p[2:], q[2:], strict=True))
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and None not in p and (d(p, q) <= 4 if closed else d(p, q) < 4))


def test_symmetry_contacts_prune_what_cannot_touch(spark):
    points = spark.createDataFrame([("s", r, float(r), 0.0, 0.0) for r in range(10)] + [("t", 1, 0.0, 0.0, 0.0)], "s string, r int, x double, y double, z double")
    turn = lambda s, op, x: (s, op, *[1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], x, 0.0, 0.0)
    kinds = "s string, op string, " + ", ".join(f"r{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)) + ", t1 double, t2 double, t3 double"
    ops = spark.createDataFrame([turn("s", "1_555", 0.0), turn("s", "2_555", 9.5), turn("s", "3_555", 100.0), turn("t", "2_555", 0.4)], kinds)
    got = sorted(tuple(r) for r in spatial.symmetry_contacts(points, ops, "s", "r", 1.0).collect())
    assert got == [("s", 9, 0, "2_555"), ("t", 1, 1, "2_555")]


def test_bonded_atoms(spark):
    chain = [("A", "C1", 0.0), ("A", "N", 1.5), ("A", "C2", 2.9), ("A", "O", 4.2), ("A", "far", 9.0), ("A", "C2", 3.0)]
    lone = [("B", "C1", 0.0), ("B", "N", 5.0)]  # nothing near its seed
    none = [("C", "N", 0.0), ("C", "C2", 1.0)]  # no seed
    odd = [("D", "C1", 0.0), ("D", "N", 1.8), ("D", "C2", None), ("D", "O", 3.4)]  # exactly on both reaches
    df = spark.createDataFrame([(*r, 0.0, 0.0) for r in chain + lone + none + odd], "res string, atom string, x double, y double, z double")
    got = spatial.bonded_atoms(df, ["res"], "atom", F.col("atom") == "C1")
    assert sorted((r["res"], r["atom"]) for r in got.collect()) == [("A", "C2"), ("A", "C2"), ("A", "N"), ("A", "O"), ("D", "N"), ("D", "O")]


def test_bonded_atoms_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    for n, spread, bond in ((200, 1.0, 0.3), (300, 1.0, 0.22), (120, 0.2, 0.3), (60, 0.6, 0.3)):
        p = rng.uniform(-spread, spread, (n, 3))
        p[-4:] = [[3e18, 0, 0], [np.nan, 0, 0], [np.inf, 0, 0], p[1]]
        got = spatial.bonded_atoms(spark.createDataFrame([("A", i, *map(float, x)) for i, x in enumerate(p)], "res string, atom int, x double, y double, z double"), ["res"], "atom", F.col("atom") == 0, 0.5, bond)
        d2 = lambda a, b: sum((a[i] - b[i]) * (a[i] - b[i]) for i in range(3))
        reached = todo = {i for i in range(1, n) if d2(p[0], p[i]) <= 0.25}
        while todo:
            todo = {j for j in range(1, n) if j not in reached and any(d2(p[i], p[j]) <= bond * bond for i in todo)}
            reached = reached | todo
        assert {r["atom"] for r in got.collect()} == reached


def test_bonded_atoms_of_a_dense_place_write_no_bonds(spark, monkeypatch):
    rows = []
    cut = spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: (out := cut(df), rows.append(out.count()))[0])
    p = np.random.default_rng(9).uniform(0, 0.1, (400, 3))
    df = spark.createDataFrame([("A", i, *map(float, x)) for i, x in enumerate(p)], "res string, atom int, x double, y double, z double")
    assert spatial.bonded_atoms(df, ["res"], "atom", F.col("atom") == 0, 1.8, 1.6).count() == 399
    assert max(rows) <= 400


def test_mirrored_passes(spark):
    rows = [
        (1, "cSW", "A", 1, "G", 2),  # the other reading of 2
        (2, "cWS", "G", 2, "A", 1),
        (3, "cSW", "A", 1, "G", 3),  # alone
        (4, "tsS", "A", 4, "A", 5),
        (5, "tSs", "A", 5, "A", 4),
        (6, "cWW", "C", 6, "G", 7),
        (7, "cWW", "G", 7, "C", 6),
        (8, "tSS", "C", 8, "G", 9),  # this family has no order of bases
        (9, "tSS", "G", 9, "C", 8),
        (10, "cWW", None, 10, "A", None),
        (11, "cWW", "A", None, None, 10),
    ]
    df = spark.createDataFrame(rows, "id int, family string, res1 string, nr1 int, res2 string, nr2 int").withColumn("s", F.lit("x"))
    passes = dedupe.mirror_passes("family", F.col("res1"), F.col("res2"))
    left = lambda n: sorted(r["id"] for r in dedupe.drop_mirrored_passes(df, ["res1", "nr1"], ["res2", "nr2"], ["s"], "family", ("res1", "res2"), passes[:n]).collect())
    assert left(0) == list(range(1, 12))
    assert left(1) == list(range(2, 12))
    assert left(2) == [2, 3, 5, *range(6, 12)]
    assert left(3) == [2, 3, 5, 7, 8, 9, 10]


def test_two_readings_that_both_hold_stay(spark):
    df = spark.createDataFrame([(1, "x", "A", 1, "A", 2), (2, "x", "A", 2, "A", 1)], "id int, family string, res1 string, nr1 int, res2 string, nr2 int")
    got = dedupe.drop_mirrored_passes(df, ["res1", "nr1"], ["res2", "nr2"], [], "family", ("res1", "res2"), [F.lit(True)])
    assert got.count() == 2


def test_bitmap_has_more_panels_than_a_word(spark):
    many = [[panels.Variable(f"v{i}", "x", 0, 100, 4, f"x % 100 >= {i}")] for i in range(100)]
    df = spark.createDataFrame([(float(x),) for x in range(100)] + [(None,), (float("nan"),)], "x double")
    got = panels.panel_histograms(df, many)
    total = {r["panel"]: r["total"] for r in got.collect()}
    assert total == {i: 100 - i for i in range(100)}
    by = defaultdict(list)
    for x in range(100):
        by[x // 25].append(x)
    first = {r["bin"]: r for r in got.where("panel = 0").collect()}
    assert {b: r["count"] for b, r in first.items()} == {b: len(v) for b, v in by.items()}
    assert first[0]["std"] == pytest.approx(np.std(range(100))) and first[0]["mean"] == pytest.approx(49.5)
    with pytest.raises(ValueError):
        panels.panel_histograms(df, [[]])


def test_panels_read_their_table_once(spark, data):
    from rangeloom.plans.catalogue import QUERIES

    plan = QUERIES["panel_bitmaps"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("Aggregate [") == 1
