import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.functions.ranges import NumRange, range_sql
from rangeloom.functions.scalars import circular_mean, wrap180
from rangeloom.operators import boundaries, compare, dedupe, filters, matching, spatial, stats
from rangeloom.operators.filters import PairFilter
from rangeloom.plans import codec
from rangeloom.plans.catalogue import QUERIES
from rangeloom.sources import readers, writers


@pytest.mark.parametrize(
    "r, text",
    [
        (NumRange(), []),
        (NumRange(1, 2), ["x BETWEEN 1 AND 2"]),
        (NumRange(2, 1), ["x NOT BETWEEN 1 AND 2"]),
        (NumRange(3, 3), ["x = 3"]),
        (NumRange(-5, 5), ["abs(x) <= 5"]),
        (NumRange(None, 4.5), ["x <= 4.5"]),
        (NumRange(0.5, None), ["x >= 0.5"]),
    ],
)
def test_range_sql(r, text):
    assert range_sql("x", r) == text


def test_circular_mean_crosses_the_turn(spark):
    df = spark.createDataFrame([(-170.0,), (175.0,)], "a double")
    assert abs(df.agg(circular_mean("a")).first()[0] - -177.5) < 1e-9
    assert df.select(wrap180(F.lit(540.0))).first()[0] == -180.0


def test_url_round_trip():
    f = filters.PairFilter({"hb_0_length": NumRange(None, 3.4), "hb_1_donor_angle": NumRange(100, 140), "angle": NumRange(170, -170)}, min_bond_length=NumRange(None, 3.8), kind="RNA", accepted="ok", sql=("a > 1 or b = 'x&y'",))
    assert codec.parse_url(codec.to_url("cWW-G-C", f, "set-f")) == ("cWW-G-C", f, "set-f")
    panels = [("hb_0_length", None), ("angle", "x > 1 AND y = 'a'")]
    assert codec.panels_from_url(codec.panels_to_url(panels)) == panels


@pytest.mark.parametrize("text, want", [("cWW-A-U", ("", "cWW", "", "A", "U")), ("cWWa-G-U", ("", "cWW", "a", "G", "U")), ("ntHS-A-G", ("n", "tHS", "", "A", "G")), ("cSs-A-C", ("", "cSs", "", "A", "C")), ("A-U-cWW", ("", "cWW", "", "A", "U")), ("junk", None)])
def test_parse_class(text, want):
    assert codec.parse_class(text) == want


def test_filter_difference():
    a, b = filters.PairFilter({"x": NumRange(1, 2), "y": NumRange(1, None)}), filters.PairFilter({"x": NumRange(1, 2), "z": NumRange(None, 3)})
    assert filters.filter_difference(a, b) == (["z <= 3"], ["y >= 1"])


def test_matching_greedy_and_optimal_differ_on_a_path():
    edges, scores = [("a", "b"), ("b", "c"), ("c", "d")], [1.0, 0.5, 1.0]
    assert matching.greedy(edges, scores) == [False, True, False]
    assert matching.max_weight_matching(edges, [2 - s for s in scores]) == [True, False, True]


def test_matching_is_optimal():
    rng = random.Random(5)
    for _ in range(60):
        edges = [tuple(rng.sample(range(7), 2)) for _ in range(rng.randint(1, 9))]
        weights = [rng.choice([0.01, 0.5, 1.0, 1.5]) for _ in edges]
        best = 0.0
        for n in range(len(edges) + 1):
            for chosen in itertools.combinations(range(len(edges)), n):
                nodes = [x for i in chosen for x in edges[i]]
                if len(nodes) == len(set(nodes)):
                    best = max(best, sum(weights[i] for i in chosen))
        kept = matching.max_weight_matching(edges, weights)
        nodes = [x for e, k in zip(edges, kept, strict=True) if k for x in e]
        assert len(nodes) == len(set(nodes))
        assert abs(sum(w for w, k in zip(weights, kept, strict=True) if k) - best) < 1e-9


def test_contacts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(-1, 1, (150, 3))
    df = spark.createDataFrame([(i // 3, *map(float, x)) for i, x in enumerate(p)], "res int, x double, y double, z double")
    got = {(r[0], r[1]) for r in spatial.contacts(df, "res", 0.3).collect()}
    want = {(i // 3, j // 3) for i in range(150) for j in range(150) if i // 3 != j // 3 and ((p[i] - p[j]) ** 2).sum() < 0.09}
    assert got == want


def test_point_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.uniform(-0.3, 0.3, (150, 3)), rng.integers(-4, 5, (150, 3)) * 0.051, [[1e9, 0, 0], [np.nan, 0, 0], [np.inf, 0, 0]]])
    key = [*range(len(p)), *range(30)]  # some rows occur twice, and so do their pairs
    p = np.concatenate([p, p[:30]])
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in zip(key, p, strict=True)] + [(None, 0.0, 0.0, 0.0), (500, None, 0.0, 0.0)], "vec_id int, x double, y double, z double")
    pairs = spatial.point_pairs(df, "vec_id", 0.1)
    d2 = lambda a, b: (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])
    want = sorted((key[i], key[j]) for i in range(len(p)) for j in range(len(p)) if key[i] != key[j] and d2(p[i], p[j]) < 0.1 * 0.1)
    assert len(want) > len(set(want))
    assert sorted(map(tuple, pairs.collect())) == want


@pytest.mark.parametrize("name", ["spatial_grid_join", "spatial_grid_join_wide"])
def test_grid_joins_do_not_shuffle_their_pairs(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.partition("Join")[0]


def test_comparison_modes_add_up(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "k int, f string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "k int, f string")
    n = {m: compare.compare_sets(a, b, m, ["k"], ["k", "f"]).count() for m in compare.MODES}
    assert n == {"union": 4, "difference": 2, "missing": 1, "new": 1}


def test_mirrored_rows_do_not_depend_on_the_side(spark):
    rows = [("A", 1, "B", 2, "cWH"), ("B", 2, "A", 1, "cHW"), ("C", 3, "D", 4, "cWW"), ("C", 3, "D", 4, "cWW")]
    df = spark.createDataFrame(rows, "c1 string, n1 int, c2 string, n2 int, f string")
    out = dedupe.drop_mirrored(df, ["c1", "n1"], ["c2", "n2"], "f", F.regexp_replace("f", "^(.)(.)(.)$", "$1$3$2"), [F.col("c1")])
    assert sorted(map(tuple, out.collect())) == [("A", 1, "B", 2, "cWH"), ("C", 3, "D", 4, "cWW")]


def test_kabsch_finds_a_rotation():
    a = np.random.default_rng(1).normal(size=(6, 3))
    c, s = np.cos(1.0), np.sin(1.0)
    b = a @ np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]]) + [1, 2, 3]
    rot, shift = spatial.kabsch(a, b)
    assert np.allclose(a @ rot + shift, b)


def test_basepair_text_round_trip(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1ABC|1|A|G|10 cWH 1ABC|1|A|C|25|||A 0\n")
    df = readers.read_basepairs(spark, str(tmp_path / "x.txt"))
    r = df.first()
    assert (r.pdbid, r.model, r.chain1, r.nr1, r.nr2, r.ins2, r.family) == ("1abc", 1, "A", 10, 25, "A", "cWH")
    assert [x[0].split("\t")[1] for x in writers.basepair_lines(df).collect()] == ["cWH", "cWH"]


def test_pair_csv_with_and_without_header(spark, tmp_path):
    names = [c.split()[0] for c in readers.LEGACY_COLUMNS.split(", ")]
    row = ["1ABC", "1", "A", "G", "1", "?", "", "", "B", "C", "2", " ", "", "", "0"] + ["1.5"] * (len(names) - 15)
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(row) + "\n")
    (tmp_path / "b.csv").write_text(",".join(row) + "\n")
    rows = readers.read_pair_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).collect()
    assert len(rows) == 2 and {(r.pdbid, r.ins1, r.ins2, r.nr2) for r in rows} == {("1abc", None, None, 2)}


def test_residue_list_rejects_other_lines(spark, tmp_path):
    (tmp_path / "ok").write_text("1ABC_A_G_12\n1abc_B_DA.X_-3.C\n")
    rows = readers.read_residue_list(spark, str(tmp_path / "ok")).collect()
    assert [(r.chain, r.base, r.nr, r.ins, r.alt) for r in rows] == [("A", "G", 12, None, None), ("B", "DA", -3, "C", "X")]
    (tmp_path / "bad").write_text("what is this\n")
    with pytest.raises(Exception, match="not a residue"):
        readers.read_residue_list(spark, str(tmp_path / "bad")).collect()


def test_structure_reader(spark, tmp_path):
    items = ["group_PDB", *readers.ATOM_ITEMS]
    text = "data_1ABC\nloop_\n" + "".join(f"_atom_site.{i}\n" for i in items) + "ATOM 1 A 7 ? . G \"O2'\" O 1.0 2.5 -3\nATOM 1 A 8 B . C N N 0 0 0\n#\n"
    (tmp_path / "1ABC.cif").write_text(text)
    rows = readers.read_structures(spark, str(tmp_path / "1ABC.cif")).collect()
    assert [(r.pdbid, r.nr, r.ins, r.atom, r.z) for r in rows] == [("1abc", 7, None, "O2'", -3.0), ("1abc", 8, "B", "N", 0.0)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("1abc", "cWW", 1.5, None), ("2abc", "tWW", 2.5, "x")], "pdbid string, family string, v double, w string")
    writers.write_pairs(df, str(tmp_path / "p"), "both")
    assert spark.read.parquet(str(tmp_path / "p.parquet")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "p.csv")).columns == ["pdbid", "family", "v", "w"]
    assert '"w"' not in writers.json_by_structure(df).where("pdbid = '1abc'").first()["json"]


def test_catalog_resolves_views(spark, tmp_path):
    from rangeloom.plans.catalog import Catalog

    spark.createDataFrame([(1, 2.0)], "a int, b double").write.parquet(str(tmp_path / "cWW-A-U-filtered.parquet"))
    cat = Catalog(spark, str(tmp_path), "cWW-A-U")
    assert cat.sql('select a from selectedpair_f where b > 1').collect()[0][0] == 1
    assert cat.sql('select a from "cWW-A-U_f"').count() == 1


def test_stream_filter(spark, tmp_path):
    from rangeloom.streaming.filters import filter_stream

    spark.createDataFrame([("A", "x", 5.0), ("A", "x", 50.0)], "family string, variant string, v double").write.parquet(str(tmp_path / "in"))
    limits = spark.createDataFrame([("a", "X", 0.0, 10.0)], "family string, variant string, v_min double, v_max double")
    stream = spark.readStream.schema("family string, variant string, v double").parquet(str(tmp_path / "in"))
    q = filter_stream(stream, limits, {"v": F.col("v")}).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.v for r in spark.table("kept").collect()] == [5.0]


def test_packed_basepair_text(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    (tmp_path / "x.txt.zst").write_bytes(zstandard.ZstdCompressor().compress(b"1ABC|1|A|G|10 cWH 1ABC|1|A|C|25 0\n"))
    (tmp_path / "y.txt").write_text("2ABC|1|A|G|11 tWH 2ABC|1|A|C|26 0\n")
    rows = readers.read_basepairs(spark, str(tmp_path / "x.txt.zst"), str(tmp_path / "y.txt")).collect()
    assert sorted((r.pdbid, r.nr1, r.family) for r in rows) == [("1abc", 10, "cWH"), ("2abc", 11, "tWH")]


def test_annotated_pairs_are_matched_by_line(spark, tmp_path):
    pairs = "# head\n1 9 a b 0 A.G1 A.C9 G-C cWW\n2 8 a b 0 A.2MG2 B.DA-8^X G+A tWH\n3 7 a b 0 A.G3 A.C7 A-C cWW\n"
    steps = "# other head\n# more\n" + "\n".join(f"{p} {v} " + " ".join(["1.5"] * 11) for p, v in (("G-C", "999999"), ("G+A", "0.25"), ("A-C", "1"))) + "\n"
    for name, text in (("dssr-pairs.txt", pairs), ("dssr-dsStepPars.txt", steps)):
        (tmp_path / name).write_text(text)
    rows = sorted(readers.read_annotated(spark, str(tmp_path)).collect(), key=lambda r: r.seq1)
    assert [(r.nr1, r.res1, r.chain2, r.nr2, r.alt2, r.pairing_type, r.shear, r.twist) for r in rows] == [(1, "G", "A", 9, "", "cWW", None, 1.5), (2, "2MG", "B", -8, "X", "tWH", 0.25, 1.5)]
    with pytest.raises(ValueError, match="out of step"):
        readers.annotated_pairs("1 9 a b 0 A.G1 A.C9 G-C cWW\n", "A-U 1\n")


def test_symmetry_reader(spark, tmp_path):
    items = ["id", "name", "symmetry_operation", *[f"matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)], *[f"vector[{i}]" for i in (1, 2, 3)]]
    loop = "loop_\n" + "".join(f"_pdbx_struct_oper_list.{i}\n" for i in items) + "1 1_555 x,y,z 1 0 0 0 1 0\n0 0 1 0 0 0\n2 2_655 '-x+1,-y,z' -1 0 0 0 -1 0 0 0 1 5.5 0 0\n#\n"
    (tmp_path / "1ABC.cif").write_text(f"data_1ABC\n{loop}_pdbx_entity_src_syn.pdbx_src_id 1\n_pdbx_entity_src_syn.organism_scientific 'some being'\n_other.x 1\n")
    rows = readers.read_symmetry(spark, str(tmp_path / "1ABC.cif")).orderBy("id").collect()
    assert [(r.pdbid, r.op, r.triplet, r.r11, r.t1, r.organism, r.organism_id) for r in rows] == [("1abc", "1_555", "x,y,z", 1.0, 0.0, "some being", 1), ("1abc", "2_655", "-x+1,-y,z", -1.0, 5.5, "some being", 1)]
    points = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "k int, x double, y double, z double")
    assert [tuple(r) for r in spatial.transform_points(points, readers.read_symmetry(spark, str(tmp_path / "1ABC.cif"))).select("op", "x", "y", "z").collect()] == [("2_655", 4.5, -2.0, 3.0)]


def test_variants_and_residue_dimension(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "l string, r string")
    alts = spark.createDataFrame([("b", "X"), ("b", "Y"), ("b", "X")], "k string, alt string")
    rows = dedupe.expand_variants(pairs, alts, {"alt1": ("l", "k"), "alt2": ("r", "k")}).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [("a", "b", None, "X"), ("a", "b", None, "Y"), ("b", "c", "X", None), ("b", "c", "Y", None)]))
    dim = dedupe.per_residue(pairs, [["l"], ["r"]], lambda k: k.select("l", F.upper("l").alias("up")))
    assert {(r.l, r.up1, r.up2) for r in dim.collect()} == {("a", "A", "B"), ("b", "B", "C")}


def test_kde_curve_and_salted_sample(spark):
    x = np.random.default_rng(2).normal(3.0, 1.0, 600)
    mode, low, high = stats.curve_summary(np.sort(x))
    assert abs(mode - 3) < 0.4 and abs(low - 1.2) < 0.3 and abs(high - 4.8) < 0.3
    assert stats.curve_summary(np.ones(9)) == (None, None, None)
    df = spark.createDataFrame([("a" if i % 7 else "b", i, float(v)) for i, v in enumerate(x)], "k string, i int, x double")
    want = {r.i: r.log_likelihood for r in stats.kde_likelihood(df, ["k"], ["i"], "x", sample=50).collect()}
    got = {r.i: r.log_likelihood for r in stats.kde_likelihood(df, ["k"], ["i"], "x", sample=50, rows_per_task=40).collect()}
    assert want.keys() == got.keys() and all(abs(want[i] - got[i]) < 1e-9 for i in want)
    curves = [sorted(map(tuple, stats.kde_curve(df, ["k"], ["i"], "x", sample=50, rows_per_task=n).collect())) for n in (40, 10**6)]
    assert curves[0] == curves[1] and len(curves[0]) == 2


def test_optimal_matching_is_polynomial_and_exact():
    rng = random.Random(7)

    def brute(edges, weights, used=frozenset(), start=0):
        best = 0.0
        for i in range(start, len(edges)):
            a, b = edges[i]
            if a != b and not {a, b} & used:
                best = max(best, weights[i] + brute(edges, weights, used | {a, b}, i + 1))
        return best

    for _ in range(300):
        n = rng.randint(2, 8)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 11))]
        weights = [rng.choice((rng.uniform(0.01, 2), rng.randint(1, 4) / 2)) for _ in edges]
        kept = [(e, w) for e, w, k in zip(edges, weights, matching.max_weight_matching(edges, weights), strict=True) if k]
        nodes = [x for e, _ in kept for x in e]
        assert len(nodes) == len(set(nodes)) and abs(sum(w for _, w in kept) - brute(edges, weights)) < 1e-6
    edges = [(rng.randrange(250), rng.randrange(250)) for _ in range(500)]
    start = time.perf_counter()
    matching.max_weight_matching(edges, [rng.uniform(0.01, 2) for _ in edges])
    matching.max_weight_matching([(i, i + 1) for i in range(3000)], [1.0] * 3000)
    assert time.perf_counter() - start < 2


def test_optimal_edges_of_the_query_equal_brute_force(spark, data):
    rows = {}
    for r in QUERIES["max_weight_matching"](spark, data).collect():
        rows.setdefault(r.pid, []).append(r)
    for part in rows.values():
        edges, weights = [(r.k1, r.k2) for r in part], [max(0.01, 2 - r.score) for r in part]
        best = 0.0
        for chosen in range(1 << len(part)):
            picked = [e for i, e in enumerate(edges) if chosen >> i & 1]
            nodes = [x for e in picked for x in e]
            if len(nodes) == len(set(nodes)):
                best = max(best, sum(w for i, w in enumerate(weights) if chosen >> i & 1))
        kept = [(e, w) for e, w, r in zip(edges, weights, part, strict=True) if r.accepted]
        nodes = [x for e, _ in kept for x in e]
        assert len(nodes) == len(set(nodes)) and abs(sum(w for _, w in kept) - best) < 1e-6


def test_a_node_is_one_on_both_sides(spark):
    df = spark.createDataFrame([("s", "x", "y", 0.1), ("s", "y", "z", 0.2), ("s", "z", "w", 0.3), (None, "x", "y", 0.1), ("t", None, "y", 0.1)], "pid string, a string, b string, score double")
    for optimal in (False, True):
        got = {(r.pid, r.a, r.b): r.accepted for r in matching.exclusive_edges(df, "pid", "a", "b", "score", optimal).collect()}
        assert got == {("s", "x", "y"): True, ("s", "y", "z"): False, ("s", "z", "w"): True, (None, "x", "y"): True, ("t", None, "y"): False}
    pairs = spark.createDataFrame([("cWH", "A", 1, "B", 2), ("ntsW", "B", 2, "A", 1), ("odd", "A", 1, "B", 2)], "family string, c1 string, n1 int, c2 string, n2 int")
    a, b = matching.edge_nodes("family", ["c1", "n1"], ["c2", "n2"])
    assert [tuple(r) for r in pairs.select(a, b).collect()] == [("W|A|1", "H|B|2"), ("S|B|2", "W|A|1"), (None, None)]


def test_first_boundary_row_of_a_class_wins(spark):
    df = spark.createDataFrame([("cWW", "x", 1.0), ("cww", "x", 5.0)], "family string, variant string, p double")
    limits = spark.createDataFrame([("cWW", "x", 0.0, 2.0), ("CWW", "X", 4.0, 6.0)], "family string, variant string, p_min double, p_max double").coalesce(1)
    assert [r.p for r in boundaries.apply_boundaries(df, limits, {"p": F.col("p")}).collect()] == [1.0]
    assert boundaries.apply_boundaries(df, limits, {"p": F.col("p")}, accepted="ok").count() == 2


def test_order_text(spark):
    df = spark.createDataFrame([(1, "b"), (None, "a"), (3, "c"), (3, "a")], "x int, y string")
    assert [tuple(r) for r in filters.order_by(df, "x DESC, y").collect()] == [(3, "a"), (3, "c"), (1, "b"), (None, "a")]
    assert [tuple(r) for r in filters.order_by(df, "coalesce(x, 2) asc nulls last, y desc").collect()] == [(1, "b"), (None, "a"), (3, "c"), (3, "a")]
    assert [r.x for r in filters.order_by(df, "x NULLS FIRST").collect()][0] is None
    assert filters.split_list("f(a, b) DESC, 'x,y', c") == ["f(a, b) DESC", "'x,y'", "c"]
    assert len(filters.ORDERS) == 13
    assert [r.y for r in filters.page(df, "y, x", 2, 1).collect()] == ["b", "c"]
    assert filters.select_columns(df, ".", "y").columns == ["x"]


def test_base_pair_text(spark):
    df = spark.createDataFrame([("1abc", 1, "cWH", "A", "G", 1, "B", "C", 2, True, False), ("1abc", 1, "ncWWa", "A", "G", 1, "B", "C", 2, True, True), ("1abc", 1, "cWB", "A", "G", 1, "B", "C", 2, False, True)], "pdbid string, model int, family string, chain1 string, res1 string, nr1 int, chain2 string, res2 string, nr2 int, comparison_in_baseline boolean, comparison_in_current boolean")
    lines = [r.value.split("\t") for r in writers.basepair_lines(df, detailed=False, label=True).collect()]
    assert lines == [["1ABC|1|A|G|1|||", "cWH", "1ABC|1|B|C|2|||", "MISSING"], ["1ABC|1|B|C|2|||", "cWH", "1ABC|1|A|G|1|||", "MISSING"]]
    ordered = [r.value.split("\t")[1] for r in writers.basepair_lines(df.limit(1), order_sensitive=("cwh-g-c",)).collect()]
    assert ordered == ["cWh", "chW"]
    assert writers.basepair_lines(df, once=True).count() == 3


def test_columnar_csv_lines_up(spark, tmp_path):
    df = spark.createDataFrame([("a", float(i), -float(i)) for i in range(40)], "id string, x double, y double").repartition(5)
    writers.write_columns(df, str(tmp_path / "c"), ["id"])
    read = lambda n: {int(r.row): float(r[n]) for r in spark.read.option("header", True).csv(str(tmp_path / "c" / n)).collect()}
    x, y = read("x"), read("y")
    assert len(x) == 40 and all(y[k] == -v for k, v in x.items())


def test_nan_and_nulls_in_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", float("nan"), True), ("a", None, False), ("a", 9.0, True), ("a", 9.0, False)], "k string, x double, ok boolean")
    assert sum(r["count"] for r in stats.histogram(df, "x", 0, 10, 5).collect()) == 3
    got = sorted((str(r.x), r.q) for r in stats.rank_quantile(df, ["k"], "x", "q").collect())
    assert got == [("1.0", 0.75), ("9.0", 0.375), ("9.0", 0.375), ("None", 1.0), ("nan", 0.0)]
    run = {(str(r.x), r.ok): round(r.q, 4) for r in stats.masked_quantile(df, ["k"], "x", [F.col("ok").desc()], "ok", "q").collect()}
    assert run == {("nan", True): 0.3333, ("9.0", True): 0.6667, ("9.0", False): 0.6667, ("1.0", True): 1.0, ("None", False): 1.0}


def test_not_in_follows_sql(spark):
    keys = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    take = lambda rows: sorted((r.k for r in dedupe.not_in(keys, "k", spark.createDataFrame(rows, "m int")).collect()), key=str)
    assert take([(2,), (2,)]) == [1] and take([(None,), (2,)]) == [] and take([]) == [1, 2, None]


def test_ranges_in_urls_lose_nothing():
    import random

    random.seed(4)
    ends = [1e6, 1e-5, -1e-300, 3.4, 0.1, -0.0, 5e-324, 1.7976931348623157e308] + [random.uniform(-1, 1) * 10 ** random.randint(-30, 30) for _ in range(200)]
    for x in ends:
        for r in (NumRange(x, None), NumRange(None, x), NumRange(x, x), NumRange(0, 1e6)):
            text = codec.range_text(r)
            assert "e" not in text.lower() and codec.parse_range(text) == r
    assert codec.parse_range("1e3..2E+4") == NumRange(1000, 20000)
    assert codec.parse_range("") == codec.parse_range("..") == NumRange()
    for bad in ("3", "a..b", "1..nan", "1..inf", "1..2..3"):
        with pytest.raises(ValueError):
            codec.parse_range(bad)
    f = PairFilter({"x": NumRange(0, 1e6), "hb_0_length": NumRange(1e-05, None)})
    assert codec.parse_url(codec.to_url("cWW-G-C", f)) == ("cWW-G-C", f, "")
    with pytest.raises(ValueError):
        codec.parse_url("cWW-G-C/range_x=5")


def test_old_links():
    assert codec.parse_url("cWW-G-C/f=nfD")[1:] == (PairFilter(kind="DNA"), "fr3d-nf")
    assert codec.parse_url("cWW-G-C/f=R")[1:] == (PairFilter(kind="RNA"), "fr3d")
    assert codec.parse_url("cWW-G-C/ds=fr3d-nR&f=f")[1:] == (PairFilter(kind="RNA"), "fr3d-n")


def test_one_filter_has_one_meaning(spark):
    df = spark.createDataFrame([(float(x),) for x in (-100, -99.95, -99.9, 0, 99.9, 100, 100.05)] + [(None,)], "x double")
    for r in (NumRange(-99.95, 100), NumRange(-100, 99.95), NumRange(-100, 100), NumRange(-50, 100), NumRange(100, -100)):
        f = PairFilter({"x": r})
        assert df.where(f.condition()).collect() == df.where(" and ".join(f.sql_conditions())).collect()


def test_csv_header_decides(spark, tmp_path):
    (tmp_path / "h.csv").write_text("pdbid,model,res1,chain1,nr1,note\n1ABC,1,G,A,7,seen\n")
    row = readers.read_pair_csv(spark, str(tmp_path / "h.csv")).first()
    assert (row.pdbid, row.model, row.res1, row.chain1, row.nr1, row.note) == ("1abc", 1, "G", "A", 7, "seen")


def test_annotated_files_of_unequal_length():
    pair = "1 2 A U c A.A1 A.U2 A-U cWW"
    assert len(readers.annotated_pairs(pair, "A-U 1 2")) == 1
    with pytest.raises(ValueError):
        readers.annotated_pairs(pair + "\n" + pair, "A-U 1 2")


def test_annotated_ids():
    assert readers.annotated_id("A.DG12") == ("A", "DG", 12, "")
    assert readers.annotated_id("A.2MG/5") == ("A", "2MG", 5, "")
    assert readers.annotated_id("B.5MC/-3^C") == ("B", "5MC", -3, "C")
    assert readers.annotated_id("B.G-3") == ("B", "G", -3, "")
    for bad in ("G12", "A.", "A.G", "A./12", "A.G/x"):
        with pytest.raises(ValueError):
            readers.annotated_id(bad)
    assert [readers.parent_base(x) for x in ("dg", "D", "2MG", "A", "D5MC")] == ["G", "D", "G", "A", "C"]


def test_residue_list_with_long_codes(spark, tmp_path):
    (tmp_path / "r.txt").write_text("1abc_A_G.AB_5\n1ABC_B_U_-7.CD\n")
    rows = [(r.pdbid, r.chain, r.base, r.nr, r.ins, r.alt) for r in readers.read_residue_list(spark, str(tmp_path / "r.txt")).orderBy("chain").collect()]
    assert rows == [("1abc", "A", "G", 5, None, "AB"), ("1abc", "B", "U", -7, "CD", None)]


def test_symmetry_operation_survives_basepair_text(spark, tmp_path):
    df = spark.createDataFrame([("1abc", 1, "cWW", "A", "G", 1, None, None, "2_655", "B", "C", 2, None, None, None)], "pdbid string, model int, family string, chain1 string, res1 string, nr1 int, alt1 string, ins1 string, symmetry_operation1 string, chain2 string, res2 string, nr2 int, alt2 string, ins2 string, symmetry_operation2 string")
    writers.basepair_lines(df, once=True).select(F.concat("value", F.lit("\t0"))).write.text(str(tmp_path / "out"))
    row = readers.read_basepairs(spark, str(tmp_path / "out")).first()
    assert (row.symmetry_operation1, row.symmetry_operation2) == ("2_655", None)


def test_columnar_csv_leaves_no_copy(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, x double")
    writers.write_columns(df, str(tmp_path / "c"), ["id"])
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["id", "x"]


def test_only_a_missing_boundary_source_is_passed_over(spark, tmp_path):
    (tmp_path / "b.csv").write_text("family,bases,x_min\ncWW,A-U,1\nCWW,a-u,2\n")
    got = readers.read_boundaries(spark, str(tmp_path / "none.csv"), str(tmp_path / "b.csv")).collect()
    assert [r.x_min for r in got] == [1]
    with pytest.raises(FileNotFoundError):
        readers.read_boundaries(spark, str(tmp_path / "none.csv"))


@pytest.fixture
def classes(spark, tmp_path):
    from rangeloom.plans.catalog import Catalog

    put = lambda name, *rows: spark.createDataFrame(list(rows), "cls string, x double, accepted boolean").write.parquet(str(tmp_path / f"{name}.parquet"))
    put("cWW-G-C", ("cWW-G-C", 1.0, True), ("cWW-G-C", 9.0, True))
    put("cWW-G-C-filtered", ("cWW-G-C", 1.0, True))
    put("ncWW-G-C", ("ncWW", 2.0, True), ("ncWW", 3.0, False))
    put("cWW-G-C-allcontacts", ("all", 4.0, True), ("all", 8.0, True))
    put("cWW-G-C-filtered-allcontacts", ("all", 4.0, True), ("all", 7.0, True))
    put("cWW-A-U", ("cWW-A-U", 5.0, True))
    return Catalog(spark, str(tmp_path), "cWW-G-C", boundaries=lambda df: df.where("x < 6"))


def test_catalog_leaves_literals_alone(classes):
    assert classes.sql("select count(*) from `cWW-G-C` where cls = 'cWW-G-C'").first()[0] == 2
    assert classes.sql("""with selectedpair_f as (select 5.0 as x) select x from selectedpair_f""").first()[0] == 5
    assert classes.names("select 1 from a join (select * from b where x in (select x from `c-d`)) where 'from e' <> y") and set(classes.names("with w as (select * from f) select * from w, g")) >= {"f", "g"}
    assert classes.sql("""select x from "cWW-G-C" where x in (select x from selectedpair_f)""").collect()[0][0] == 1.0


def test_catalog_sources_wildcards_and_views(classes):
    from rangeloom.plans.catalog import SOURCES

    count = {s: sorted(r.x for r in classes.source(s).collect()) for s in SOURCES}
    assert count == {
        "fr3d": [1, 9], "fr3d-f": [1], "fr3d-n": [1, 2, 3, 9], "fr3d-nf": [1, 2], "allcontacts": [4, 8], "allcontacts-f": [4, 7],
        "allcontacts-boundaries": [4], "allcontacts-boundaries-f": [4],
    }
    assert sorted(r.class_name for r in classes.sql("select distinct class_name from `cWW-*`").collect()) == ["cWW-A-U", "cWW-G-C"]
    assert classes.sql("select * from `cWW-A-U,cWW-G-C,cWW-A-U`").count() == 3
    classes.define("fine", "select * from selectedpair where x < 6")
    classes.define("finer", "select * from fine where accepted")
    assert classes.sql("select * from finer").count() == 1
    classes.define("a", "select * from b")
    classes.define("b", "select * from a")
    with pytest.raises(ValueError, match="cycle"):
        classes.sql("select * from a")
    for bad in ("cWW-G-G,", "no such,cWW-A-U"):
        with pytest.raises(Exception):
            classes.sql(f"select * from `{bad}`").collect()
    with pytest.raises(ValueError):
        classes.source("none")
