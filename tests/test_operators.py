"""Hand-computed cases, invariants and numpy twins of the reference operators."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitspark import errors
from orbitspark.functions import linalg as la
from orbitspark.functions import measures as ms
from orbitspark.operators import cameras as cam
from orbitspark.operators import cloud as cl
from orbitspark.operators import frames as fr
from orbitspark.operators import runs as rn
from orbitspark.sources import checksums, ply, sparse_model, video


def candidates(spark, sharp, step=1):
    return spark.createDataFrame([("r", i * step, float(s)) for i, s in enumerate(sharp)], "run_id string, src_index int, sharpness double")


@pytest.mark.parametrize("budget", [1, 2, 7, 12, 40, 60])
def test_uniform_budget(spark, budget):
    rows = fr.select_uniform(candidates(spark, [0] * 40), "run_id", budget).where("selected").collect()
    got = sorted(r["src_index"] for r in rows)
    assert len(got) == min(40, budget)
    if budget >= 2:
        assert got[0] == 0 and got[-1] == 39
        assert got == sorted({round(i * (39 / (budget - 1))) for i in range(budget)}) or budget >= 40


def test_uniform_needs_a_budget(spark):
    for budget in (0, -1):
        with pytest.raises(ValueError):
            fr.select_uniform(candidates(spark, [1]), "run_id", budget)


def test_quality_takes_the_sharp_frame(spark):
    rows = {r["src_index"]: r for r in fr.select_quality(candidates(spark, [1.0 if i != 7 else 9.0 for i in range(30)]), "run_id", 3, 0.0).collect()}
    assert rows[7]["selected"] and rows[3]["reject_reason"] == "less_sharp_in_window"


def test_quality_falls_back(spark):
    out = fr.select_quality(candidates(spark, [5.0] * 20), "run_id", 2, 0.9)
    info = fr.selection_info(out, "run_id").first()
    assert (info["selected"], info["fallbacks"]) == (2, 1)
    assert {r["reject_reason"] for r in out.where("window = 1 and not selected").collect()} == {"redundant"}


def test_quality_counts_comparisons(spark):
    info = fr.selection_info(fr.select_quality(candidates(spark, range(30)), "run_id", 5, 0.0), "run_id").first()
    assert info["diff_evaluations"] == 4


@pytest.mark.parametrize("n", [1, 2, 5, 9, 16, 47, 100])
def test_windows_follow_numpy(spark, n):
    rows = fr.with_windows(candidates(spark, [0] * n), "run_id", 8).orderBy("src_index").collect()
    edges = np.round(np.linspace(0, n, min(8, n) + 1))
    assert [r["window"] for r in rows] == [int(np.searchsorted(edges[1:-1], i, side="right")) for i in range(n)]


def test_sharpness(spark):
    rng = np.random.default_rng(3)
    image = rng.random((9, 6))
    lap = image[:-2, 1:-1] + image[2:, 1:-1] + image[1:-1, :-2] + image[1:-1, 2:] - 4 * image[1:-1, 1:-1]
    rows = [("a", 9, 6, image.ravel().tolist()), ("flat", 4, 4, [0.5] * 16), ("small", 2, 5, [0.1] * 10)]
    df = spark.createDataFrame(rows, "name string, h int, w int, px array<double>")
    got = {r["name"]: r["s"] for r in df.select("name", fr.laplacian_variance(F.col("px"), F.col("h"), F.col("w")).alias("s")).collect()}
    assert got["a"] == pytest.approx(lap.var()) and got["flat"] == pytest.approx(0, abs=1e-12) and got["small"] == 0


def test_difference_of_an_inverse_is_one(spark):
    df = spark.createDataFrame([([0.0, 1.0], [1.0, 0.0]), ([0.0], None)], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(fr.frame_difference(F.col("a"), F.col("b"))).collect()] == [1.0, None]


def points(spark, xyz, **more):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")


def test_outliers_and_bounds(spark):
    rng = np.random.default_rng(1)
    xyz = np.vstack([rng.normal(0, 0.1, (40, 3)), [[1000, 0, 0]], [[np.nan, 0, 0]], [[np.inf, 0, 0]]])
    df = points(spark, xyz)
    ok = xyz[:41]
    q1, q3 = np.percentile(ok, [25, 75], axis=0)
    inside = ((ok >= q1 - 3 * (q3 - q1)) & (ok <= q3 + 3 * (q3 - q1))).all(axis=1)
    assert sorted(r["point_id"] for r in cl.filter_outliers(df).collect()) == np.flatnonzero(inside).tolist() and not inside[40]
    info = cl.outlier_info(df).first()
    assert (info["n_total"], info["n_finite"], info["n_kept"]) == (43, 41, inside.sum())
    assert info["lo_x"] == pytest.approx((q1 - 3 * (q3 - q1))[0])
    empty = cl.bounding_box(df.where("point_id > 40")).first()
    assert empty["min_x"] is None and empty["reason"] == "no finite points"


def test_quantiles_of_groups(spark):
    from orbitspark.operators.quantiles import group_quantiles, quantile_row

    rng = np.random.default_rng(12)
    n = 20_000
    data = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n).astype(float), rng.pareto(0.2, n), rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n)])
    data[0] = [1e300, 5.0, 1.7e308, -1.7e308]
    group = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 9, n))
    rows = [(None if g == 8 else int(g), *map(float, r)) for g, r in zip(group, data)]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double, w double").repartition(5)
    fractions = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]
    for few in (10, 500, 200_000):
        got = {r["g"]: [r[c] for c in "xyzw"] for r in group_quantiles(df, "g", ["x", "y", "z", "w"], fractions, few, at_once=few).collect()}
        assert set(got) == {None, *range(8)}
        for g, found in got.items():
            want = np.percentile(data[group == (8 if g is None else g)], [100 * f for f in fractions], axis=0).T
            assert np.allclose(found, want, rtol=1e-12), (few, g)
    assert quantile_row(df.where("g = 77"), ["x"], [0.5]).first()["x"] is None


def test_quantiles_collect_no_repeated_values(spark):
    """A wanted rank between two values that are each repeated far beyond what may be sorted: the values are counted, never gathered."""
    from orbitspark.operators import quantiles

    df = spark.range(3_000_000, numPartitions=8).select((F.col("id") % 2).cast("double").alias("x"), F.lit("one").alias("run"))
    assert quantiles.quantile_row(df, ["x"], [0.25, 0.5, 0.75], few=1000).first()["x"] == [0.0, 0.5, 1.0]
    long = df.select(F.struct("run").alias("g"), F.lit("x").alias("c"), F.col("x").alias("v"))
    sizes = long.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo_x"), F.max("v").alias("hi_x"))
    state = quantiles.narrowed(long, quantiles.ranges(sizes, ["x"], [0.5]), 1)
    assert sorted((r["lo"], r["hi"], r["n"], r["below"]) for r in state.collect()) == [(0.0, 0.0, 1_500_000, 0), (1.0, 1.0, 1_500_000, 1_500_000)]


def test_clouds_by_run(spark):
    rng = np.random.default_rng(6)
    runs = {"a": rng.normal(size=(300, 3)), "b": rng.normal(5, 2, (50, 3)), None: rng.normal(size=(20, 3)), "none": np.full((2, 3), np.nan)}
    runs["a"][0] = [1e6, 0, 0]
    rows = [(r, k, *map(float, p)) for r, ps in runs.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "run string, point_id long, x double, y double, z double")
    kept = {r["run"]: r["n"] for r in cl.filter_outliers(df, 3.0, "run").groupBy("run").agg(F.count("*").alias("n")).collect()}
    info = {r["run"]: r for r in cl.outlier_info(df, 3.0, "run").collect()}
    ext = {r["run"]: r for r in cl.robust_extent(df, 98.0, "run").collect()}
    box = {r["run"]: r for r in cl.bounding_box(df, "run").collect()}
    assert set(info) == set(ext) == set(box) == set(runs) and (ext["none"]["cx"], ext["none"]["radius"]) == (0.0, 1.0) and box["none"]["reason"]
    for run, xyz in runs.items():
        if run == "none":
            continue
        one = points(spark, xyz)
        assert kept[run] == cl.filter_outliers(one).count() == info[run]["n_kept"]
        q = cl.robust_extent(one).first()
        assert all(ext[run][c] == pytest.approx(q[c]) for c in ("cx", "cy", "cz", "radius"))
        assert [box[run][f"max_{c}"] for c in "xyz"] == xyz.max(axis=0).tolist()


def test_extent(spark):
    xyz = np.random.default_rng(2).normal(size=(300, 3))
    row = cl.robust_extent(points(spark, xyz)).first()
    centre = np.median(xyz, axis=0)
    assert row["radius"] == pytest.approx(np.percentile(np.linalg.norm(xyz - centre, axis=1), 98))
    none = cl.robust_extent(points(spark, [[np.nan] * 3])).first()
    assert (none["cx"], none["radius"]) == (0.0, 1.0)


def test_decimation(spark):
    xyz = np.random.default_rng(4).normal(size=(5000, 3)).astype("f4").astype("f8")
    df = points(spark, xyz)
    kept, size = cl.voxel_decimate(df, 800)
    rows = kept.collect()
    assert 0.85 * 800 <= len(rows) <= 800 and size > 0
    assert all(tuple(xyz[r["point_id"]]) == (r["x"], r["y"], r["z"]) for r in rows)
    assert cl.voxel_decimate(df, 5000)[1] is None and cl.count_label(500, 500) == "500 of 500 points"
    same, size = cl.voxel_decimate(points(spark, [[1, 1, 1]] * 9), 3)
    assert (same.count(), size) == (1, 0.0)


def test_nearer_point_wins(spark):
    df = spark.createDataFrame([(1, 5.0, 0, 0), (2, 3.0, 0, 0), (3, 3.0, 0, 0)], "point_id long, depth double, px long, py long")
    assert cl.nearest_per_pixel(df).first()["point_id"] == 2


def ring(spark, n=24, radius=1.0, height=0.6, arc=360.0, tilt=0.0, offset=(0, 0, 0)):
    """Cameras on a ring about +Y that look at the centre, then tilted about x and moved."""
    a, rows = math.radians(tilt), []
    turn = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    for k in range(n):
        phi = math.radians(arc) * k / n
        p = np.array([radius * math.sin(phi), height, radius * math.cos(phi)])
        z = -p / np.linalg.norm(p)
        x = np.cross(z, [0, 1, 0])
        x /= np.linalg.norm(x)
        r = np.stack([x, np.cross(z, x), z]) @ turn.T
        c = turn @ p + offset
        rows.append((k, *map(float, r.ravel()), *map(float, -r @ c)))
    return spark.createDataFrame(rows, ", ".join(["k long", *(f"{c} double" for c in cam.R + cam.T)]))


def test_alignment_of_a_tilted_ring(spark):
    cams = ring(spark, tilt=52, offset=(0.7, -1.3, 2.1))
    a = cam.estimate_alignment(cams).first()
    assert a["status"] == "estimated" and a["centre_method"] == "optical_axes"
    assert a["arc_coverage_deg"] == pytest.approx(345) and a["planarity"] == pytest.approx(0, abs=1e-4)
    r = np.array([a[c] for c in cam.R]).reshape(3, 3)
    t = np.array([a[c] for c in cam.T])
    up = r @ [0, math.cos(math.radians(52)), math.sin(math.radians(52))]
    assert math.degrees(math.acos(min(1, up[1]))) < 0.01
    assert np.allclose(r @ [0.7, -1.3, 2.1] + t, 0, atol=1e-6)
    moved = cam.transform_poses(cams, cam.estimate_alignment(cams)).where("k = 0").select(*(c.alias(n) for c, n in zip(cam.centre(), "xyz"))).first()
    assert moved["x"] == pytest.approx(0, abs=1e-6) and moved["z"] > 0


@pytest.mark.parametrize("arc,status", [(360, "estimated"), (90, "not_estimated")])
def test_alignment_gate(spark, arc, status):
    a = cam.estimate_alignment(ring(spark, arc=arc)).first()
    assert a["status"] == status and (a["reason"] is None) == (status == "estimated")


def test_alignment_of_many_runs(spark):
    rings = {"a": ring(spark, tilt=52, offset=(0.7, -1.3, 2.1)), "b": ring(spark, n=8, tilt=-20), "c": ring(spark, arc=90, tilt=10), "d": ring(spark, n=3), None: ring(spark, n=12, radius=2.0, tilt=180)}
    cams = None
    for run, part in rings.items():
        part = part.withColumn("run", F.lit(run).cast("string"))
        cams = part if cams is None else cams.unionByName(part)
    got = {r["run"]: r.asDict() for r in cam.estimate_alignment(cams, run="run").collect()}
    assert set(got) == set(rings)
    for run, part in rings.items():
        alone = cam.estimate_alignment(part).first().asDict()
        g = {k: v for k, v in got[run].items() if k != "run"}
        assert all(g[k] == pytest.approx(v, abs=1e-9) if isinstance(v, float) else g[k] == v for k, v in alone.items()), run
    assert [got[r]["status"] for r in ("a", "b", "c", "d")] == ["estimated", "estimated", "not_estimated", "not_estimated"] and "min_cameras" in got["d"]["reason"]
    moved = cam.transform_poses(cams, cam.estimate_alignment(cams, run="run"), "run").where("run = 'a' and k = 0").select(*(c.alias(n) for c, n in zip(cam.centre(), "xyz"))).first()
    assert moved["x"] == pytest.approx(0, abs=1e-6) and moved["z"] > 0
    pts = spark.createDataFrame([("c", 1.0, 2.0, 3.0), ("c", 3.0, 2.0, 1.0), ("c", 2.0, 2.0, 2.5)], "run string, x double, y double, z double")
    parallel = spark.createDataFrame([("c", k, *map(float, np.eye(3).ravel()), float(k), 0.0, 0.0) for k in range(7)], ", ".join(["run string, k long", *(f"{c} double" for c in cam.R + cam.T)]))
    a = cam.estimate_alignment(parallel, pts, run="run").first()
    assert a["centre_method"] == "points_median" and (a["t0"], a["t1"], a["t2"]) == (-2.0, -2.0, -2.5)


def test_widest_gap_is_dealt_by_sector(spark):
    rng = np.random.default_rng(3)
    runs = {0: rng.random(5000) * 300, 1: np.array([10.0, 10.0]), 2: np.array([359.9, 0.1, 180.0]), 3: np.array([5.0]), 4: np.arange(0, 360, 15.0), 5: rng.random(40) * 3}
    df = spark.createDataFrame([(r, float(a)) for r, v in runs.items() for a in v], "run int, angle double")
    for r in cam.widest_gap(df, "run").collect():
        v = np.sort(runs[r["run"]])
        assert r["arc_deg"] == pytest.approx(0 if len(v) < 2 else 360 - np.diff(np.append(v, v[0] + 360)).max(), abs=1e-9)


def test_parallel_rays_have_no_meeting_point(spark):
    df = spark.createDataFrame([(float(i), 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(4)], "ox double, oy double, oz double, dx double, dy double, dz double")
    assert cam.nearest_point_to_rays(df).first()["px"] is None


def test_quaternion_round_trip(spark):
    rng = np.random.default_rng(8)
    q = rng.normal(size=(60, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    q = np.vstack([q, [[0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 0]]])
    q *= np.where(q[:, :1] < 0, -1, 1)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "i long, w double, x double, y double, z double")
    m = la.quaternion_to_matrix(*(F.col(c) for c in "wxyz"))
    df = df.select("i", *(m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)))
    back = la.matrix_to_quaternion(la.mat([f"m{i}{j}" for i in range(3) for j in range(3)]))
    for r in df.select("i", *(b.alias(c) for b, c in zip(back, "wxyz"))).collect():
        assert np.allclose([r[c] for c in "wxyz"], q[r["i"]], atol=1e-9)


def test_eigenvalues_follow_numpy(spark):
    rng = np.random.default_rng(9)
    ms_ = [(lambda a: a @ a.T)(rng.normal(size=(3, 3))) for _ in range(40)] + [np.eye(3)]
    df = spark.createDataFrame([(i, *map(float, m[np.triu_indices(3)])) for i, m in enumerate(ms_)], "i long, a double, b double, c double, d double, e double, f double")
    for r in la.with_eigenvalues(df, list("abcdef"), ["e0", "e1", "e2"]).collect():
        assert np.allclose([r["e0"], r["e1"], r["e2"]], np.linalg.eigvalsh(ms_[r["i"]])[::-1], atol=1e-9)


def test_projection_of_one_file_is_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(cam, "PAIRS_OF_A_TASK", 100)
    df = points(spark, np.random.default_rng(8).normal(size=(60, 3))).coalesce(1)
    cams = ring(spark, n=20).withColumns({"fx": F.lit(500.0), "fy": F.lit(500.0), "cx": F.lit(320.0), "cy": F.lit(240.0)})
    seen = cam.project(df, cams)
    assert seen.rdd.getNumPartitions() == 12 and seen.count() == 1200


def test_rounding_is_that_of_duckdb(spark):
    import duckdb

    from orbitspark.plans.book import rounded

    values = [0.00005, -0.00005, 1.00005, -2.5, 0.0, -0.0, -0.00001, 123456.78905, 0.49999999999999994e-4, 1e15 + 0.3, 1e16, -1e300, 1e308, float("inf"), float("nan")] + list(np.random.default_rng(9).normal(0, 1000, 300))
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "x double").select(rounded(F.col("x"), 4)).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 4) + 0.0::DOUBLE", [float(v)]).fetchone()[0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want))
    assert {repr(r[0]) for r in spark.createDataFrame([(None,)], "x double").select(rounded(F.col("x"), 4)).collect()} == {"None"}


def test_projection_needs_positive_depth(spark):
    cams = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 800.0, 800.0, 320.0, 240.0)], ", ".join(["k long", *(f"{c} double" for c in cam.R + cam.T + ["fx", "fy", "cx", "cy"])]))
    seen = {r["point_id"]: r for r in cam.project(points(spark, [[0, 0, 2], [0, 0, -2], [np.nan, 0, 1]]), cams).collect()}
    assert (seen[0]["u"], seen[0]["v"]) == (320, 240) and seen[1]["u"] is None and not seen[2]["valid"]


STATUS = [(0, 0, 0, False, "interrupted"), (5, 9, 5, False, "interrupted"), (0, 9, 5, True, "invalid_result"), (5, 0, 5, True, "invalid_result"), (5, 9, 5, True, "success"), (4, 9, 5, True, "partial"), (1, 1, 5, True, "partial"), (0, 0, 0, True, "invalid_result")]


def test_status_table(spark):
    df = spark.createDataFrame(STATUS, "c int, p int, f int, done boolean, want string")
    for r in df.select("want", rn.status(F.col("c"), F.col("p"), F.col("f"), F.col("done")).alias("got")).collect():
        assert r["got"] == r["want"]
    for bad in ((6, 9, 5), (-1, 9, 5)):
        with pytest.raises(Exception, match="contradictory"):
            spark.createDataFrame([bad], "c int, p int, f int").select(rn.status(F.col("c"), F.col("p"), F.col("f"), F.lit(True))).collect()


VERDICTS = [
    (100.0, 120.0, None, 1.0, 1.0, 1.0, 1.0, "improvement"), (100.0, 120.0, None, 1.0, 0.9, 1.0, 1.0, "regression"), (100.0, 85.0, None, 1.0, 1.0, 1.0, 1.0, "regression"), (100.0, 102.0, None, 1.0, 1.0, 1.0, 1.0, "no_difference"),
    (100.0, 102.0, 97.0, 1.0, 1.0, 1.0, 1.0, "inconclusive"), (None, 102.0, None, 1.0, 1.0, 1.0, 1.0, "inconclusive"), (100.0, 120.0, 101.0, None, 1.0, 1.0, 1.0, "no_difference"), (0.0, 5.0, 0.0, 1.0, 1.0, 0.0, 0.0, "improvement"),
]


def test_verdicts(spark):
    df = spark.createDataFrame(VERDICTS, "b double, v double, r double, br double, vr double, bd double, vd double, want string")
    for r in df.select("want", rn.verdict(*(F.col(c) for c in ("b", "v", "r", "br", "vr", "bd", "vd"))).alias("got")).collect():
        assert r["got"] == r["want"]


def test_warnings_fire_at_their_thresholds(spark):
    df = spark.createDataFrame([(0.3, 0.02, 4.9, 0.6), (0.29, 0.021, 5.0, 0.61), (None, None, None, None)], "b double, d double, s double, r double")
    got = [r[0] for r in df.select(rn.warning_codes(*(F.col(c) for c in "bdsr"))).collect()]
    assert got == [list(rn.WARNINGS[:4]), [], []]


def test_unavailable_is_not_zero(spark):
    df = spark.createDataFrame([(0.0,), (None,), (float("nan"),)], "v double").select(ms.measure(F.col("v"), "none").alias("m"))
    assert [(r["m"]["value"], r["m"]["availability"], r["m"]["reason"]) for r in df.collect()] == [(0.0, "available", None), (None, "unavailable", "none"), (None, "unavailable", "none")]


def test_ply_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i / 4, -i / 2, 1.0, i % 256, 7, 255) for i in range(300)], "point_id long, x double, y double, z double, r int, g int, b int")
    folder = f"file://{tmp_path}/cloud"
    assert ply.write_ply(df, folder, "run-1", {"axes": "up"}, parts=3).agg(F.sum("n_points")).first()[0] == 300
    back = ply.read_ply(spark, folder)
    assert back.select("x", "y", "z", "r", "g", "b").exceptAll(df.select("x", "y", "z", "r", "g", "b")).isEmpty() and back.count() == 300
    assert {r[0] for r in back.select("run_id").distinct().collect()} == {"run-1"}
    with pytest.raises(errors.AlreadyThere):
        ply.write_ply(df, folder, "run-2")
    with pytest.raises(errors.MissingOrForeign):
        ply.parse(ply.header(2, {}) + b"\0" * 15)


def test_sparse_model(spark, tmp_path):
    cams = struct.pack("<Q", 1) + struct.pack("<iiQQ", 1, 1, 640, 480) + struct.pack("<4d", 500, 520, 320, 240)
    images = struct.pack("<Q", 1) + struct.pack("<I7dI", 3, 1, 0, 0, 0, 0.5, 0, 2, 1) + b"images/0001_000010.jpg\0" + struct.pack("<Q", 1) + struct.pack("<ddQ", 1, 2, 2**64 - 1)
    pts = struct.pack("<Q", 2) + b"".join(struct.pack("<Q3d3BdQ", i, i, 0, 1, 9, 8, 7, e, 1) + struct.pack("<II", 3, 0) for i, e in ((5, 0.25), (6, -1.0)))
    for name, data in (("cameras.bin", cams), ("images.bin", images), ("points3D.bin", pts)):
        (tmp_path / name).write_bytes(data)
    c = sparse_model.read_cameras(spark, str(tmp_path)).first()
    assert (c["frame_id"], c["fx"], c["cy"], c["t0"], c["r00"]) == ("0001_000010", 500, 240, 0.5, 1.0)
    got = {r["point_id"]: r["error"] for r in sparse_model.read_points(spark, str(tmp_path)).collect()}
    assert got == {5: 0.25, 6: None}
    (tmp_path / "points3D.bin").write_bytes(pts[:-20])
    with pytest.raises(Exception, match="can't be read"):
        sparse_model.read_points(spark, str(tmp_path)).collect()


def test_checksums(spark, tmp_path):
    for name in ("a.txt", "b.txt", "sub/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    listed = checksums.lines(checksums.list_folder(spark, str(tmp_path))).collect()
    (tmp_path / "SHA256SUMS").write_text("\n".join(r[0] for r in listed) + "\n\n")
    assert checksums.verify(spark, str(tmp_path)).isEmpty()
    (tmp_path / "a.txt").write_text("other")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "d.txt").write_text("new")
    assert {tuple(r) for r in checksums.verify(spark, str(tmp_path)).collect()} == {("a.txt", "changed"), ("b.txt", "missing"), ("d.txt", "extra")}
    assert checksums.verify(spark, str(tmp_path), strict=False).count() == 2
    (tmp_path / "SHA256SUMS").write_text("nonsense\n")
    with pytest.raises(errors.PackageBroken):
        checksums.verify(spark, str(tmp_path))


def test_video_probe(spark):
    good = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"avg_frame_rate":"0/0","r_frame_rate":"30000/1001","nb_frames":"N/A","tags":{"rotate":"90"}}],"format":{"format_name":"mov, mp4","duration":"2.5","size":"100"}}'
    rows = [("a.mp4", good), ("b.mp4", good.replace("h264", "vp9")), ("c.mp4", '{"streams":[],"format":{"format_name":"mp4"}}'), ("d.avi", good.replace("mov, mp4", "avi"))]
    got = {r["path"]: r for r in video.probe(spark.createDataFrame(rows, "path string, json string")).collect()}
    a = got["a.mp4"]
    assert (a["container"], a["rotation_deg"], a["duration_s"], a["nb_frames"], a["exit_code"]) == ("mp4", 270, 2.5, None, 0)
    assert a["avg_fps"] == pytest.approx(29.97, abs=0.01)
    assert [got[k]["exit_code"] for k in ("b.mp4", "c.mp4", "d.avi")] == [2, 2, 2]


def test_aligned_box_is_that_of_the_whole_cloud(spark, sf_dir):
    """All suppliers and all orders, against numpy."""
    import datetime

    import pyarrow.parquet as pq

    from orbitspark.plans.camera_queries import q_aligned_cloud_bbox

    ids = np.sort(pq.read_table(f"{sf_dir}/supplier.parquet")["s_suppkey"].to_numpy())
    phi = 2 * np.pi * 0.6 * ids / len(ids)
    tilt = np.array([[1, 0, 0], [0, 0.5, -(0.75**0.5)], [0, 0.75**0.5, 0.5]])
    # The axes meet in the origin, so that the aligned world is turned back and not shifted.
    front = np.array([3 * np.cos(phi[0]), 3 * np.sin(phi[0]), 1.0])
    yaw = np.arctan2(front[1], front[0])
    turn = np.array([[-np.sin(yaw), np.cos(yaw), 0], [0, 0, 1], [np.cos(yaw), np.sin(yaw), 0]]) @ tilt.T
    o = pq.read_table(f"{sf_dir}/orders.parquet").to_pylist()
    days = [(datetime.date.fromisoformat(str(r["o_orderdate"])[:10]) - datetime.date(1992, 1, 1)).days for r in o]
    p = np.array([((float(r["o_totalprice"]) / 1000 - 150) / 300, (r["o_custkey"] % 97 - 48) / 97, (d - 1200) / 2400) for r, d in zip(o, days)]) @ turn.T
    low, high = np.quantile(p, 0.25, axis=0), np.quantile(p, 0.75, axis=0)
    p = p[((p >= low - 3 * (high - low)) & (p <= high + 3 * (high - low))).all(axis=1)]
    got = q_aligned_cloud_bbox(spark, sf_dir).first()
    assert got["n_points"] == len(p) > 0.9 * len(o)
    assert np.allclose([[got[f"{n}_{c}"] for c in "xyz"] for n in ("min", "max")], [p.min(axis=0), p.max(axis=0)], atol=1e-9)


def test_quality_holds_no_run_in_memory(spark):
    """Against a plain fold, with runs longer than an Arrow batch, missing and odd values; no array of a run in the plan."""
    rng = np.random.default_rng(4)
    rows = [(r, i, None if i % 17 == 5 else float("nan") if i % 29 == 7 else float(rng.integers(0, 60))) for r, n in (("a", 900), ("b", 3), ("c", 1), ("d", 120), ("e", 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "run_id string, src_index int, sharpness double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = fr.select_quality(df.repartition(5), "run_id", 8, 0.1)
        got = {(r["run_id"], r["window"]): (r["src_index"], r["fallback"]) for r in out.where("selected").collect()}
        seen = fr.with_windows(df, "run_id", 8).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for run in "abcd":
        last = None
        for w in sorted({r["window"] for r in seen if r["run_id"] == run}):
            key = lambda r: (r["sharpness"] is None, 0 if r["sharpness"] is None else -np.inf if math.isnan(r["sharpness"]) else -r["sharpness"], r["src_index"])
            own = sorted((r for r in seen if r["run_id"] == run and r["window"] == w), key=key)
            fresh = [r for r in own if last is None or (r["sharpness"] is not None and not abs(r["sharpness"] - last) / 500 < 0.1)]
            pick = (fresh or own)[0]
            want[run, w], last = (pick["src_index"], not fresh), pick["sharpness"]
    assert got == want and any(f for _, f in want.values()) and len(want) == 8 + 3 + 1 + 8
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_selection_time_holds_no_run_in_memory(spark, sf_dir):
    from orbitspark.plans.run_queries import q_selection_time

    assert "collect_list" not in q_selection_time(spark, sf_dir)._jdf.queryExecution().toString()


def test_ingest_writes_files_by_point_count(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from orbitspark import cli

    points = spark.range(1000).selectExpr("id as point_id", "double(id) as x", "0D as y", "0D as z", "1 as r", "2 as g", "3 as b")
    one = spark.createDataFrame([("estimated",)], "status string")
    monkeypatch.setattr(cli.sparse_model, "read_cameras", lambda *a: None)
    monkeypatch.setattr(cli.sparse_model, "read_points", lambda *a: None)
    monkeypatch.setattr(cli.pipelines, "ingest", lambda *a: {"points": points, "alignment": one, "diagnostics": one})
    monkeypatch.setattr(cli, "report", lambda *a: "")
    monkeypatch.setattr(ply, "POINTS_A_FILE", 300, raising=False)
    spark.createDataFrame([("f", True)], "frame_id string, selected boolean").write.parquet(f"{tmp_path}/frames")
    assert cli._ingest(spark, SimpleNamespace(model="m", frames=f"{tmp_path}/frames", out=f"file://{tmp_path}/out", run_id="r")) == 0
    assert len(list((tmp_path / "out").glob("*.ply"))) == 4
    assert ply.read_ply(spark, f"{tmp_path}/out").count() == 1000


@pytest.mark.parametrize("index", ["cast(id % 50 AS bigint)", "format_string('%03d', id % 50)", "nullif(id % 50, 7)"])
def test_nearest_in_tasks_is_the_nearest_of_all(spark, index):
    depth = "CASE id % 11 WHEN 0 THEN null WHEN 1 THEN double('NaN') WHEN 2 THEN -0.0D ELSE double(id * 7 % 13) END"
    rows = spark.range(0, 6000, 1, 3).selectExpr("nullif(id % 5, 3) AS px", "(id % 7 - 3) * 3000000000000000000 AS py", "CASE id % 4 WHEN 0 THEN null ELSE format_string('v%d', id % 4) END AS view", f"{depth} AS depth", f"{index} AS point_id")
    keys = ["view", "px", "py"]
    want = sorted(map(repr, cl.nearest(rows, keys).collect()))
    for most in (100, 1 << 20):  # 132 pixels at most: with 100 a task passes on what it holds
        some = cl.nearest_in_tasks(rows, keys, most=most)
        assert sorted(map(repr, cl.nearest(some, keys).collect())) == want
    assert some.count() <= 3 * len(want)
    assert cl.nearest_in_tasks(rows.where("px > 9"), keys).isEmpty()


def test_points_are_spread_where_one_task_has_them_all(spark, monkeypatch):
    monkeypatch.setattr(cam, "PAIRS_OF_A_TASK", 1000)
    one, even = spark.range(0, 4000, 1, 1), spark.range(0, 4000, 1, 4)
    assert cam.spread(even, 3) is even and cam.spread(one, 0) is one
    dealt = cam.spread(one, 3)
    assert dealt.rdd.getNumPartitions() > 1 and dealt.distinct().count() == 4000
