"""Statuses, warnings, run folders, exports, packages and commands with their exit codes; views of a scene against numpy."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitspark import cli, errors
from orbitspark.functions import text
from orbitspark.operators import cameras as cam
from orbitspark.operators import cloud as cl
from orbitspark.operators import results as rs
from orbitspark.operators import runs as rn
from orbitspark.operators import scenes
from orbitspark.plans import result_queries
from orbitspark.sources import checksums, ply, run_folders
from tests.test_operators import points as places
from tests.test_operators import ring


def points(spark, xyz):
    return places(spark, xyz).withColumns({c: (F.col("point_id") * k % 256).cast("int") for c, k in (("r", 3), ("g", 5), ("b", 7))})


@pytest.mark.parametrize("code", rn.WARNINGS)
def test_codes_are_closed_and_messages_name_no_cause(spark, code):
    none = F.lit(None).cast("string")
    seen = rs.observed_warnings(F.lit(30), F.lit(100), F.lit(0.02), F.lit(4.99), F.lit(6), F.lit(10))
    stated = rs.stated_warnings(F.lit("r1"), F.lit(True), F.lit("no error"), F.lit("too few cameras"))
    row = spark.range(1).select(rs.merge_warnings(seen, stated).alias("w")).select("w", F.exists("w", lambda w: rs.names_a_cause(w["message"])).alias("cause"), rs.foreign_codes(F.col("w")).alias("foreign")).first()
    assert code in [w["code"] for w in row["w"]] and len(row["w"]) == 8 and not row["cause"] and row["foreign"] == [] and all(w["observation_only"] for w in row["w"])
    assert spark.range(1).select(rs.names_a_cause(F.lit("blurred, since you moved"))).first()[0] and none is not None
    with pytest.raises(ValueError):
        rs.warning("no_such_code", "x")


def test_thresholds_fire_at_their_values(spark):
    cases = [((30, 100, 0.5, 9.0, 9, 10), ["many_blurry_frames"]), ((29, 100, 0.02, 5.0, 7, 10), ["low_viewpoint_diversity"]), ((0, 0, 0.5, 4.9, 6, 10), ["short_video", "few_registered_cameras"]), ((None,) * 6, []), ((0, 10, 0.5, 9.0, 0, 0), ["few_registered_cameras"])]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, rejected int, total int, diff double, seconds double, cams int, frames int")
    got = df.select("i", rs.observed_warnings(*(F.col(c) for c in ("rejected", "total", "diff", "seconds", "cams", "frames"))).alias("w"))
    assert {r["i"]: [w["code"] for w in r["w"]] for r in got.collect()} == {i: codes for i, (_, codes) in enumerate(cases)}


def test_partial_results_say_so(spark):
    own = rs.few_registered(F.lit(1), F.lit(9))
    none = F.array().cast(f"array<{rs.WARNING}>")
    for warnings, count in ((none, 1), (F.array(own), 1), (F.array(rs.warning("short_video", "s")), 2)):
        cols = rs.build_status(F.lit("partial"), warnings, F.lit(9), F.lit(10), F.lit(False), F.lit(None).cast("string"))
        row = spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()
        assert row["viewable"] and row["exportable"] and len(row["warnings"]) == count and row["warnings"][-1]["code"] == "few_registered_cameras"
    with pytest.raises(Exception, match="without the numbers"):
        spark.range(1).select(*(c.alias(n) for n, c in rs.build_status(F.lit("partial"), none, F.lit(None).cast("int"), F.lit(10), F.lit(False), F.lit(None).cast("string")).items())).collect()


def test_unknown_stored_checks_stay(spark):
    log = spark.createDataFrame([("a", "old_item", "defect", "n", 1, 1), ("a", "duplicated_geometry", "ok", None, 2, 2), ("a", "duplicated_geometry", "not_checked", "later", 3, 3)], "run_id string, item string, result string, note string, at long, seq long")
    rows = {r["item"]: r for r in rs.visual_checks(log, log).collect()}
    assert len(rows) == 7 and rows["old_item"]["result"] == "defect" and rows["old_item"]["place"] == 6
    assert rows["duplicated_geometry"]["result"] == "not_checked" and rows["duplicated_geometry"]["checked_at"] is None and rows["duplicated_geometry"]["note"] == "later"
    assert rs.defects(rs.visual_checks(log, log)).first()["visual_check_defects"] == 1


def make_run(spark, folder, status="success", n=50, run="r1", of=None):
    run_folders.write_json(spark, f"{folder}/{run_folders.MANIFEST}", {"run_id": run, "code_id": "c", "seed": 42, "params": {"budget": 48}}, True)
    banner = rn.BANNERS.get(status, "")
    run_folders.write_json(spark, f"{folder}/{run_folders.STATUS}", {"run_id": of or run, "status": status, "viewable": status in ("success", "partial"), "banner": banner, "warnings": [{"code": "short_video", "message": "short video: 3.0 s"}]}, True)
    run_folders.write_json(spark, f"{folder}/{run_folders.CAMERAS}", {"run_id": run, "cameras": [{}, {}], "conventions": {"scale_status": "not_determined"}}, True)
    run_folders.write_json(spark, f"{folder}/{run_folders.DIAGNOSTICS}", {"run_id": run, "visual_check": {"old": {"result": "ok"}}}, True)
    xyz = np.random.default_rng(1).normal(size=(max(n, 1), 3))
    ply.write_ply(points(spark, xyz).limit(n), f"{folder}/normalized", run)
    return folder


def test_strict_and_canonical_json(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert run_folders.canonical({"b": 1, "a": [1.5, None, "ñ"]}) == '{"a":[1.5,null,"ñ"],"b":1}'
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            run_folders.write_json(spark, f"{folder}/x.json", {"v": [bad]})
    run_folders.write_json(spark, f"{folder}/x.json", {"v": 1})
    assert run_folders.read_json(spark, f"{folder}/x.json") == {"v": 1}
    with pytest.raises(errors.AlreadyThere):
        run_folders.write_json(spark, f"{folder}/x.json", {"v": 2})
    (tmp_path / "bad.json").write_text('{"v": NaN}')
    for name in ("bad.json", "none.json"):
        with pytest.raises(errors.MissingOrForeign):
            run_folders.read_json(spark, f"{folder}/{name}")
    with pytest.raises(errors.MissingOrForeign, match="no run id"):
        run_folders.require_same_run("r", a={"run_id": "r"}, b={})
    with pytest.raises(errors.AlreadyThere):
        [run_folders.create_run(spark, folder, "r1") for _ in range(2)]


@pytest.mark.parametrize("status,n,force,again,code,name", [
    ("success", 50, False, False, 0, "object.ply"), ("partial", 50, False, True, 8, None), ("success", 50, True, True, 0, "object.ply"), ("failed", 50, False, False, 6, None),
    ("failed", 50, True, False, 0, "object.UNUSABLE.ply"), ("success", 0, True, False, 6, None), ("odd", 50, True, False, 7, None),
])
def test_export_codes(spark, tmp_path, status, n, force, again, code, name):
    run = make_run(spark, f"file://{tmp_path}/run", status, n)
    args = ["export", run] + ["--force"] * force
    if again:
        assert cli.main(["export", run]) == 0
    assert cli.main(args) == code
    if code == 0:
        back = ply.read_ply(spark, f"{run}/export/{name}")
        assert back.count() == n and {r[0] for r in back.select("run_id").distinct().collect()} == {"r1"}
        header = next((tmp_path / "run" / "export" / name).glob("*.ply")).read_bytes().split(b"end_header")[0]
        assert (b"unusable: true" in header) == ("UNUSABLE" in name)


def test_export_of_another_run_is_refused(spark, tmp_path):
    assert cli.main(["export", make_run(spark, f"file://{tmp_path}/run", of="r2")]) == 7
    assert cli.main(["export", f"file://{tmp_path}/nothing"]) == 7


def test_report_checks_view_and_media(spark, tmp_path, capsys):
    run = make_run(spark, f"file://{tmp_path}/run", n=200)
    assert cli.main(["report", run]) == 0
    shown = capsys.readouterr().out
    assert all(f"## {s}" in shown for s in text.SECTIONS) and "unavailable" in shown and "short video: 3.0 s" in shown
    assert cli.main(["visual-check", run, "--item", "color_inconsistency", "--result", "defect", "--note", "spots"]) == 0
    assert cli.main(["visual-check", run, "--item", "color_inconsistency", "--result", "fine"]) == 2 and cli.main(["visual-check", run, "--item", "nothing", "--result", "ok"]) == 2
    stored = run_folders.read_json(spark, f"{run}/{run_folders.DIAGNOSTICS}")["visual_check"]
    assert stored["color_inconsistency"]["result"] == "defect" and stored["color_inconsistency"]["checked_at"] and stored["old"] == {"result": "ok"}
    assert cli.main(["view", run]) == 0 and cli.main(["view", make_run(spark, f"file://{tmp_path}/bad", "failed")]) == 6
    assert cli.main(["media", run, f"file://{tmp_path}/media", "--size", "64", "--turntable", "3"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/media/pixels").select("view").distinct().count() == 7 == spark.read.json(f"file://{tmp_path}/media/index").count()


def test_prepare_packs_the_selected_frames(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    rows = []
    for i in range(20):
        (tmp_path / "in" / f"{i}.jpg").write_bytes(bytes([i]) * (100 + i))
        rows.append(("r1", i, i * 1000, float(i), f"file://{tmp_path}/in/{i}.jpg"))
    spark.createDataFrame(rows, "run_id string, src_index int, timestamp_us long, sharpness double, path string").write.parquet(f"file://{tmp_path}/candidates")
    sums = []
    for name in ("a", "b"):
        package = f"file://{tmp_path}/{name}"
        assert cli.main(["prepare", f"file://{tmp_path}/candidates", package, "--budget", "12"]) == 0
        assert cli.main(["verify", package]) == 0
        sums.append((tmp_path / name / "SHA256SUMS").read_text())
    assert sums[0] == sums[1] and sums[0].count("images/") == 12 and "'image_count': 12" in capsys.readouterr().out
    assert cli.main(["prepare", f"file://{tmp_path}/candidates", f"file://{tmp_path}/a", "--budget", "12"]) == 8
    assert cli.main(["prepare", f"file://{tmp_path}/candidates", f"file://{tmp_path}/c", "--budget", "5"]) == 3
    next((tmp_path / "b" / "images").glob("*.jpg")).write_bytes(b"x")
    assert cli.main(["verify", f"file://{tmp_path}/b"]) == 4
    frames = spark.createDataFrame([("f0", 0, True), ("f9", 99, True)], "frame_id string, src_index int, selected boolean")
    with pytest.raises(errors.InputUnusable, match="f9"):
        run_folders.build_package(frames, spark.createDataFrame(rows, "run_id string, src_index int, timestamp_us long, sharpness double, path string"), f"file://{tmp_path}/d", {})


def test_results_are_copied_by_part_and_web_clouds_are_light(spark, tmp_path):
    for name in ("sparse/0/cameras.bin", "points.ply", "run.log", "images/1.jpg", "other.txt"):
        (tmp_path / "from" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "from" / name).write_bytes(name.encode())
    run_folders.copy_result(spark, f"file://{tmp_path}/from", f"file://{tmp_path}/to")
    assert sorted(r["path"] for r in checksums.list_folder(spark, f"file://{tmp_path}/to").collect()) == ["points.ply", "run.log", "sparse/0/cameras.bin"]
    ply.write_ply(points(spark, np.random.default_rng(2).normal(size=(3000, 3))), f"file://{tmp_path}/cloud", "r7")
    label = run_folders.write_web_cloud(spark, f"file://{tmp_path}/cloud", f"file://{tmp_path}/web", 300)
    back = ply.read_ply(spark, f"file://{tmp_path}/web")
    assert label == f"{back.count()} of 3,000 points" and 200 < back.count() <= 300 and back.first()["run_id"] == "r7"


def test_refusals_of_tasks_keep_their_code(spark, tmp_path):
    for name in ("cameras.bin", "images.bin", "points3D.bin"):
        (tmp_path / name).write_bytes(b"\x05" + b"\0" * 7 + b"\x01")
    spark.createDataFrame([("a", True)], "frame_id string, selected boolean").write.parquet(f"file://{tmp_path}/frames")
    assert cli.main(["ingest", f"file://{tmp_path}", f"file://{tmp_path}/frames", f"file://{tmp_path}/out", "r"]) == 7


def test_comparison_text():
    exp = {"exp_id": "e", "exit_code": 0, "verdict": "improvement", "relative_difference": 0.25, "repeat_difference": None, "reasons": []}
    metrics = [{"metric": "num_points_valid", "branch": "baseline", "value": 10.0, "availability": "available", "reason": None, "units": None}, {"metric": "num_points_valid", "branch": "variant", "value": None, "availability": "unavailable", "reason": "lost", "units": None}]
    shown = text.comparison_text(exp, metrics)
    assert "Verdict: improvement" in shown and "| num_points_valid | 10 | unavailable: lost | not run |" in shown
    assert "- no repeat run" in text.comparison_text(exp | {"exit_code": 9, "reasons": ["no repeat run"]}, [])


def test_axis_angle():
    turn = np.array(scenes.axis_angle((0, 0, 2), 90))
    assert np.allclose(turn, [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    with pytest.raises(ValueError):
        scenes.axis_angle((0, 0, 0), 1)


def test_scene_and_views_against_numpy(spark):
    cams, pts = scenes.make_scene(spark, 5, 300)
    assert cams.count() == 5 and pts.where("greatest(abs(x), abs(y), abs(z)) = 0.5").count() == 300
    views = scenes.view_cameras(cl.robust_extent(pts), 48).unionByName(scenes.trajectory_camera(cams, cl.robust_extent(pts), 48))
    got = {(r["view"], r["px"], r["py"]): (r["r"], r["g"], r["b"]) for r in scenes.render_points(pts, views, shading=0.0).collect()}
    xyz = pts.orderBy("point_id").toPandas()
    want = {}
    for v in views.collect():
        pose = np.array([[v[f"r{i}{j}"] for j in range(3)] for i in range(3)])
        c = xyz[["x", "y", "z"]].to_numpy() @ pose.T + [v["t0"], v["t1"], v["t2"]]
        big = np.full((96, 96, 3), 255.0)
        depth = np.full((96, 96), np.inf)
        drawn = np.zeros((96, 96), bool)
        for k in np.lexsort((np.arange(300), c[:, 2])):
            u, w = np.round((v["fx"] * c[k, 0] / c[k, 2] + v["cx"]) * 2), np.round((v["fy"] * c[k, 1] / c[k, 2] + v["cy"]) * 2)
            for dx in range(-3, 4):
                for dy in range(-3, 4):
                    x, y = int(u) + dx, int(w) + dy
                    if dx * dx + dy * dy <= 2.2**2 + 1e-9 and 0 <= x < 96 and 0 <= y < 96 and c[k, 2] < depth[y, x]:
                        depth[y, x], big[y, x], drawn[y, x] = c[k, 2], xyz.loc[k, ["r", "g", "b"]].to_numpy(float), True
        for y in range(48):
            for x in range(48):
                if drawn[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].any():
                    want[(v["view"], x, y)] = tuple(int(math.floor(t)) for t in big[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean(axis=(0, 1)))
    assert got == want and len({k[0] for k in got}) == 5
    dark = scenes.render_points(pts, views, shading=0.35).agg(F.avg("r")).first()[0]
    assert dark < np.mean([c[0] for c in got.values()])
    marks = scenes.mark_points(cams.select(*(c.alias(n) for c, n in zip(cam.centre(), "xyz"))), views.where("view = 'trajectory'"))
    assert marks.count() > 50 and marks.where("px < 0 or px > 47").isEmpty()


def test_entities(spark):
    cams = ring(spark).withColumn("frame_id", F.format_string("%04d", "k"))
    out = scenes.entities(points(spark, np.zeros((4, 3))), cams)
    assert out.where("kind = 'camera'").count() == cams.count() and out.where("path = 'world/points' and n = 4").count() == 1
    with pytest.raises(ValueError):
        scenes.entities(points(spark, np.zeros((4, 3))), cams, "camera_to_world")


def test_pictures_do_not_deal_the_cloud_anew(spark, tmp_path):
    """forty places, a thousand points on each: what is shuffled is bounded by the pixels, and not by the points."""
    place, copy = F.col("id") % 40, F.floor(F.col("id") / 40)
    orders = spark.range(40_000).select(F.col("id").alias("o_orderkey"), (place * 5).alias("o_custkey"), (place * 9000.0).alias("o_totalprice"), F.date_add(F.lit("1992-01-01").cast("date"), (place * 50).cast("int")).cast("timestamp").alias("o_orderdate"), copy.alias("copy"))
    orders.write.parquet(f"file://{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("f6", "f6")
    try:
        found = result_queries.q_render_points(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sparkContext.setJobGroup("", "")
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("f6") for s in tracker.getJobInfo(j).stageIds}
    assert len({r["view"] for r in found}) == 4 and stages and sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 40_000
