"""Experiments as folders and tables: conditions written once, comparisons with all their conditions, and exports that replace only what is theirs."""

import json
import threading

import pytest

from orbitspark import cli, errors
from orbitspark.operators import results as rs
from orbitspark.sources import experiments, ply, run_folders
from tests.test_results import make_run


def experiment(spark, tmp_path, repeat=False):
    (tmp_path / "clip.mp4").write_bytes(b"frames" * 1000)
    folder = f"file://{tmp_path}/exp1"
    args = ["conditions", folder, f"file://{tmp_path}/clip.mp4", "--budget", "48", "--seed", "7"] + ["--repeat-baseline"] * repeat
    return folder, args


def run_folder(spark, tmp_path, name, selector, points=1000, sha=None, code="c1", budget=48, seed=7, normalized=True, ratio=1.0, defects=0):
    folder = f"file://{tmp_path}/{name}"
    conditions = json.loads((tmp_path / "exp1" / "conditions.json").read_text())
    manifest = {
        "run_id": name, "code_id": {"value": code}, "seed": seed, "input": {"sha256": sha or conditions["video"]["sha256"]}, "selection": {"params": {"selector": selector, "budget": budget}},
        "commands": [{"durations_s": {"check": 1.0}}, {"durations_s": {"select": 2.0, "extract": 6.0}}],
    }
    run_folders.write_json(spark, f"{folder}/{run_folders.MANIFEST}", manifest, True)
    if normalized:
        checks = {f"i{k}": {"result": "defect" if k < defects else "ok"} for k in range(3)}
        measures = {"num_points_valid": {"value": points, "availability": "available"}, "registration_ratio": ratio, "alignment_planarity": {"value": None, "availability": "unavailable", "reason": "x"}}
        run_folders.write_json(spark, f"{folder}/{run_folders.DIAGNOSTICS}", {"run_id": name, "measures": measures, "visual_check": checks}, True)
        run_folders.write_json(spark, f"{folder}/{run_folders.STATUS}", {"run_id": name, "status": "success"}, True)
    return folder


def test_conditions_are_written_once(spark, tmp_path):
    folder, args = experiment(spark, tmp_path)
    codes = []
    writers = [threading.Thread(target=lambda: codes.append(cli.main(args))) for _ in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(codes) == [0, 8, 8, 8] and cli.main(args) == 8
    document = experiments.read_conditions(spark, folder)
    assert document["frame_budget"] == 48 and document["exp_id"] == "exp1" and len(document["video"]["sha256"]) == 64
    text = (tmp_path / "exp1" / "conditions.json").read_text()
    (tmp_path / "exp1" / "conditions.json").write_text(text.replace('"seed": 7', '"seed": 8'))
    with pytest.raises(errors.ConditionsDiffer):
        experiments.read_conditions(spark, folder)
    assert cli.main(["conditions", f"file://{tmp_path}/exp2", f"file://{tmp_path}/none.mp4"]) == 7


def test_comparison_of_run_folders(spark, tmp_path, capsys):
    folder, args = experiment(spark, tmp_path)
    assert cli.main(args) == 0
    a = run_folder(spark, tmp_path, "a", "uniform")
    b = run_folder(spark, tmp_path, "b", "quality", points=1300)
    assert cli.main(["compare-runs", folder, a, b]) == 0 and "improvement" in capsys.readouterr().out
    results = json.loads((tmp_path / "exp1" / "results.json").read_text())
    assert results["verdict"] == "improvement" and results["relative_difference"] == pytest.approx(0.3) and results["runs"] == {"baseline": "a", "variant": "b"}
    share = next(m for m in results["metrics"] if m["metric"] == "selection_time_share" and m["branch"] == "variant")
    assert share["value"] == pytest.approx(0.25) and "| num_points_valid |" in (tmp_path / "exp1" / "comparison.md").read_text()
    again = run_folder(spark, tmp_path, "again", "uniform", points=600)
    assert cli.main(["compare-runs", folder, a, b, "--repeat", again]) == 0 and "inconclusive" in capsys.readouterr().out


@pytest.mark.parametrize("change,reason", [
    ({"sha": "other"}, "video_sha256"), ({"budget": 24}, "frame_budget"), ({"seed": 8}, "seed"), ({"code": "c2"}, "code_id"), ({"selector": "uniform"}, "not the branch"), ({"normalized": False}, "no normalized result"),
])
def test_comparisons_that_are_refused(spark, tmp_path, capsys, change, reason):
    folder, args = experiment(spark, tmp_path)
    assert cli.main(args) == 0
    a = run_folder(spark, tmp_path, "a", "uniform")
    b = run_folder(spark, tmp_path, "b", **({"selector": "quality"} | change))
    assert cli.main(["compare-runs", folder, a, b]) == 9 and reason in capsys.readouterr().err
    assert not (tmp_path / "exp1" / "results.json").exists()


def test_a_repeat_that_is_asked_for(spark, tmp_path, capsys):
    folder, args = experiment(spark, tmp_path, repeat=True)
    assert cli.main(args) == 0
    a, b = run_folder(spark, tmp_path, "a", "uniform"), run_folder(spark, tmp_path, "b", "quality")
    assert cli.main(["compare-runs", folder, a, b]) == 9 and "no repeat run" in capsys.readouterr().err
    assert cli.main(["compare-runs", folder, a, b, "--repeat", run_folder(spark, tmp_path, "a2", "uniform")]) == 0


def test_tables_of_experiments(spark, tmp_path, capsys):
    fixed = ("v", 48, 42, "c")
    metrics = lambda points: (1.0, 1.0, points, 300.0, 0.1, 1.0, 1.0, 2.0)
    rows = [("e1", "a", "baseline", "uniform", True, *fixed, *metrics(100.0)), ("e1", "b", "variant", "quality_nonredundant", True, *fixed, *metrics(130.0))]
    rows += [("e2", "c", "baseline", "uniform", True, *fixed, *metrics(100.0)), ("e2", "d", "variant", "quality_nonredundant", True, "v", 24, 42, "c", *metrics(130.0))]
    names = [m for m in rs.METRICS if m != "selection_time_share"]
    assert len(rows[0]) == 9 + len(names) + 1
    spark.createDataFrame(rows, experiments.RUNS).write.parquet(f"{tmp_path}/runs")
    conditions = [(e, *fixed, False, 1.1, 0.9) for e in ("e1", "e2")]
    schema = "exp_id string, video_sha256 string, frame_budget int, seed int, code_id string, repeat_baseline boolean, improvement_ratio double, regression_ratio double"
    spark.createDataFrame(conditions, schema).write.parquet(f"{tmp_path}/conditions")
    spark.createDataFrame(conditions[:1], schema).write.parquet(f"{tmp_path}/one")
    assert cli.main(["compare", f"{tmp_path}/runs", f"{tmp_path}/conditions"]) == 9
    out = capsys.readouterr().out
    assert "e1 0.3" in out and "improvement" in out and "e2 refused: differs in frame_budget" in out
    assert cli.main(["compare", f"{tmp_path}/runs", f"{tmp_path}/one"]) == 0


def test_forced_export_leaves_what_is_not_its_own(spark, tmp_path, monkeypatch):
    run = make_run(spark, f"file://{tmp_path}/run", n=40)
    mine = tmp_path / "mine"
    (mine / "sub").mkdir(parents=True)
    (mine / "notes.txt").write_text("keep")
    (mine / "sub" / "x.ply").write_text("keep")
    (mine / "old.ply").write_text("old")
    assert cli.main(["export", run, "--out", f"file://{mine}"]) == 8
    assert cli.main(["export", run, "--out", f"file://{mine}", "--force"]) == 0
    assert (mine / "notes.txt").read_text() == "keep" and (mine / "sub" / "x.ply").read_text() == "keep" and not (mine / "old.ply").exists()
    (written,) = mine.glob("*.ply")
    before = written.read_bytes()
    assert not list(tmp_path.glob("mine.new-*"))
    monkeypatch.setattr(ply, "write_ply", lambda *a, **k: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        run_folders.export_cloud(spark, run, f"file://{mine}", True)
    assert written.read_bytes() == before


def test_prepare_takes_one_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = []
    for run in ("r1", "r2"):
        for i in range(13):
            (tmp_path / "in" / f"{run}-{i}.jpg").write_bytes(f"{run} {i}".encode())
            rows.append((run, i, i * 1000, float(i), f"file://{tmp_path}/in/{run}-{i}.jpg"))
    schema = "run_id string, src_index int, timestamp_us long, sharpness double, path string"
    both = spark.createDataFrame(rows, schema)
    both.write.parquet(f"file://{tmp_path}/both")
    assert cli.main(["prepare", f"file://{tmp_path}/both", f"file://{tmp_path}/p", "--budget", "12"]) == 2
    frames = both.selectExpr("run_id", "concat('f', src_index) frame_id", "src_index", "true selected").where("run_id = 'r2'")
    run_folders.build_package(frames, both.select("run_id", "src_index", "path"), f"file://{tmp_path}/q", {"run_id": "r2"})
    assert (tmp_path / "q" / "images" / "f4.jpg").read_bytes() == b"r2 4"
    with pytest.raises(errors.InputUnusable, match="several sources"):
        run_folders.build_package(frames.drop("run_id"), both.select("src_index", "path"), f"file://{tmp_path}/s", {})


def test_view_writes_entities_and_panels(spark, tmp_path, capsys):
    run = make_run(spark, f"file://{tmp_path}/run", n=25)
    pose = {"R": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "t": [0.5, 0, 2]}
    run_folders.write_json(spark, f"{run}/{run_folders.CAMERAS}", {"run_id": "r1", "cameras": [pose | {"frame_id": "0001"}, {"frame_id": "lost"}]}, True)
    run_folders.write_json(spark, f"{run}/{run_folders.DIAGNOSTICS}", {"run_id": "r1", "measures": {"num_points_valid": 25, "mean_reprojection_error": {"value": None, "availability": "unavailable", "reason": "no point has an error"}}}, True)
    assert cli.main(["view", run, "--out", f"file://{tmp_path}/view"]) == 0 and "25 of 25 points" in capsys.readouterr().out
    shown = {r["path"]: r for r in spark.read.parquet(f"file://{tmp_path}/view/entities").collect()}
    assert set(shown) == {"world/points", "world/cameras/0001"} and shown["world/points"]["n"] == 25 and (shown["world/cameras/0001"]["t0"], shown["world/cameras/0001"]["t2"]) == (-0.5, -2.0)
    panel = json.loads((tmp_path / "view" / "panels.json").read_text())
    assert "short_video" in panel["warnings"] and "unavailable: no point has an error" in panel["metrics"] and panel["info"] == "25 of 25 points"
    assert cli.main(["media", run, f"file://{tmp_path}/media", "--size", "48"]) == 0
    assert spark.read.json(f"file://{tmp_path}/media/index").where("kind = 'trajectory'").count() == 1
    run_folders.write_json(spark, f"{run}/{run_folders.CAMERAS}", {"run_id": "r1", "cameras": [], "conventions": {"pose_direction": "camera_to_world"}}, True)
    with pytest.raises(ValueError):
        cli.main(["view", run, "--out", f"file://{tmp_path}/other"])
