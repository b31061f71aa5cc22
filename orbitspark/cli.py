"""Command line: check, prepare, ingest, verify, export, report, visual-check, media, view, conditions, compare, compare-runs. Refusals end with their exit code."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from orbitspark.errors import InputUnusable, MissingOrForeign, PackageBroken, Refusal
from orbitspark.functions.text import full_report, panels, report
from orbitspark.operators import cameras as cam
from orbitspark.operators import cloud as cl
from orbitspark.operators import results as rs
from orbitspark.operators import scenes
from orbitspark.plans import pipelines
from orbitspark.sources import checksums, experiments, ply, run_folders, sparse_model, video


def _check(spark, args):
    rows = video.probe(spark.read.text(args.probe_json, wholetext=True).selectExpr("_metadata.file_name as path", "value as json")).collect()
    for r in rows:
        print(r["path"], r["reason"] or "usable")
    return max((r["exit_code"] for r in rows), default=0)


def _ingest(spark, args):
    cams, pts = sparse_model.read_cameras(spark, args.model), sparse_model.read_points(spark, args.model)
    selected = spark.read.parquet(args.frames).where("selected").select("frame_id")
    out = pipelines.ingest(cams, pts, selected)
    ply.write_ply(out["points"], args.out, args.run_id, {"axes": "y up" if out["alignment"].first()["status"] == "estimated" else "not aligned"}, ply.parts_for(out["points"].count()))
    print(report(out["diagnostics"].first().asDict(recursive=True), out["alignment"].first().asDict(recursive=True)))
    return 0


def _prepare(spark, args):
    """Selects from a table of candidates (run_id, src_index, timestamp_us, sharpness, path) and packs the selected frames."""
    candidates = spark.read.parquet(args.candidates)
    ids = [r[0] for r in candidates.select("run_id").distinct().limit(2).collect()]
    if len(ids) != 1:
        raise InputUnusable(f"one package holds one run, and there are {'more' if ids else 'none'} in {args.candidates}")
    fate = pipelines.prepare(candidates.drop("path"), budget=args.budget, selector=args.selector, min_frames=args.min_frames)
    totals = run_folders.build_package(fate, candidates.select("run_id", "src_index", "path"), args.package, {"run_id": ids[0], "frame_budget": args.budget, "selector": args.selector})
    print(totals)
    return 0


def _export(spark, args):
    print(run_folders.export_cloud(spark, args.run, args.out, args.force))
    return 0


def _optional(spark, path):
    try:
        return run_folders.read_json(spark, path)
    except MissingOrForeign as e:
        return {"missing": str(e)}


def _report(spark, args):
    manifest = run_folders.find_run(spark, args.run)
    diagnostics, cameras = (_optional(spark, f"{args.run}/{p}") for p in (run_folders.DIAGNOSTICS, run_folders.CAMERAS))
    status = _optional(spark, f"{args.run}/{run_folders.STATUS}")
    of = lambda doc, key: doc if "missing" in doc else doc.get(key)
    documents = {
        "Status": status if "missing" not in status else None, "Conventions": of(cameras, "conventions"), "Alignment": of(cameras, "world_alignment"), "Input": manifest.get("input"), "Integrity": manifest.get("integrity"),
        "Assumptions": manifest.get("assumptions"), "Frames": of(diagnostics, "frames"), "Reconstruction": of(diagnostics, "cameras"), "Measures": of(diagnostics, "points"), "Visual check": of(diagnostics, "visual_check"),
        "Limits": of(diagnostics, "interpretation_limits"), "Reproduction": {k: manifest.get(k) for k in ("code_id", "seed", "params")},
    }
    text = full_report(manifest["run_id"], documents)
    if args.out:
        run_folders.write_text(spark, args.out, text, overwrite=True)
    print(text)
    return 0


def _visual_check(spark, args):
    """Shows the checks of a run, or records one."""
    manifest, path = run_folders.find_run(spark, args.run), f"{args.run}/{run_folders.DIAGNOSTICS}"
    document = run_folders.read_json(spark, path)
    run_folders.require_same_run(manifest["run_id"], **{"the diagnostics": document})
    stored = document.setdefault("visual_check", {})
    if args.item:
        if args.item not in rs.ITEMS or args.result not in rs.OUTCOMES:
            raise InputUnusable(f"no such item or result: {args.item}, {args.result}")
        stored[args.item] = {"result": args.result, "note": args.note, "checked_at": None if args.result == "not_checked" else experiments.now_utc()}
        run_folders.write_json(spark, path, document, overwrite=True)
    for item in [*rs.ITEMS, *(k for k in stored if k not in rs.ITEMS)]:
        print(item, stored.get(item, {}).get("result", "not_checked"))
    return 0


def _media(spark, args):
    """Pixel tables of the named views of a run's cloud, the turntable, and their index."""
    manifest = run_folders.find_run(spark, args.run)
    points = ply.read_ply(spark, f"{args.run}/normalized")
    extent = cam.pinned(cl.robust_extent(points))
    cameras = scenes.view_cameras(extent, args.size)
    if args.turntable:
        cameras = cameras.unionByName(scenes.view_cameras(extent, args.size, args.turntable))
    poses = run_folders.camera_poses(spark, run_folders.read_json(spark, f"{args.run}/{run_folders.CAMERAS}"))
    if not poses.isEmpty():
        cameras = cameras.unionByName(scenes.trajectory_camera(poses, extent, args.size))
    cameras = cam.pinned(cameras)
    scenes.render_points(points, cameras).write.partitionBy("view").parquet(f"{args.out}/pixels")
    scenes.media_index(cameras, manifest["run_id"]).coalesce(1).write.json(f"{args.out}/index")
    return 0


def _view(spark, args):
    """What a viewer would show: entities and the texts of its panels, as tables."""
    manifest, status = run_folders.find_run(spark, args.run), run_folders.read_json(spark, f"{args.run}/{run_folders.STATUS}")
    if not status.get("viewable"):
        from orbitspark.errors import ResultEmpty

        raise ResultEmpty(f"the status is {status.get('status')}")
    points = ply.read_ply(spark, f"{args.run}/normalized")
    diagnostics, n = _optional(spark, f"{args.run}/{run_folders.DIAGNOSTICS}"), points.count()
    run_folders.require_same_run(manifest["run_id"], **{"the status": status}, **({} if "missing" in diagnostics else {"the diagnostics": diagnostics}))
    measures = [{"metric": k, "availability": "available", "value": v, "reason": None} | (v if isinstance(v, dict) else {}) for k, v in (diagnostics.get("measures") or {}).items()]
    texts = panels(status | {"banner": status.get("banner") or status["status"]}, measures, cl.count_label(n, n))
    print(manifest["run_id"], texts["status"], texts["info"])
    if args.out:
        document = run_folders.read_json(spark, f"{args.run}/{run_folders.CAMERAS}")
        direction = (document.get("conventions") or {}).get("pose_direction", "world_to_camera")
        shown = scenes.entities(points, run_folders.camera_poses(spark, document), direction)
        shown.write.parquet(f"{args.out}/entities")
        run_folders.write_json(spark, f"{args.out}/panels.json", {"run_id": manifest["run_id"]} | texts)
    return 0


def _verify(spark, args):
    problems = checksums.verify(spark, args.folder, not args.lenient).orderBy("path").limit(11).collect()
    for r in problems[:10]:
        print(r["problem"], r["path"])
    return PackageBroken.exit_code if problems else 0


def _conditions(spark, args):
    """Fixes the conditions of an experiment, once."""
    print(experiments.init_conditions(spark, args.experiment, args.video, args.budget, args.seed, args.reconstructor, args.repeat_baseline)["digest"])
    return 0


def _compare(spark, args):
    """Verdicts of all experiments of a table of runs and one of conditions."""
    code = 0
    for r in experiments.compare_tables(spark.read.parquet(args.runs), spark.read.parquet(args.conditions)).orderBy("exp_id").toLocalIterator():
        code = max(code, r["exit_code"])
        print(r["exp_id"], *((r["relative_difference"], r["verdict"]) if not r["exit_code"] else ("refused:", r["reasons"])))
    return code


def _compare_runs(spark, args):
    """Verdict of one experiment from its folder and those of its runs."""
    done = experiments.compare_folders(spark, args.experiment, args.baseline, args.variant, args.repeat)
    print(done["exp_id"], done["relative_difference"], done["verdict"])
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="orbitspark")
    sub = parser.add_subparsers(required=True)
    for name, run, options in (
        ("check", _check, ("probe_json",)), ("prepare", _prepare, ("candidates", "package")), ("ingest", _ingest, ("model", "frames", "out", "run_id")), ("verify", _verify, ("folder",)), ("export", _export, ("run",)),
        ("report", _report, ("run",)), ("visual-check", _visual_check, ("run",)), ("media", _media, ("run", "out")), ("view", _view, ("run",)), ("compare", _compare, ("runs", "conditions")),
        ("conditions", _conditions, ("experiment", "video")), ("compare-runs", _compare_runs, ("experiment", "baseline", "variant")),
    ):
        p = sub.add_parser(name)
        for o in options:
            p.add_argument(o)
        for flag, of, settings in (
            ("--lenient", ("verify",), {"action": "store_true"}), ("--force", ("export",), {"action": "store_true"}), ("--out", ("export", "report", "view"), {}), ("--item", ("visual-check",), {}), ("--result", ("visual-check",), {}),
            ("--note", ("visual-check",), {}), ("--size", ("media",), {"type": int, "default": 640}), ("--turntable", ("media",), {"type": int, "default": 0}), ("--budget", ("prepare", "conditions"), {"type": int, "default": 48}), ("--seed", ("conditions",), {"type": int, "default": 42}),
            ("--reconstructor", ("conditions",), {"default": ""}), ("--repeat-baseline", ("conditions",), {"action": "store_true"}), ("--repeat", ("compare-runs",), {}),
            ("--selector", ("prepare",), {"default": "uniform"}), ("--min-frames", ("prepare",), {"type": int, "default": 12}),
        ):
            if name in of:
                p.add_argument(flag, **settings)
        p.set_defaults(handler=run)
    args = parser.parse_args(argv)
    try:
        return args.handler(SparkSession.builder.appName("orbitspark").getOrCreate(), args)
    except Refusal as e:
        print(e, file=sys.stderr)
        return e.exit_code
    except PySparkException as e:  # a refusal that a task raised: its name is in the message
        found = next((c for c in Refusal.__subclasses__() if f"{c.__module__}.{c.__name__}:" in str(e) or f"{c.__name__}:" in str(e)), None)
        if found is None:
            raise
        print(next((line for line in str(e).splitlines() if found.__name__ in line), found.__name__), file=sys.stderr)
        return found.exit_code


if __name__ == "__main__":
    sys.exit(main())
