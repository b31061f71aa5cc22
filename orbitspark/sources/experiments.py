"""Experiments as folders: conditions written once, runs compared under them, results beside them."""

from __future__ import annotations

from datetime import UTC, datetime
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitspark.errors import ConditionsDiffer, MissingOrForeign
from orbitspark.functions.text import comparison_text
from orbitspark.operators import results as rs
from orbitspark.operators import runs as rn
from orbitspark.sources import checksums, run_folders

#: The documents of an experiment, and the short name of a selector.
CONDITIONS, RESULTS, COMPARISON = "conditions.json", "results.json", "comparison.md"
LONG_NAMES = {"quality": "quality_nonredundant"}
ROLES = ("baseline", "variant", "repeat")
RUNS = "exp_id string, run_id string, role string, selector string, normalized boolean, video_sha256 string, frame_budget int, seed int, code_id string, " + ", ".join(f"{m} double" for m in rs.METRICS if m != "selection_time_share") + ", total_time_s double"


def now_utc() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def init_conditions(spark: SparkSession, folder: str, video: str, budget: int, seed: int, reconstructor: str, repeat: bool = False) -> dict:
    """Fixes an experiment before its runs; AlreadyThere if it was fixed before, also by someone else at the same time.

    ``digest`` is of the conditions themselves: a file that was edited later is noticed when it is read.
    """
    found = checksums.list_folder(spark, video).collect()
    if not found:
        raise MissingOrForeign(f"no such video: {video}")
    fixed = {
        "exp_id": folder.rstrip("/").rsplit("/", 1)[-1], "video": {"filename": video.rsplit("/", 1)[-1], "sha256": found[0]["sha256"]}, "frame_budget": budget, "seed": seed, "reconstructor": reconstructor,
        "branches": list(rs.BRANCHES), "repeat_baseline": repeat, "metrics_declared": list(rs.METRICS), "decision_rule": {"improvement_ratio": rn.IMPROVEMENT, "regression_ratio": rn.REGRESSION},
    }
    document = fixed | {"digest": sha256(run_folders.canonical(fixed).encode()).hexdigest(), "created_utc": now_utc()}
    run_folders.write_json(spark, f"{folder}/{CONDITIONS}", document)
    return document


def read_conditions(spark: SparkSession, folder: str) -> dict:
    """The conditions of an experiment; ConditionsDiffer if they were edited."""
    document = run_folders.read_json(spark, f"{folder}/{CONDITIONS}")
    fixed = {k: v for k, v in document.items() if k not in ("digest", "created_utc")}
    if document.get("digest") != sha256(run_folders.canonical(fixed).encode()).hexdigest():
        raise ConditionsDiffer(f"{folder}/{CONDITIONS} was changed after it was written")
    return document


def optional(spark: SparkSession, path: str) -> dict | None:
    try:
        return run_folders.read_json(spark, path)
    except MissingOrForeign:
        return None


def plain(value):
    """The number of a measure, or the number itself; null where it isn't available."""
    return value.get("value") if isinstance(value, dict) else value


def run_row(spark: SparkSession, folder: str, exp_id: str, role: str) -> tuple:
    """One run's row of the table of runs, from its documents; what they don't hold is null."""
    manifest = run_folders.find_run(spark, folder)
    diagnostics, status = (optional(spark, f"{folder}/{p}") for p in (run_folders.DIAGNOSTICS, run_folders.STATUS))
    params, found = (manifest.get("selection") or {}).get("params") or {}, diagnostics or {}
    measures = found.get("measures") or {}
    timed = next((c["durations_s"] for c in manifest.get("commands") or [] if "select" in (c.get("durations_s") or {})), None)
    own = {
        "visual_check_defects": sum(c.get("result") == "defect" for c in (found.get("visual_check") or {}).values()) if diagnostics else None,
        "selection_time_s": timed["select"] if timed else None,
    }
    number = lambda v: None if v is None else float(v)
    metrics = [number(own.get(m, plain(measures.get(m)))) for m in rs.METRICS if m != "selection_time_share"]
    code = manifest.get("code_id")
    selector = params.get("selector")
    return (
        exp_id, manifest["run_id"], role, LONG_NAMES.get(selector, selector), diagnostics is not None and status is not None, (manifest.get("input") or {}).get("sha256"), params.get("budget"), manifest.get("seed"),
        code.get("value") if isinstance(code, dict) else code, *metrics, number(sum(timed.values())) if timed else None,
    )


def conditions_row(spark: SparkSession, conditions: dict, code_id: str | None) -> DataFrame:
    rule = conditions["decision_rule"]
    row = (conditions["exp_id"], conditions["video"]["sha256"], conditions["frame_budget"], conditions["seed"], code_id, conditions["repeat_baseline"], rule["improvement_ratio"], rule["regression_ratio"])
    return spark.createDataFrame([row], "exp_id string, video_sha256 string, frame_budget int, seed int, code_id string, repeat_baseline boolean, improvement_ratio double, regression_ratio double")


def compare_folders(spark: SparkSession, folder: str, baseline: str, variant: str, repeat: str | None = None) -> dict:
    """Compares run folders under the conditions of an experiment and writes its results; ConditionsDiffer with all reasons if they may not be compared.

    The code of the baseline is the code of the experiment.
    """
    conditions = read_conditions(spark, folder)
    rows = [run_row(spark, run, conditions["exp_id"], role) for role, run in zip(ROLES, (baseline, variant, repeat)) if run]
    runs = spark.createDataFrame(rows, RUNS)
    done = rs.compare_runs(runs, conditions_row(spark, conditions, runs.first()["code_id"])).first().asDict()
    if done["exit_code"]:
        raise ConditionsDiffer("; ".join(done["reasons"]))
    metrics = [r.asDict() for r in rs.declared_metrics(runs, ("exp_id", "run_id", "role")).withColumnRenamed("role", "branch").orderBy("metric", "branch").collect()]
    saturated = [r["branch"] for r in metrics if r["metric"] == "num_points_valid" and (r["value"] or 0) >= rn.POINT_CAP]
    results = {
        "exp_id": done["exp_id"], "generated_utc": now_utc(), "runs": {r[2]: r[1] for r in rows}, "metrics": metrics, "relative_difference": done["relative_difference"], "repeat_difference": done["repeat_difference"],
        "decision_rule": conditions["decision_rule"], "verdict": done["verdict"], "saturated": saturated,
    }
    run_folders.write_json(spark, f"{folder}/{RESULTS}", results, overwrite=True)
    run_folders.write_text(spark, f"{folder}/{COMPARISON}", comparison_text(done, metrics), overwrite=True)
    return results


def compare_tables(runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """All experiments of two tables at once, refused ones with their reasons."""
    return rs.compare_runs(runs, conditions).select("exp_id", "relative_difference", "verdict", "exit_code", F.array_join("reasons", "; ").alias("reasons"))
