"""Run records: integrity, statuses, diagnostics, comparison, identity. Decisions are ordered tables of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.functions import measures as ms
from orbitspark.functions.measures import finite

#: Status texts and the mark of a stored example.
BANNERS = {
    "prepared": "data prepared, reconstruction not run", "running": "reconstruction in progress", "success": "result obtained", "partial": "partial result",
    "failed": "reconstruction ended with an error", "interrupted": "result incomplete", "invalid_result": "reconstruction failed",
}
EXAMPLE = "precomputed example"
#: The closed set of warning codes, and the thresholds at which they fire.
WARNINGS = ("many_blurry_frames", "low_viewpoint_diversity", "short_video", "few_registered_cameras", "precomputed_example", "background_dominates", "reprojection_error_unavailable", "orientation_not_estimated")
BLURRY_SHARE, LOW_DIVERSITY, SHORT_SECONDS, FEW_REGISTERED = 0.3, 0.02, 5.0, 0.6
#: Fixed values of the verdict.
IMPROVEMENT, REGRESSION, POINT_CAP = 1.10, 0.90, 100_000


def status(cameras: Column, points: Column, frames: Column, complete: Column) -> Column:
    """The state of a result; contradictory counts are an error, never a kind of success."""
    bad = (cameras < 0) | (points < 0) | (frames < 0) | (cameras > frames)
    return (
        F.when(bad, F.raise_error(F.lit("contradictory counts")).cast("string")).when(~complete, "interrupted").when((cameras == 0) | (points == 0) | (frames == 0), "invalid_result")
        .when(cameras == frames, "success").otherwise("partial")
    )


def viewable(state: Column) -> Column:
    return state.isin("success", "partial")


def banner(state: Column, example: Column) -> Column:
    text = F.create_map(*(F.lit(x) for kv in BANNERS.items() for x in kv))
    return F.concat_ws(" · ", F.element_at(text, state), F.when(example, F.lit(EXAMPLE)))


def warning_codes(blurry: Column, diversity: Column, seconds: Column, registered: Column) -> Column:
    """Codes of what was observed; a measure that is missing raises none."""
    rules = (
        ("many_blurry_frames", blurry >= BLURRY_SHARE), ("low_viewpoint_diversity", diversity <= LOW_DIVERSITY), ("short_video", seconds < SHORT_SECONDS), ("few_registered_cameras", registered <= FEW_REGISTERED),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in rules)))


def foreign_names(names: DataFrame, known: DataFrame, key: str, run: str | None = None) -> DataFrame:
    """Names of a result that the selection does not hold; the reverse is legal."""
    return names.join(known, [key] if run is None else [run, key], "left_anti")


def compare_manifests(recorded: DataFrame, found: DataFrame, strict: bool = True) -> DataFrame:
    """Files that changed, are missing, or (when strict) are extra, by path and checksum."""
    both = recorded.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    kind = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "changed")
    out = both.select("path", kind.alias("problem")).where("problem is not null")
    return out if strict else out.where("problem <> 'extra'")


def other_run(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose run id is missing or differs from the manifest's; both are told apart."""
    both = documents.join(manifest.select("owner", F.col("run_id").alias("want")), "owner")
    return both.where(~F.col("run_id").eqNullSafe(F.col("want"))).withColumn("problem", F.when(F.col("run_id").isNull(), "missing").otherwise("different"))


def check_files(listing: DataFrame, required: DataFrame) -> DataFrame:
    """Exit code of each required file: 7 missing, 5 empty, 0 present."""
    met = required.join(listing, ["run", "name"], "left")
    return met.withColumn("exit_code", F.when(F.col("length").isNull(), 7).when(F.col("length") == 0, 5).otherwise(0))


def verdict(base: Column, variant: Column, repeat: Column, base_ratio: Column, variant_ratio: Column, base_defects: Column, variant_defects: Column, up: float = IMPROVEMENT, down: float = REGRESSION) -> Column:
    """Improvement, regression, no_difference or inconclusive; what is missing is neither worse nor not worse."""
    rel, again = F.abs(F.try_divide(variant - base, base)), F.abs(F.try_divide(repeat - base, base))
    yes = lambda c: F.coalesce(c, F.lit(False))
    not_worse = yes(variant_ratio >= base_ratio) & yes(variant_defects <= base_defects)
    worse = yes(variant_ratio < base_ratio) | yes(variant_defects > base_defects)
    return (
        F.when(yes(again >= rel), "inconclusive").when(base.isNull() | variant.isNull(), "inconclusive").when((variant >= base * up) & not_worse, "improvement")
        .when((variant <= base * down) | worse, "regression").otherwise("no_difference")
    )


def condition_violations(runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """Runs of an experiment whose video, budget, seed or code differ from the conditions (exit code 9)."""
    met = runs.alias("r").join(conditions.alias("c"), "exp_id")
    tests = [F.when(~F.col(f"r.{f}").eqNullSafe(F.col(f"c.{f}")), F.lit(f)) for f in ("video_sha256", "frame_budget", "seed", "code_id")]
    out = met.select("exp_id", "run_id", F.array_compact(F.array(*tests)).alias("differs")).where("size(differs) > 0")
    return out.withColumn("exit_code", F.lit(9))


def inputs_digest(video: Column, params: Column, code: Column, seed: Column) -> Column:
    return F.sha2(F.concat(video, params, code, seed.cast("string")), 256)


def run_id(created: Column, digest: Column) -> Column:
    """UTC stamp and the head of the inputs' digest."""
    return F.concat_ws("-", F.date_format(created, "yyyyMMdd-HHmmss"), F.substring(digest, 1, 8))


def latest_checks(log: DataFrame, items: DataFrame, run: str) -> DataFrame:
    """The last result of each item of each run, from an event log; not_checked where there is none."""
    last = log.groupBy(run, "item").agg(F.max_by(F.struct("result", "at"), F.struct("at", "seq")).alias("l"))
    return items.join(last, [run, "item"], "left").select(run, "item", F.coalesce("l.result", F.lit("not_checked")).alias("result"), F.col("l.at").alias("checked_at"))


def selection_time(commands: Column) -> Column:
    """Total seconds of the first command that has a ``select`` stage; null without one."""
    first = F.get(F.filter(commands, lambda c: F.map_contains_key(c, "select")), F.lit(0))
    return F.when(first.isNotNull(), F.aggregate(F.map_values(first), F.lit(0.0), lambda a, x: a + x))


def contradiction(cameras: Column, points: Column, frames: Column) -> Column:
    """What is impossible about the counts of a run; null for counts that can be."""
    return F.when((cameras < 0) | (points < 0) | (frames < 0), "a negative count").when(cameras > frames, F.concat(cameras.cast("string"), F.lit(" cameras of "), frames.cast("string"), F.lit(" selected frames")))


def diagnostics(frames: DataFrame, cameras: DataFrame, points: DataFrame, run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """One row a run with all that is known of it, and a rejects table (run, reason, exit_code) of runs whose counts contradict each other.

    frames: run, selected, reject_reason; cameras: run; points: run, x, y, z, and r and error, which may be null. Every run of any of the three has a
    row or a reject; a contradictory one stops no other. What can't be known is unavailable with its reason, never 0. The three
    tables meet in one grouping by run, to which frames come counted by reason, so a run's rows are summed before they are dealt.
    """
    ok = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    has = set(points.columns)
    reasons = frames.select(run, F.coalesce("selected", F.lit(False)).alias("selected"), "reject_reason").groupBy(run, "selected", "reject_reason").agg(F.count("*").alias("n_frames"))
    parts = reasons.unionByName(cameras.select(run, F.lit(1).alias("camera")), True).unionByName(
        points.select(run, F.lit(1).alias("point"), *"xyz", *((F.col(c) if c in has else F.lit(None)).cast("double").alias(c) for c in ("r", "error"))), True
    )
    chosen, told = F.coalesce("selected", F.lit(False)), F.length(F.coalesce("reject_reason", F.lit(""))) > 0
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n_frames"))), F.lit(0)).cast("long")
    rows = parts.groupBy(run).agg(
        total(F.col("n_frames").isNotNull()).alias("frames_considered"), total(chosen).alias("frames_selected"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~chosen & told, F.struct(F.col("reject_reason"), F.col("n_frames")))))).alias("reject_reasons"),
        F.count("camera").alias("cameras_registered"), F.count("point").alias("num_points"), F.count_if(F.col("point").isNotNull() & ok).alias("num_points_valid"), F.count("r").alias("_coloured"),
        *(f(F.when(ok, F.col(c))).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"), F.avg(F.when(finite(F.col("error")) & (F.col("error") >= 0), F.col("error"))).alias("_error"),
    )
    impossible = contradiction(F.col("cameras_registered"), F.col("num_points_valid"), F.col("frames_selected"))
    rejects = rows.select(run, impossible.alias("reason"), F.lit(7).alias("exit_code")).where("reason is not null")
    good = rows.where(impossible.isNull())
    ratio = ms.measure(F.try_divide(F.col("cameras_registered").cast("double"), F.col("frames_selected").cast("double")), "no frames were selected")
    box = F.struct(*(F.col(f"{n}_{c}") for n in ("min", "max") for c in "xyz"))
    return good.select(
        run, "frames_considered", "frames_selected", "reject_reasons", "cameras_registered", ratio.alias("registration_ratio"), "num_points", "num_points_valid", (F.col("num_points_valid") >= POINT_CAP).alias("saturated"),
        F.when(F.col("num_points_valid") > 0, box).alias("bounding_box"), F.when(F.col("num_points_valid") == 0, "no finite points").alias("bounding_box_reason"), ms.measure(F.col("_error"), "no point has an error", "px").alias("mean_reprojection_error"),
        ((F.col("_coloured") == F.col("num_points")) & (F.col("num_points") > 0)).alias("has_colours"), status(F.col("cameras_registered"), F.col("num_points_valid"), F.col("frames_selected"), F.lit(True)).alias("status"),
    ), rejects
