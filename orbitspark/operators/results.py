"""What a run's result says: status rows, warnings with messages, visual checks, metrics, experiments and their conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.functions import measures as ms
from orbitspark.operators import runs as rn

#: The closed lists of visual checks, branches of an experiment, and metrics compared.
ITEMS = ("duplicated_geometry", "camera_trajectory_break", "point_soup_no_shape", "holes_on_low_texture", "background_dominates", "color_inconsistency")
OUTCOMES = ("ok", "defect", "not_checked")
BRANCHES = ("uniform", "quality_nonredundant")
METRICS = ("cameras_registered", "registration_ratio", "num_points_valid", "alignment_arc_coverage_deg", "alignment_planarity", "selection_time_s", "selection_time_share", "visual_check_defects")
#: Parameters whose defaults no measurement backs, and phrases that would name a cause.
PRELIMINARY = ("min_frames", "align_max_planarity", "align_min_arc_deg", "align_min_sign_agreement", "align_min_cameras")
CAUSES = ("because", "since", "due to", "owing to", "caused by", "the cause", "to blame", "the camera moved", "the object moved", "you moved", "you shot", "shot too", "too fast", "should have")
WARNING = "struct<code:string,message:string,observation_only:boolean>"


def warning(code: str, *parts: Column | str) -> Column:
    """One observation; the code must be of the closed list."""
    if code not in rn.WARNINGS:
        raise ValueError(f"no such warning: {code}")
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.struct(F.lit(code).alias("code"), text.alias("message"), F.lit(True).alias("observation_only"))


def percent(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def observed_warnings(rejected: Column, candidates: Column, diversity: Column, seconds: Column, registered: Column, selected: Column) -> Column:
    """Array of the warnings that the numbers of a run give; a number that is missing gives none.

    A share of none is 0 for registered cameras, as there is nothing to register; a run without candidates has no blurry ones.
    """
    blurry = F.try_divide(rejected.cast("double"), candidates.cast("double"))
    share = F.when(selected > 0, registered.cast("double") / selected).when(selected == 0, 0.0)
    rules = (
        (blurry >= rn.BLURRY_SHARE, warning("many_blurry_frames", "blurry frames: ", rejected.cast("string"), " of ", candidates.cast("string"), " left out for sharpness (", percent(blurry), ")")),
        (diversity <= rn.LOW_DIVERSITY, warning("low_viewpoint_diversity", "selected neighbours are alike: median difference ", F.format_string("%.4f", diversity))),
        (seconds < rn.SHORT_SECONDS, warning("short_video", "short video: ", F.format_string("%.1f", seconds), " s")),
        (share <= rn.FEW_REGISTERED, few_registered(registered, selected)),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), w) for test, w in rules)))


def few_registered(registered: Column, selected: Column) -> Column:
    share = F.coalesce(F.try_divide(registered.cast("double"), selected.cast("double")), F.lit(0.0))
    return warning("few_registered_cameras", "cameras with a known place: ", registered.cast("string"), " of ", selected.cast("string"), " (", percent(share), ")")


def stated_warnings(run: Column, background: Column, no_error: Column, no_vertical: Column) -> Column:
    """Warnings without a threshold: a stored example is shown, background dominates, and the reasons why an error or a vertical is missing."""
    rules = (
        (run.isNotNull(), warning("precomputed_example", "a stored example is shown, run ", run)),
        (F.coalesce(background, F.lit(False)), warning("background_dominates", "most points belong to the background")),
        (no_error.isNotNull(), warning("reprojection_error_unavailable", "no reprojection error: ", no_error)),
        (no_vertical.isNotNull(), warning("orientation_not_estimated", "the vertical is not estimated: ", no_vertical)),
    )
    return F.array_compact(F.array(*(F.when(test, w) for test, w in rules)))


def merge_warnings(first: Column, second: Column) -> Column:
    """Both lists in order; of one code the first warning stays."""
    start = F.array().cast(f"array<{WARNING}>")
    return F.aggregate(F.concat(first, second), start, lambda a, w: F.when(F.exists(a, lambda x: x["code"] == w["code"]), a).otherwise(F.array_append(a, w)))


def foreign_codes(warnings: Column) -> Column:
    """Codes that the closed list does not hold."""
    return F.array_except(F.transform(warnings, lambda w: w["code"]), F.array(*map(F.lit, rn.WARNINGS)))


def names_a_cause(text: Column) -> Column:
    """Whether a message goes beyond what was observed."""
    return text.rlike(r"(?i)\b(?:" + "|".join(CAUSES) + r")\b")


def merge_maps(left: Column, right: Column) -> Column:
    """The entries of both maps; of a key in both, the right one's."""
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def build_status(state: Column, warnings: Column, registered: Column, selected: Column, example: Column, note: Column) -> dict[str, Column]:
    """Columns of a status row. Only a success or a partial result can be viewed and exported; a partial one says that cameras are missing.

    Refused with an error: a partial result without that warning whose numbers are not known.
    """
    has = F.exists(warnings, lambda w: w["code"] == "few_registered_cameras")
    silent = (state == "partial") & ~has
    unknown = silent & (registered.isNull() | selected.isNull())
    full = F.when(unknown, F.raise_error(F.lit("a partial result without the numbers of its cameras")).cast(f"array<{WARNING}>")).when(silent, F.array_append(warnings, few_registered(registered, selected))).otherwise(warnings)
    return {"status": state, "viewable": rn.viewable(state), "exportable": rn.viewable(state), "precomputed_example": example, "warnings": full, "banner": rn.banner(state, example), "note": note}


def check_entries(log: DataFrame) -> DataFrame:
    """Entries of a visual-check log with ``exit_code``: 2 for an item or a result outside the closed lists, else 0."""
    known = F.col("item").isin(*ITEMS) & F.col("result").isin(*OUTCOMES)
    return log.withColumn("exit_code", F.when(F.coalesce(known, F.lit(False)), 0).otherwise(2))


def visual_checks(log: DataFrame, runs: DataFrame, items: tuple[str, ...] = ITEMS, run: str = "run_id") -> DataFrame:
    """The last entry of every item of every run: known items first, then stored ones that are not known.

    log: run, item, result, note, at, seq. What was never checked has neither time nor note.
    """
    last = log.groupBy(run, "item").agg(F.max_by(F.struct("result", "note", "at"), F.struct("at", "seq")).alias("l"))
    known = runs.select(run).distinct().select(run, F.posexplode(F.array(*map(F.lit, items))).alias("place", "item"))
    both = known.join(last, [run, "item"], "full_outer")
    result = F.coalesce("l.result", F.lit("not_checked"))
    return both.select(run, "item", F.coalesce("place", F.lit(len(items))).alias("place"), result.alias("result"), F.col("l.note").alias("note"), F.when(result != "not_checked", F.col("l.at")).alias("checked_at"))


def defects(checks: DataFrame, run: str = "run_id") -> DataFrame:
    return checks.groupBy(run).agg(F.count_if(F.col("result") == "defect").alias("visual_check_defects"))


def has_colours(points: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run whether all of its points have a colour, and there are any."""
    return points.groupBy(run).agg(((F.count("r") == F.count("*")) & (F.count("*") > 0)).alias("has_colours"))


def declared_metrics(rows: DataFrame, keys: tuple[str, ...] = ("exp_id", "run_id", "branch")) -> DataFrame:
    """One row a run and declared metric: value, availability, reason, units. ``rows`` has a column for each but the share of the selection time.

    ``total_time_s`` is that of the command that selected.
    """
    share = F.try_divide(F.col("selection_time_s"), F.nullif(F.col("total_time_s"), F.lit(0.0)))
    values = {m: share if m == "selection_time_share" else F.col(m).cast("double") for m in METRICS}
    units = {"alignment_arc_coverage_deg": "deg", "selection_time_s": "s"}
    long = rows.select(*keys, *(v.alias(m) for m, v in values.items())).unpivot(list(keys), list(METRICS), "metric", "value")
    unit = F.element_at(F.create_map(*(F.lit(x) for kv in units.items() for x in kv)), F.col("metric"))
    m = ms.measure(F.col("value"), F.concat(F.lit("not recorded: "), F.col("metric")))
    return long.withColumn("m", m).select(*keys, "metric", "m.value", "m.availability", "m.reason", F.when(F.col("m.value").isNotNull(), unit).alias("units"))


def refused_experiments(runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """What forbids a comparison, one row a reason: exp_id, run_id (null if a run is missing), reason, exit_code 9.

    runs: exp_id, run_id, role (baseline, variant, repeat), selector, normalized, and the columns of the conditions. A role
    needs its branch, a normalized result and equal conditions; baseline and variant must be there, the repeat if the conditions ask for it.
    """
    met = runs.alias("r").join(conditions.alias("c"), "exp_id")
    branch = F.when(F.col("r.role") == "variant", BRANCHES[1]).otherwise(BRANCHES[0])
    tests = [
        F.when(~F.col("r.selector").eqNullSafe(branch), F.concat(F.lit("not the branch "), branch)), F.when(~F.coalesce(F.col("r.normalized"), F.lit(False)), F.lit("no normalized result")),
        *(F.when(~F.col(f"r.{f}").eqNullSafe(F.col(f"c.{f}")), F.lit(f"differs in {f}")) for f in ("video_sha256", "frame_budget", "seed", "code_id")),
    ]
    bad = met.select("exp_id", "run_id", F.explode(F.array_compact(F.array(*tests))).alias("reason"))
    roles = runs.groupBy("exp_id").agg(F.collect_set("role").alias("roles"))
    there = conditions.select("exp_id", "repeat_baseline").join(roles, "exp_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    asked = F.when(F.col("repeat_baseline"), F.array(*map(F.lit, ("baseline", "variant", "repeat")))).otherwise(F.array(F.lit("baseline"), F.lit("variant")))
    lack = there.select("exp_id", F.lit(None).cast(runs.schema["run_id"].dataType).alias("run_id"), F.explode(F.array_except(asked, "roles")).alias("role"))
    lack = lack.select("exp_id", "run_id", F.concat(F.lit("no "), F.col("role"), F.lit(" run")).alias("reason"))
    return bad.unionByName(lack).withColumn("exit_code", F.lit(9))


def compare_runs(runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every experiment of the conditions: verdict and relative differences, or exit_code 9 and the reasons why it has none."""
    refused = refused_experiments(runs, conditions).groupBy("exp_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    metrics = ("num_points_valid", "registration_ratio", "visual_check_defects")
    wide = runs.groupBy("exp_id").agg(*(F.max(F.when(F.col("role") == r, F.col(m).cast("double"))).alias(f"{r}_{m}") for r in ("baseline", "variant", "repeat") for m in metrics))
    met = conditions.select("exp_id", "improvement_ratio", "regression_ratio").join(wide, "exp_id", "left").join(refused, "exp_id", "left")
    of = lambda r, m: F.col(f"{r}_{m}")
    call = rn.verdict(of("baseline", metrics[0]), of("variant", metrics[0]), of("repeat", metrics[0]), of("baseline", metrics[1]), of("variant", metrics[1]), of("baseline", metrics[2]), of("variant", metrics[2]), F.col("improvement_ratio"), F.col("regression_ratio"))
    good = F.col("reasons").isNull()
    return met.select(
        "exp_id", F.when(good, call).alias("verdict"), F.when(good, ms.relative_difference(of("variant", metrics[0]), of("baseline", metrics[0]))).alias("relative_difference"),
        F.when(good, ms.relative_difference(of("repeat", metrics[0]), of("baseline", metrics[0]))).alias("repeat_difference"), F.when(good, 0).otherwise(9).alias("exit_code"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )


def preliminary_notes(parameters: DataFrame) -> DataFrame:
    """Adds ``note`` to rows with a parameter's ``name``: null where a measurement backs its value."""
    return parameters.withColumn("note", F.when(F.col("name").isin(*PRELIMINARY), F.concat(F.lit("the value of '"), F.col("name"), F.lit("' is preliminary: no measurement backs it"))))


def export_guard(state: Column, n_points: Column, there: Column, force: Column, target: Column) -> dict[str, Column]:
    """Exit code of an export and where it goes: 6 for an empty cloud always, and for an unusable state unless forced; 8 for a file that is there unless forced.

    A forced export of an unusable state goes to a name that says so.
    """
    usable = rn.viewable(state)
    path = F.when(usable, target).otherwise(F.concat(F.regexp_replace(target, r"\.[^./]*$", ""), F.lit(".UNUSABLE.ply")))
    code = F.when(~usable & ~force, 6).when(n_points == 0, 6).when(there & ~force, 8).otherwise(0)
    return {"exit_code": code, "target": path}
