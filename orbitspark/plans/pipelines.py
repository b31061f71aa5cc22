"""The long chains as Spark jobs: candidates to selected frames, model to aligned cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitspark.errors import MissingOrForeign, NotEnoughFrames, ResultEmpty
from orbitspark.functions import measures as ms
from orbitspark.operators import cameras as cam
from orbitspark.operators import cloud as cl
from orbitspark.operators import frames as fr
from orbitspark.operators import runs as rn


def prepare(candidates: DataFrame, gray: DataFrame | None = None, budget: int = 48, selector: str = "uniform", tau: float = 0.0123, min_frames: int = 12) -> DataFrame:
    """Fate of every candidate of every run: frame_id, sharpness, selected, reject_reason.

    candidates: run_id, src_index, timestamp_us and, without ``gray``, sharpness. gray: run_id, src_index,
    px, h, w. NotEnoughFrames if a run has fewer selected frames than ``min_frames``.
    """
    if gray is not None:
        sharp = gray.select("run_id", "src_index", fr.laplacian_variance(F.col("px"), F.col("h"), F.col("w")).alias("sharpness"))
        candidates = candidates.drop("sharpness").join(sharp, ["run_id", "src_index"], "left")
    if selector == "uniform":
        out = fr.select_uniform(candidates, "run_id", budget)
    elif selector == "quality":
        out = fr.select_quality(candidates, "run_id", budget, tau, span=1.0).drop("window", "rank", "pick_rank", "fallback")
    else:
        raise ValueError(f"no such selector: {selector}")
    few = out.groupBy("run_id").agg(F.count_if("selected").alias("n"), F.count("*").alias("considered")).where(F.col("n") < min_frames).limit(1).collect()
    if few:
        raise NotEnoughFrames(f"run {few[0]['run_id']}: {few[0]['considered']} considered, {few[0]['n']} selected, {min_frames} needed")
    return out


def ingest(cameras: DataFrame, points: DataFrame, selected: DataFrame, k: float = 3.0) -> dict[str, DataFrame]:
    """One run's model in the aligned world: cameras, points, alignment, diagnostics (one row).

    cameras: frame_id, r00..r22, t0..t2; selected: frame_id. MissingOrForeign if a camera's frame was not
    selected; ResultEmpty without cameras or points. Points stay distributed; only one-row results
    (alignment, bounds) go back to them.
    """
    foreign = [r[0] for r in rn.foreign_names(cameras.select("frame_id"), selected.select("frame_id"), "frame_id").orderBy("frame_id").limit(6).collect()]
    if foreign:
        raise MissingOrForeign("frames that were not selected: " + ", ".join(foreign[:5]) + (" and more" if len(foreign) > 5 else ""))
    if cameras.isEmpty() or points.isEmpty():
        raise ResultEmpty("the model has no cameras or no points")
    alignment = cam.pinned(cam.estimate_alignment(cameras, points, first="frame_id"))
    moved = cam.transform_points(points, alignment)
    kept = cl.filter_outliers(moved, k)
    poses = cam.transform_poses(cameras, alignment)
    counts = cameras.agg(F.count("*").alias("cameras_registered")).crossJoin(selected.agg(F.count("*").alias("frames_selected")))
    error = kept.agg(F.avg("error").alias("e")) if "error" in kept.columns else alignment.select(F.lit(None).cast("double").alias("e"))
    row = counts.crossJoin(cl.bounding_box(kept).withColumnRenamed("n_points", "num_points_valid")).crossJoin(error)
    row = row.withColumn("status", rn.status(F.col("cameras_registered"), F.col("num_points_valid"), F.col("frames_selected"), F.lit(True)))
    ratio = ms.measure(F.try_divide(F.col("cameras_registered").cast("double"), F.col("frames_selected").cast("double")), "no frames were selected")
    row = row.withColumn("registration_ratio", ratio).withColumn("mean_reprojection_error", ms.measure(F.col("e"), "no point has an error", "px")).drop("e")
    row = row.withColumn("saturated", F.col("num_points_valid") >= rn.POINT_CAP)
    return {"cameras": poses, "points": kept, "alignment": alignment, "diagnostics": row}
