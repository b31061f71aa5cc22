"""Frames as a decoder reports them: their times, counts and rotation, with a rejects table instead of an error that ends the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Exit code of an input that can't be used.
UNUSABLE = 2


def frame_counts(frames: DataFrame, run: str = "run_id", best: str = "best_s", pts: str = "pts_s") -> DataFrame:
    """Per run: frames, frames without any time, and the earliest time in seconds."""
    t = F.coalesce(best, pts)
    return frames.groupBy(run).agg(F.count("*").alias("n_frames"), F.count_if(t.isNull()).alias("n_missing"), F.min(t).alias("origin"))


def refused_runs(counts: DataFrame, expected: DataFrame | None = None, run: str = "run_id") -> DataFrame:
    """Runs of ``frame_counts`` that can't be used: run, n_frames, n_missing, expected, reason, exit_code.

    A run is refused if a frame has no time, since none may be made up, or if its frames are not as many as ``expected`` (run, expected) says;
    a run that is expected and has no frame is refused as well.
    """
    if expected is None:
        met = counts.withColumn("expected", F.lit(None).cast("long"))
    else:
        met = counts.join(expected.select(run, F.col("expected").cast("long")), run, "full_outer").na.fill(0, ["n_frames", "n_missing"])
    number = lambda c: F.col(c).cast("string")
    reason = F.when(F.col("n_missing") > 0, F.concat(number("n_missing"), F.lit(" of "), number("n_frames"), F.lit(" frames have no time"))).when(
        F.col("n_frames") != F.col("expected"), F.concat(number("n_frames"), F.lit(" frames instead of "), number("expected"))
    )
    return met.select(run, "n_frames", "n_missing", "expected", reason.alias("reason"), F.lit(UNUSABLE).alias("exit_code")).where("reason is not null")


def frame_times(
    frames: DataFrame, expected: DataFrame | None = None, run: str = "run_id", order: str = "src_index", best: str = "best_s", pts: str = "pts_s", observation: Observation | None = None
) -> tuple[DataFrame, DataFrame]:
    """Frames of the runs that can be used, with ``timestamp_us`` from the first one on, and the rejects of the others.

    The best time of a frame counts, else its presentation time. Where times fall they are sorted: the k-th frame of a run has its
    k-th time. Microseconds are rounded half to even. ``observation`` gets the numbers of frames and of frames without a time in
    the pass that reads them. Frames are matched with times by (run, place), so the join is dealt over places and not over runs.
    """
    if observation is not None:
        frames = frames.observe(observation, F.count(F.lit(1)).alias("frames"), F.count_if(F.coalesce(best, pts).isNull()).alias("missing"))
    counts = frame_counts(frames, run, best, pts)
    rejects = refused_runs(counts, expected, run)
    good = counts.select(run, "origin").join(rejects.select(run), run, "left_anti")
    rows = frames.join(good, run)
    t = F.coalesce(best, pts)
    place = F.row_number().over(Window.partitionBy(run).orderBy(order))
    rank = F.row_number().over(Window.partitionBy(run).orderBy(t, order))
    left = rows.withColumn("_place", place)
    times = rows.select(F.col(run).alias("_run"), rank.alias("_rank"), F.rint((t - F.col("origin")) * 1_000_000).cast("long").alias("timestamp_us"))
    timed = left.join(times, (F.col(run) == F.col("_run")) & (F.col("_place") == F.col("_rank")))
    return timed.select(*frames.columns, "timestamp_us"), rejects


def verified_rotation(rotation: Column, width: Column, height: Column, decoded_width: Column, decoded_height: Column) -> dict[str, Column]:
    """The rotation of the metadata where the decoded size confirms it, else null with exit code 2.

    A size only tells whether the sides are swapped, which quarter turns do and other angles don't; nothing is guessed.
    """
    swapped = (decoded_width == height) & (decoded_height == width)
    same = (decoded_width == width) & (decoded_height == height)
    good = F.coalesce(F.when(rotation.isin(90, 270), swapped).otherwise(same), F.lit(False))
    text = F.concat_ws("", F.lit("stream "), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(" turned by "), rotation.cast("string"), F.lit(" was decoded as "), decoded_width.cast("string"), F.lit("x"), decoded_height.cast("string"))
    return {"rotation_deg": F.when(good, rotation), "exit_code": F.when(good, 0).otherwise(UNUSABLE), "reason": F.when(~good, text)}
