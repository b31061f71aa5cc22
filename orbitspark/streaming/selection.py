"""Streams of candidate frames: files that arrive, and statistics by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """Candidates as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_sharpness(stream: DataFrame, ts: str = "ts", run: str = "run_id", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Frames and sharpness of each run by windows of event time; late frames count within the watermark."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", width), run).agg(F.count("*").alias("n_frames"), F.avg("sharpness").alias("mean_sharpness"), F.max("sharpness").alias("best_sharpness"))
    return out.select(run, F.col("window.start").alias("window_start"), "n_frames", "mean_sharpness", "best_sharpness")


def best_per_slot(stream: DataFrame, slot_us: int, run: str = "run_id") -> DataFrame:
    """The sharpest frame so far of each time slot of each run: the streaming form of one frame a window.

    Slots are fixed in time, as the number of frames to come is not known; the state is one row a slot.
    """
    slot = F.floor(F.col("timestamp_us") / slot_us).alias("slot")
    best = stream.groupBy(run, slot).agg(F.max(F.struct("sharpness", (-F.col("src_index")).alias("o"))).alias("b"))
    return best.select(run, "slot", F.col("b.sharpness").alias("sharpness"), (-F.col("b.o")).alias("src_index"))
