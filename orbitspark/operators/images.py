"""Gray images of any size brought to one: separable resampling with weights by a table of sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.operators.frames import frame_difference
from orbitspark.storage import hinted, written

#: Fixed value: the side to which frames are brought before they are compared.
SIDE = 64


def resampling(sizes: DataFrame, side: int) -> DataFrame:
    """Per source size (column ``n``) its ``side`` targets in order: first source pixel and the weights from there on.

    A triangle filter, as wide as a target pixel when it shrinks; weights sum to one.
    """
    scale = F.col("n") / F.lit(float(side))
    reach = F.greatest(scale, F.lit(1.0))
    rows = sizes.select("n", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("t")).withColumn("centre", (F.col("t") + 0.5) * scale).withColumn("reach", reach)
    rows = rows.withColumn("first", F.greatest(F.lit(0), F.floor(F.col("centre") - F.col("reach") + 0.5)).cast("int")).withColumn("end", F.least(F.col("n"), F.floor(F.col("centre") + F.col("reach") + 0.5)).cast("int"))
    raw = F.transform(F.sequence(F.col("first"), F.col("end") - 1), lambda x: F.greatest(F.lit(0.0), 1 - F.abs((x - F.col("centre") + 0.5) / F.col("reach"))))
    rows = rows.withColumn("raw", raw).withColumn("total", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x))
    rows = rows.select("n", "t", "first", F.transform("raw", lambda x: x / F.col("total")).alias("weights"))
    return rows.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("t", "first", "weights"))).alias("targets"))


def weighted(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def resized(frames: DataFrame, side: int = SIDE, px: str = "px", height: str = "h", width: str = "w") -> DataFrame:
    """Frames with ``small``, their pixels at ``side`` by ``side``; null for an empty image or one whose pixels don't fill it.

    The tables of weights have a row a distinct size; they are broadcast if they are small, whatever the number of frames.
    An image that has that size already is taken as it is.
    """
    sizes = frames.select(F.explode(F.array(F.col(height).cast("int"), F.col(width).cast("int"))).alias("n")).where("n > 0").distinct()
    table = written(resampling(sizes, side), "weights")
    rows, each = table.count(), 24 * side
    across = hinted(table.select(F.col("n").alias("_nw"), F.col("targets").alias("_tw")), rows, 4 * each)
    down = hinted(table.select(F.col("n").alias("_nh"), F.col("targets").alias("_th")), rows, 4 * each)
    met = frames.join(across, F.col(width).cast("int") == F.col("_nw"), "left").join(down, F.col(height).cast("int") == F.col("_nh"), "left")
    w, h = F.col(width).cast("int"), F.col(height).cast("int")
    pixels = F.transform(F.col(px), lambda x: x.cast("double"))
    met = met.withColumn("_px", F.when((w > 0) & (h > 0) & (F.size(px) == w * h), pixels))
    lines = F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.transform("_tw", lambda t: weighted(F.slice("_px", y * w + t["first"] + 1, F.size(t["weights"])), t["weights"])))
    met = met.withColumn("_lines", F.when(F.col("_px").isNotNull(), lines))
    columns = F.sequence(F.lit(0), F.lit(side - 1))
    small = F.flatten(F.transform("_th", lambda t: F.transform(columns, lambda i: weighted(F.transform(F.slice("_lines", t["first"] + 1, F.size(t["weights"])), lambda line: F.get(line, i)), t["weights"]))))
    met = met.withColumn("small", F.when((w == side) & (h == side), F.col("_px")).when(F.col("_px").isNotNull(), small))
    return met.select(*frames.columns, "small")


def difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two images that were ``resized``."""
    return frame_difference(a, b)
