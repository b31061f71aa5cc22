"""Candidate frames: sampling, gray-frame metrics, selection. A run is partitioned by, never the whole table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType


def numbered(df: DataFrame, run: str, *order: str) -> DataFrame:
    """``src_index`` from 0 within each run."""
    return df.withColumn("src_index", F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1)


def with_offsets(df: DataFrame, run: str, ts: str) -> DataFrame:
    """``timestamp_us`` from the first frame of the run; no time is made up for a missing one."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("timestamp_us", micros - F.min(micros).over(Window.partitionBy(run)))


def stride_sample(df: DataFrame, run: str, most: int) -> DataFrame:
    """Every stride-th frame of a run, with the smallest stride that keeps ``most`` at most."""
    n = F.count("*").over(Window.partitionBy(run))
    return df.withColumn("stride", F.greatest(F.lit(1), F.ceil(n / F.lit(most))).cast("int")).where("src_index % stride = 0")


def laplacian_variance(px: Column, height: Column, width: Column) -> Column:
    """Population variance of the 4-neighbour Laplacian inside the border, in one pass that doesn't cancel; 0 below 3 x 3, null for a missing pixel."""
    rows, cols = F.sequence(F.lit(1), height - 2), F.sequence(F.lit(1), width - 2)
    at = lambda i: F.get(px, i).cast("double")
    inner = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: at((r - 1) * width + c) + at((r + 1) * width + c) + at(r * width + c - 1) + at(r * width + c + 1) - 4 * at(r * width + c))))

    def add(a: Column, x: Column) -> Column:
        """Count, mean and sum of squared distances from the mean, with one more value."""
        n, gap = a["n"] + 1, x - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + gap / n).alias("mean"), (a["m2"] + gap * (x - a["mean"] - gap / n)).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.when((height < 3) | (width < 3), F.lit(0.0)).otherwise(F.aggregate(inner, start, add, lambda a: a["m2"] / a["n"]))


def frame_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two frames of the same size; null if either is missing or empty."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.try_divide(total, F.size(a).cast("double")))


def select_uniform(df: DataFrame, run: str, budget: int) -> DataFrame:
    """Marks ``budget`` evenly spread frames of each run, both ends included; numbers and names them."""
    if budget <= 0:
        raise ValueError("the budget must be positive")
    w = Window.partitionBy(run)
    n, pos = F.count("*").over(w), F.row_number().over(w.orderBy("src_index")) - 1
    df = df.withColumn("_n", n).withColumn("_pos", pos)
    step = (F.col("_n") - 1) / F.lit(float(max(1, budget - 1)))
    picked = F.col("_pos") == 0 if budget == 1 else F.exists(F.sequence(F.lit(0), F.lit(budget - 1)), lambda i: F.rint(i * step) == F.col("_pos"))
    df = df.withColumn("selected", (F.col("_n") <= budget) | picked)
    order = F.sum(F.col("selected").cast("int")).over(w.orderBy("src_index"))
    name = F.when(F.col("selected"), F.format_string("%04d_%06d", order, F.col("src_index"))).otherwise(F.format_string("----_%06d", F.col("src_index")))
    return df.withColumn("frame_id", name).withColumn("reject_reason", F.when(~F.col("selected"), "budget_exhausted")).drop("_n", "_pos")


def window_of(pos: Column, n: Column, windows: int) -> Column:
    """The window, of ``windows`` or n equal ones, that holds a position; edges are rounded half to even."""
    w = F.least(F.lit(windows), n)
    edges = F.when(w > 1, F.sequence(F.lit(1), w.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(edges, lambda k: F.rint(k * (n / w)) <= pos))


def with_windows(df: DataFrame, run: str, windows: int) -> DataFrame:
    w = Window.partitionBy(run)
    df = df.withColumn("_n", F.count("*").over(w)).withColumn("_pos", F.row_number().over(w.orderBy("src_index")) - 1)
    return df.withColumn("window", window_of(F.col("_pos"), F.col("_n"), windows)).drop("_n", "_pos")


def select_quality(df: DataFrame, run: str, windows: int, tau: float, value: str = "sharpness", span: float = 500.0) -> DataFrame:
    """One frame a window: the sharpest that differs from the last pick by ``tau``, else the sharpest.

    Rows go by in order of run, window and rank, so that only the last pick and the first rank are held,
    whatever the length of a run. Differences are |value - value| / span.
    """
    df = with_windows(df, run, windows)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(run, "window").orderBy(F.desc("sharpness"), "src_index")))
    rows = ranked.select(run, "window", "rank", F.col(value).cast("double").alias("v")).repartition(F.col(run)).sortWithinPartitions(run, "window", "rank")
    schema = StructType([*rows.schema.fields[:2], StructField("pick_rank", IntegerType()), StructField("fallback", BooleanType())])

    def fold(batches):
        at, last, top, done = None, None, None, True
        for batch in batches:
            key, out = batch.schema.field(0).type, []
            for r, w, k, v in zip(*(c.to_pylist() for c in batch.columns)):
                if k == 1:
                    if not done:  # none of the window before was fresh
                        out.append((*at, 1, True))
                        last = top
                    if at is None or at[0] != r:
                        last = None
                    at, top, done = (r, w), v, False
                if not done and fresh(v, last):
                    out.append((*at, k, False))
                    last, done = v, True
            yield table(out, key)
        if not done:
            yield table([(*at, 1, True)], key)

    def fresh(v, last):
        if last is None:
            return True
        far = None if v is None else abs(v - last) / span
        return far is not None and not far < tau  # NaN is the greatest

    def table(out, key):
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (key, pa.int32(), pa.int32(), pa.bool_()))], names=schema.names)

    picks = rows.mapInArrow(fold, schema)
    out = ranked.join(picks, [run, "window"]).withColumn("selected", F.col("rank") == F.col("pick_rank"))
    tried = F.col("fallback") | (F.col("rank") < F.col("pick_rank"))
    return out.withColumn("reject_reason", F.when(F.col("selected"), None).when(tried, "redundant").otherwise("less_sharp_in_window"))


def selection_info(selected: DataFrame, run: str) -> DataFrame:
    """Windows, picks, fallbacks and compared frames of a quality selection."""
    per = selected.groupBy(run, "window").agg(F.max("pick_rank").alias("pick_rank"), F.max("fallback").alias("fallback"), F.count("*").alias("n"))
    compared = F.when(F.col("window") == 0, 0).when(F.col("fallback"), F.col("n")).otherwise(F.col("pick_rank"))
    return per.groupBy(run).agg(F.count("*").alias("windows"), F.sum(F.lit(1)).alias("selected"), F.sum(F.col("fallback").cast("int")).alias("fallbacks"), F.sum(compared).alias("diff_evaluations"))


def diff_to_previous(df: DataFrame, run: str, diff) -> DataFrame:
    """Difference of each selected frame to the selected one before it; null for the first."""
    w = Window.partitionBy(run).orderBy("src_index")
    return df.where("selected").withColumn("diff_to_prev_selected", diff(w))
