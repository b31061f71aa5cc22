"""The long chains on small made-up runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitspark import errors
from orbitspark.functions.text import report
from orbitspark.operators import cameras as cam
from orbitspark.plans import pipelines
from orbitspark.streaming import selection
from tests.test_operators import candidates, points, ring


def test_prepare(spark):
    rows = candidates(spark, np.random.default_rng(0).random(60)).withColumn("timestamp_us", F.col("src_index") * 1000)
    assert pipelines.prepare(rows, budget=20).where("selected").count() == 20
    assert pipelines.prepare(rows, budget=20, selector="quality", tau=0.0).where("selected").count() == 20
    with pytest.raises(errors.NotEnoughFrames):
        pipelines.prepare(rows, budget=5)


def test_ingest(spark):
    cams = ring(spark, tilt=52, offset=(0.7, -1.3, 2.1)).withColumn("frame_id", F.format_string("%04d", "k"))
    xyz = np.random.default_rng(5).normal(0, 0.2, (500, 3)) + [0.7, -1.3, 2.1]
    selected = cams.select("frame_id")
    out = pipelines.ingest(cams, points(spark, np.vstack([xyz, [[900, 0, 0]], [[np.nan, 0, 0]]])).withColumn("error", F.lit(None).cast("double")), selected)
    d = out["diagnostics"].first()
    assert d["status"] == "success" and d["num_points_valid"] == 500 and d["mean_reprojection_error"]["availability"] == "unavailable"
    assert abs(d["min_x"] + d["max_x"]) < 0.5 and "unavailable" in report(d.asDict(recursive=True), out["alignment"].first().asDict())
    with pytest.raises(errors.MissingOrForeign):
        pipelines.ingest(cams, points(spark, xyz), selected.limit(3))
    with pytest.raises(errors.ResultEmpty):
        pipelines.ingest(cams, points(spark, xyz).limit(0), selected)
    back = cam.transform_points(out["points"], cam.invert_transform(out["alignment"]))
    assert np.allclose(sorted(r["x"] for r in back.collect()), np.sort(xyz[:, 0]), atol=1e-6)


def test_streams(spark, tmp_path, sf_dir):
    frames = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), "ts", F.col("value").alias("sharpness"), F.col("event_id").alias("src_index"))
    frames = frames.withColumn("timestamp_us", F.unix_micros(F.col("ts").cast("timestamp")))
    frames.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = selection.arriving(spark, str(tmp_path / "in"), frames._jdf.schema().toDDL(), 2)
    for name, out, mode in (("slots", selection.best_per_slot(stream, 3_600_000_000), "complete"), ("hours", selection.windowed_sharpness(stream), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    want = selection.best_per_slot(frames, 3_600_000_000)
    assert spark.table("slots").exceptAll(want).isEmpty() and spark.table("slots").count() == want.count() > 0
    assert spark.table("hours").agg(F.sum("n_frames")).first()[0] == frames.count()


