"""Times, counts and rotations of decoded frames with their rejects; resampling against numpy; voxel sizes by sketches."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from orbitspark.operators import cloud as cl
from orbitspark.operators import images, intake
from tests.test_operators import points

FRAMES = "run_id string, src_index int, best_s double, pts_s double"


def test_frame_times_and_rejects(spark):
    rows = [("a", 0, 1.0, 9.0), ("a", 1, None, 1.5), ("a", 2, 2.0000005, None), ("b", 0, 3.0, None), ("b", 1, None, None), ("c", 0, 5.0, None), ("c", 1, 4.0, None), ("c", 2, 4.5, None), ("d", 0, 0.0, None), ("e", 0, 7.0, None), ("e", 1, 7.0, None)]
    expected = spark.createDataFrame([("a", 3), ("b", 2), ("c", 3), ("d", 2), ("e", 2), ("gone", 4)], "run_id string, expected long")
    seen = Observation("decoded")
    timed, rejects = intake.frame_times(spark.createDataFrame(rows, FRAMES), expected, observation=seen)
    got = {(r["run_id"], r["src_index"]): r["timestamp_us"] for r in timed.collect()}
    assert got == {("a", 0): 0, ("a", 1): 500_000, ("a", 2): round((2.0000005 - 1.0) * 1_000_000), ("c", 0): 0, ("c", 1): 500_000, ("c", 2): 1_000_000, ("e", 0): 0, ("e", 1): 0}
    bad = {r["run_id"]: (r["reason"], r["exit_code"]) for r in rejects.collect()}
    assert bad == {"b": ("1 of 2 frames have no time", 2), "d": ("1 frames instead of 2", 2), "gone": ("0 frames instead of 4", 2)}
    assert seen.get["missing"] >= 1 and seen.get["frames"] >= len(rows)
    none, refused = intake.frame_times(spark.createDataFrame([], FRAMES))
    assert none.count() == 0 and refused.count() == 0


@pytest.mark.parametrize("rotation,decoded,good", [(0, (640, 480), True), (180, (640, 480), True), (90, (480, 640), True), (270, (480, 640), True), (90, (640, 480), False), (0, (480, 640), False), (180, (320, 240), False), (90, (None, 640), False)])
def test_rotation_is_confirmed_or_refused(spark, rotation, decoded, good):
    row = spark.createDataFrame([(rotation, 640, 480, *decoded)], "r int, w int, h int, dw int, dh int")
    out = row.select(*(c.alias(n) for n, c in intake.verified_rotation(*(F.col(c) for c in ("r", "w", "h", "dw", "dh"))).items())).first()
    assert (out["rotation_deg"], out["exit_code"]) == ((rotation, 0) if good else (None, 2)) and (out["reason"] is None) == good


def triangle(n, side):
    """Weights (side, n) of the filter, from its definition."""
    scale = n / side
    reach = max(scale, 1.0)
    out = np.zeros((side, n))
    for t in range(side):
        centre = (t + 0.5) * scale
        for x in range(max(0, int(centre - reach + 0.5)), min(n, int(centre + reach + 0.5))):
            out[t, x] = max(0.0, 1 - abs((x - centre + 0.5) / reach))
        out[t] /= out[t].sum()
    return out


def test_images_of_unlike_sizes(spark):
    rng = np.random.default_rng(7)
    sizes = [(5, 9), (8, 8), (30, 17), (1, 1), (3, 40)]
    data = [rng.random(s) for s in sizes]
    rows = [(i, a.ravel().tolist(), *a.shape) for i, a in enumerate(data)] + [(5, [], 0, 0), (6, [0.5] * 3, 2, 2), (7, None, 4, 4)]
    got = {r["i"]: r["small"] for r in images.resized(spark.createDataFrame(rows, "i int, px array<double>, h int, w int"), 8).collect()}
    want = [triangle(a.shape[0], 8) @ a @ triangle(a.shape[1], 8).T for a in data]
    for i, w in enumerate(want):
        assert np.allclose(np.reshape(got[i], (8, 8)), w, atol=1e-12)
    assert np.allclose(got[1], data[1].ravel()) and got[5] is None and got[6] is None and got[7] is None
    a, b = (F.array(*map(F.lit, got[i])) for i in (0, 2))
    assert spark.range(1).select(images.difference(a, b)).first()[0] == pytest.approx(np.abs(want[0] - want[2]).mean())


def test_sharpness_does_not_cancel(spark):
    from orbitspark.operators import frames as fr

    px = (1e6 + 1e-3 * np.random.default_rng(1).random((6, 6))).ravel()
    a = px.reshape(6, 6)
    lap = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
    df = spark.createDataFrame([(px.tolist(),)], "px array<double>")
    assert df.select(fr.laplacian_variance(F.col("px"), F.lit(6), F.lit(6))).first()[0] == pytest.approx(lap.var(), rel=1e-6)


def test_voxel_size_equals_exact_counting(spark, monkeypatch):
    xyz = np.random.default_rng(8).normal(size=(6000, 3))
    df = points(spark, xyz).cache()
    counted = []
    exact = cl.voxel_counts
    monkeypatch.setattr(cl, "voxel_counts", lambda p, s: counted.append(len(s)) or exact(p, s))
    quick = cl.find_voxel_size(df, 900)
    monkeypatch.setattr(cl, "voxel_estimates", lambda p, s: exact(p, s))
    assert quick == cl.find_voxel_size(df, 900) and sum(counted[: len(counted) // 2]) < 40
