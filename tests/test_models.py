"""Scenes with tracks, written as model files by many tasks and read again; diagnostics of many runs, of which some contradict themselves."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitspark import errors
from orbitspark.operators import cameras as cam
from orbitspark.operators import runs as rn
from orbitspark.operators import scenes
from orbitspark.plans import pipelines
from orbitspark.sources import model_files, sparse_model


def distorted(spark, tilt=52.0, offset=(0.7, -1.3, 2.1)):
    turn = scenes.axis_angle((1.0, 0.4, 0.2), tilt)
    return spark.createDataFrame([(*(x for line in turn for x in line), *offset)], ", ".join(f"{c} double" for c in cam.R + cam.T))


def test_model_files_round_trip(spark, tmp_path):
    cams, pts, seen = (df.cache() for df in scenes.scene_with_tracks(spark, distorted(spark), n_cameras=6, n_points=200))
    folder = f"file://{tmp_path}/sparse"
    pts = pts.withColumn("error", F.when(F.col("point_id") % 3 > 0, F.col("point_id") / 7))
    counts = model_files.write_model(cams, pts, seen, folder, parts=3)
    assert counts == {"cameras.bin": 6, "images.bin": 6, "points3D.bin": 200} and sorted(f.name for f in (tmp_path / "sparse").iterdir() if not f.name.endswith(".crc")) == sorted(counts)
    back = {r["frame_id"]: r for r in sparse_model.read_cameras(spark, folder).collect()}
    for r in cams.collect():
        b = back[r["frame_id"]]
        assert all(b[c] == pytest.approx(r[c], abs=1e-9) for c in [*cam.R, *cam.T, "fx", "fy", "cx", "cy", "width", "height"])
    points = sparse_model.read_points(spark, folder).orderBy("point_id").collect()
    tracks = {r["point_id"]: r["n"] for r in seen.groupBy("point_id").agg(F.count("*").alias("n")).collect()}
    for a, b in zip(pts.orderBy("point_id").collect(), points):
        assert (a["point_id"], a["x"], a["z"], a["r"], a["b"], a["error"]) == (b["point_id"], b["x"], b["z"], b["r"], b["b"], b["error"]) and b["track_length"] == tracks.get(a["point_id"], 0)
    images = sparse_model.read_part(spark, folder, "images.bin").collect()
    assert {r["image_id"]: r["n_points2d"] for r in images} == {r["image_id"]: r["n"] for r in seen.groupBy("image_id").agg(F.count("*").alias("n")).collect()}
    with pytest.raises(errors.AlreadyThere):
        model_files.write_model(cams, pts, seen, folder)


def test_tracks_and_lists_of_images_name_each_other(spark, tmp_path):
    cams, pts, seen = scenes.scene_with_tracks(spark, n_cameras=4, n_points=30)
    folder = f"file://{tmp_path}"
    model_files.write_model(cams, pts, seen, folder, parts=2)
    lists, data, at = {}, (tmp_path / "images.bin").read_bytes(), 8
    for _ in range(4):
        image = struct.unpack_from("<I", data, at)[0]
        at = data.index(b"\0", at + 64) + 1
        n = struct.unpack_from("<Q", data, at)[0]
        lists[image] = [struct.unpack_from("<ddQ", data, at + 8 + 24 * i) for i in range(n)]
        at += 8 + 24 * n
    assert at == len(data)
    data, at, links = (tmp_path / "points3D.bin").read_bytes(), 8, 0
    for _ in range(30):
        point, n = struct.unpack_from("<Q", data, at)[0], struct.unpack_from("<Q", data, at + 43)[0]
        for i in range(n):
            image, place = struct.unpack_from("<II", data, at + 51 + 8 * i)
            assert lists[image][place][2] == point
        at, links = at + 51 + 8 * n, links + n
    assert at == len(data) and links == seen.count() == sum(map(len, lists.values())) > 0


def test_a_distorted_ring_is_recovered(spark, tmp_path):
    cams, pts, seen = scenes.scene_with_tracks(spark, distorted(spark), jitter=0.06, n_cameras=12, n_points=300)
    folder = f"file://{tmp_path}"
    model_files.write_model(cams, pts, seen, folder, parts=2)
    read = sparse_model.read_cameras(spark, folder)
    out = pipelines.ingest(read, sparse_model.read_points(spark, folder), read.select("frame_id"))
    a = out["alignment"].first()
    up = np.array(scenes.axis_angle((1.0, 0.4, 0.2), 52.0)) @ [0, 1, 0]
    found = np.array([[a[f"r{i}{j}"] for j in range(3)] for i in range(3)]) @ up
    assert a["status"] == "estimated" and math.degrees(math.acos(min(1.0, found[1]))) < 5
    d = out["diagnostics"].first()
    assert d["status"] == "success" and all(abs(d[f"{n}_{c}"]) < 1.0 for n in ("min", "max") for c in "xyz")


def test_contradictory_runs_stop_no_others(spark):
    frames = spark.createDataFrame([("a", True, None), ("a", False, "redundant"), ("a", False, "redundant"), ("a", None, "odd"), ("b", True, None), ("c", False, ""), ("e", True, None)], "run_id string, selected boolean, reject_reason string")
    cameras = spark.createDataFrame([("a",), ("b",), ("b",), ("ghost",)], "run_id string")
    points = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 5, 0.5), ("a", float("nan"), 0.0, 0.0, None, None), ("b", 0.0, 0.0, 0.0, 1, 1.0), ("d", 1.0, 1.0, 1.0, 1, None)], "run_id string, x double, y double, z double, r int, error double")
    rows, rejects = rn.diagnostics(frames, cameras, points)
    assert {r["run_id"]: r["reason"] for r in rejects.collect()} == {"b": "2 cameras of 1 selected frames", "ghost": "1 cameras of 0 selected frames"}
    got = {r["run_id"]: r.asDict(recursive=True) for r in rows.collect()}
    assert set(got) == {"a", "c", "d", "e"}
    a = got["a"]
    assert a["reject_reasons"] == {"odd": 1, "redundant": 2} and (a["frames_considered"], a["frames_selected"], a["num_points"], a["num_points_valid"]) == (4, 1, 2, 1)
    assert a["registration_ratio"]["value"] == 1.0 and a["bounding_box"]["max_z"] == 3.0 and a["mean_reprojection_error"]["value"] == 0.5 and not a["has_colours"] and a["status"] == "success"
    assert got["c"]["registration_ratio"]["value"] is None and "no frames" in got["c"]["registration_ratio"]["reason"] and got["c"]["reject_reasons"] == {}
    assert got["d"]["mean_reprojection_error"]["availability"] == "unavailable" and got["d"]["has_colours"] and got["d"]["status"] == "invalid_result"
    assert got["e"]["bounding_box"] is None and got["e"]["bounding_box_reason"] == "no finite points"
