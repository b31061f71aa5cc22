"""Cameras that look at a cloud, and what they see: views, turntables and trajectories as tables of pixels."""

from __future__ import annotations

from collections.abc import Callable
from math import cos, pi, radians, sin, tan

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from orbitspark.functions import linalg as la
from orbitspark.operators import cameras as cam
from orbitspark.operators import cloud as cl
from orbitspark.operators.visibility import observations
from orbitspark.storage import hinted

#: Name, azimuth and elevation of the views; the turntable's frames and elevation; the trajectory's elevation and margin; colours.
VIEWS = (("view_front", 0.0, 15.0), ("view_side", 90.0, 15.0), ("view_three_quarter", 35.0, 30.0), ("view_top", 0.0, 85.0))
TURNTABLE_FRAMES, TURNTABLE_ELEVATION, TRAJECTORY_ELEVATION, TRAJECTORY_MARGIN = 72, 20.0, 75.0, 1.25
POSE = [*cam.R, *cam.T, "fx", "fy", "cx", "cy", "width", "height"]


def axis_angle(axis: tuple[float, float, float], degrees: float) -> list[list[float]]:
    """The rotation about an axis: cos I + sin K + (1 - cos) aa'."""
    n = sum(a * a for a in axis) ** 0.5
    if not n:
        raise ValueError("an axis of length zero")
    x, y, z = (a / n for a in axis)
    c, s = cos(radians(degrees)), sin(radians(degrees))
    cross = [[0, -z, y], [z, 0, -x], [-y, x, 0]]
    return [[c * (i == j) + s * cross[i][j] + (1 - c) * (x, y, z)[i] * (x, y, z)[j] for j in range(3)] for i in range(3)]


def orbit_cameras(orbits: DataFrame, size: int, fov_deg: float = 35.0) -> DataFrame:
    """Poses and intrinsics of cameras at ``distance``, ``azimuth``, ``elevation`` (degrees) from the point (gx, gy, gz), each looking at it; other columns stay."""
    place = cam.orbit_position(F.col("distance"), F.col("azimuth"), F.col("elevation"))
    rows = orbits.withColumns({f"p{a}": p + F.col(f"g{a}") for p, a in zip(place, "xyz")})
    rows = cam.look_at(rows, la.vec("gx", "gy", "gz"), la.lit3(0, 1, 0))
    focal = 0.5 * size / tan(radians(fov_deg) / 2)
    rest = [c for c in orbits.columns if c not in ("distance", "azimuth", "elevation", "gx", "gy", "gz")]
    return rows.select(*rest, *cam.R, *cam.T, *(F.lit(v).alias(c) for c, v in (("fx", focal), ("fy", focal), ("cx", size / 2), ("cy", size / 2))), F.lit(size).alias("width"), F.lit(size).alias("height"))


def view_cameras(extent: DataFrame, size: int = 640, turntable: int = 0) -> DataFrame:
    """The four named views, or ``turntable`` cameras around it, of each cloud of ``extent`` (cx, cy, cz, radius, and what tells clouds apart)."""
    listed = [(f"turn_{i:03d}", 360.0 * i / turntable, TURNTABLE_ELEVATION) for i in range(turntable)] or list(VIEWS)
    named = [c for c in extent.columns if c not in ("cx", "cy", "cz", "radius")]
    rows = extent.crossJoin(F.broadcast(extent.sparkSession.createDataFrame(listed, "view string, azimuth double, elevation double")))  # 72 rows or so
    return orbit_cameras(rows.select(*named, "view", "azimuth", "elevation", cam.framing_distance(F.col("radius")).alias("distance"), *(F.col(f"c{a}").alias(f"g{a}") for a in "xyz")), size)


def ring_radius(cameras: DataFrame, extent: DataFrame) -> DataFrame:
    """One row: the greatest distance of a camera from the cloud's centre, and the number of cameras; null without any."""
    away = la.norm(la.sub(cam.centre(), la.vec("gx", "gy", "gz")))
    near = extent.select(*(F.col(f"c{a}").alias(f"g{a}") for a in "xyz"))
    return cameras.select(*cam.R, *cam.T).crossJoin(F.broadcast(near)).agg(F.max(away).alias("ring_radius"), F.count("*").alias("num_cameras"))


def trajectory_camera(cameras: DataFrame, extent: DataFrame, size: int = 640) -> DataFrame:
    """The camera from which the cloud and all cameras around it are in view."""
    far = F.greatest(F.col("radius"), F.coalesce("ring_radius", "radius"))
    row = extent.crossJoin(F.broadcast(ring_radius(cameras, extent)))
    row = row.select(F.lit("trajectory").alias("view"), F.lit(0.0).alias("azimuth"), F.lit(TRAJECTORY_ELEVATION).alias("elevation"), (cam.framing_distance(far) * TRAJECTORY_MARGIN).alias("distance"), *(F.col(f"c{a}").alias(f"g{a}") for a in "xyz"))
    return orbit_cameras(row, size)


def bounding_sphere(points: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run the middle of the box and the greatest distance from it, of finite points."""
    valid = points.where(cl.is_valid_point())
    middle = valid.groupBy(run).agg(*(((F.min(a) + F.max(a)) / 2).alias(f"s{a}") for a in "xyz"))
    away = la.norm(la.sub(la.vec("x", "y", "z"), la.vec("sx", "sy", "sz")))
    return valid.join(middle, run).groupBy(run).agg(*(F.first(f"s{a}").alias(f"s{a}") for a in "xyz"), F.max(away).alias("radius"))


def trajectory_steps(cameras: DataFrame, run: str = "run_id", order: str = "k") -> DataFrame:
    """Per run: mean and deviation of the cameras' distances from their middle, and the median step between neighbours in order."""
    rows = cameras.select(run, order, *(c.alias(f"c{a}") for c, a in zip(cam.centre(), "xyz")))
    middle = rows.groupBy(run).agg(*(F.avg(f"c{a}").alias(f"m{a}") for a in "xyz"))
    here = la.vec("cx", "cy", "cz")
    w = Window.partitionBy(run).orderBy(order)
    before = tuple(F.lag(f"c{a}").over(w) for a in "xyz")
    rows = rows.withColumn("step", la.norm(la.sub(here, before))).join(middle, run).withColumn("away", la.norm(la.sub(here, la.vec("mx", "my", "mz"))))
    return rows.groupBy(run).agg(F.avg("away").alias("mean_radius"), F.stddev_pop("away").alias("radius_deviation"), F.median("step").alias("median_step"), F.count("*").alias("num_cameras"))


def cameras_from_records(cameras: DataFrame, width: Column | None = None, height: Column | None = None, tolerance: float = 0.01) -> DataFrame:
    """Cameras of recorded frames that can render, with ``reason`` where one can't: no intrinsics, or an image of another shape.

    For an image of another size the intrinsics are scaled along each axis.
    """
    w, h = width if width is not None else F.col("width"), height if height is not None else F.col("height")
    shape = F.abs(F.col("width") / F.col("height") - w / h) <= tolerance
    reason = F.when(F.col("fx").isNull() | F.col("fy").isNull(), "no intrinsics").when(~shape, "the image has another shape")
    sx, sy = w / F.col("width"), h / F.col("height")
    rest = [c for c in cameras.columns if c not in ("fx", "fy", "cx", "cy", "width", "height")]
    return cameras.select(
        *rest, *((F.col(c) * s).alias(c) for c, s in (("fx", sx), ("fy", sy), ("cx", sx), ("cy", sy))), w.cast("int").alias("width"), h.cast("int").alias("height"), reason.alias("reason")
    )


def seen(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Points before each camera with pixel coordinates u, v and ``depth``. ``cameras`` (``view`` and a pose each) are few and broadcast."""
    n = cameras.count()
    out = cam.projected(cam.spread(points, n), cameras.select("view", *cam.R, *cam.T, "fx", "fy", "cx", "cy", "width", "height"), n, 1e-6)
    return out.where("valid").drop("valid")


def middles(poses: np.ndarray, supersample: int, reach: float, rest: list[str]) -> Callable[[pa.RecordBatch], list[pa.RecordBatch]]:
    """What makes of a batch of points the fine pixels (camera, mx, my) on which they lie and whose disk meets the picture, with depth and ``rest``: ``seen``, by the same steps."""

    def of(batch):
        x, y, z = (batch.column(a).to_numpy(zero_copy_only=False) for a in "xyz")
        out = []
        for k, pose in enumerate(poses):
            r, t, (fx, fy, cx, cy, width, height) = pose[:9].reshape(3, 3), pose[9:12], pose[12:]
            with np.errstate(all="ignore"):
                px, py, depth = (r[i, 0] * x + r[i, 1] * y + r[i, 2] * z + t[i] for i in range(3))
                mx, my = np.rint((fx * (px / depth) + cx) * supersample), np.rint((fy * (py / depth) + cy) * supersample)
            ok = np.isfinite(px) & np.isfinite(py) & np.isfinite(depth) & (depth > 1e-6)
            ok &= (mx >= -reach) & (mx <= width * supersample + reach) & (my >= -reach) & (my <= height * supersample + reach)
            at = np.flatnonzero(ok)
            if len(at):
                here = [np.full(len(at), k, "i4"), mx[at].astype("i8"), my[at].astype("i8"), depth[at]]
                out.append(pa.RecordBatch.from_arrays([*map(pa.array, here), *(batch.column(c).take(pa.array(at)) for c in rest)], names=["camera", "mx", "my", "depth", *rest]))
        return out

    return of


def render_points(points: DataFrame, cameras: DataFrame, point_size: float = 2.2, shading: float = 0.35, supersample: int = 2, index: str = "point_id") -> DataFrame:
    """The pixels that points cover in each camera's picture: view, px, py, r, g, b; pixels not listed are background.

    Splats are disks in a picture ``supersample`` times as large. Of those on a pixel the nearest wins, of equals the smallest index. Far points are darkened
    by up to ``shading`` between the exact 2nd and 98th percentile of depth of a view. A pixel of the picture is the mean of its fine pixels, uncovered ones white.
    A point whose disk misses the picture is dropped before its disk is spread out, and points that share a fine pixel as
    their middle are reduced to the nearest first, by each task and then over all, so that what is dealt anew and spread is
    bounded by the pictures and not by the points. ``cameras`` are few, a row a picture.
    """
    reach = max(point_size * supersample / 2, 0.5)
    rest = [index, "r", "g", "b"]
    posed = cameras.select("view", *(F.col(c).cast("double").alias(c) for c in POSE)).toArrow()
    n = len(posed)
    few = points.sparkSession.createDataFrame([(r["view"], k, *(r[c] for c in POSE)) for k, r in enumerate(posed.to_pylist())], StructType([cameras.schema["view"], StructField("camera", IntegerType()), *(StructField(c, DoubleType()) for c in POSE)]))
    points = cam.spread(points.select(*rest, *(F.col(a).cast("double").alias(a) for a in "xyz")), n)
    depths = cam.projected(points.select(*"xyz"), few.select("view", *cam.R, *cam.T, "fx", "fy", "cx", "cy"), n, 1e-6).where("valid").select("view", "depth")
    ends = cl.quantiles(depths, ["depth"], [0.02, 0.98], "view").select("view", F.get("depth", F.lit(0)).alias("_near"), F.get("depth", F.lit(1)).alias("_far"))
    dark = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("depth") - F.col("_near")) / F.greatest(F.col("_far") - F.col("_near"), F.lit(1e-9))))
    poses = np.array([[np.nan if r[c] is None else r[c] for c in POSE] for r in posed.select(POSE).to_pylist()]).reshape(-1, len(POSE))
    keys = ["camera", "mx", "my"]
    schema = StructType([StructField("camera", IntegerType()), StructField("mx", LongType()), StructField("my", LongType()), StructField("depth", DoubleType()), *(points.schema[c] for c in rest)])
    nearest = cl.nearest(cl.nearest_in_tasks(points, keys, index, middles(poses, supersample, reach, rest), schema), keys, index)
    nearest = nearest.join(hinted(few.select("view", "camera", "width", "height"), n), "camera").drop("camera")
    shaded = cl.with_row(nearest, ends, "view").withColumn("light", 1 - shading * dark)
    splats = shaded.withColumn("o", F.explode(cl.disk_offsets(reach))).withColumns({"px": F.col("mx") + F.col("o.dx"), "py": F.col("my") + F.col("o.dy")})
    splats = splats.where((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < F.col("width") * supersample) & (F.col("py") < F.col("height") * supersample))
    fine = splats.groupBy("view", "px", "py").agg(F.min_by(F.struct(*((F.col(c) * F.col("light")).alias(c) for c in "rgb")), F.struct("depth", index)).alias("p"))
    cell = fine.groupBy("view", F.floor(F.col("px") / supersample).alias("px"), F.floor(F.col("py") / supersample).alias("py"))
    whole = float(supersample * supersample)
    return cell.agg(*(F.floor((F.sum(f"p.{c}") + 255.0 * (whole - F.count("*"))) / whole).cast("int").alias(c) for c in "rgb"))


def mark_points(places: DataFrame, cameras: DataFrame, radius: float = 3.5) -> DataFrame:
    """Pixels of small disks where places (point_id, x, y, z) appear: view, px, py. Marks lie over everything."""
    rows = seen(places, cameras).withColumn("o", F.explode(cl.disk_offsets(radius)))
    rows = rows.select("view", (F.rint("u") + F.col("o.dx")).cast("long").alias("px"), (F.rint("v") + F.col("o.dy")).cast("long").alias("py"), "width", "height")
    return rows.where((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < F.col("width")) & (F.col("py") < F.col("height"))).select("view", "px", "py").distinct()


def media_index(cameras: DataFrame, run_id: str, example: bool = False) -> DataFrame:
    """One row a picture: file, kind and caption."""
    kind = F.when(F.col("view").startswith("view_"), "view").when(F.col("view").startswith("turn_"), "turntable").otherwise(F.col("view"))
    caption = F.concat_ws(" · ", F.translate("view", "_", " "), F.lit(f"run {run_id}"), F.lit("precomputed example" if example else None))
    return cameras.select(F.concat("view", F.lit(".ppm")).alias("file"), kind.alias("kind"), caption.alias("caption"))


def entities(points: DataFrame, cameras: DataFrame, direction: str = "world_to_camera") -> DataFrame:
    """What a viewer would show: path, kind, and camera-to-world poses of cameras. Another direction of the poses is refused."""
    if direction != "world_to_camera":
        raise ValueError(f"poses must be world to camera, not {direction}")
    moved = cam.invert_transform(cameras.select(F.concat(F.lit("world/cameras/"), F.col("frame_id")).alias("path"), *cam.R, *cam.T))
    cloud = points.agg(F.count("*").alias("n")).select(F.lit("world/points").alias("path"), F.lit("points").alias("kind"), "n", *(F.lit(None).cast("double").alias(c) for c in cam.R + cam.T))
    return cloud.unionByName(moved.select("path", F.lit("camera").alias("kind"), F.lit(1).cast("long").alias("n"), *cam.R, *cam.T))


def make_scene(spark: SparkSession, n_cameras: int = 12, n_points: int = 500, radius: float = 3.0, height: float = 1.0, half: float = 0.5, size: tuple[int, int] = (640, 480), focal: tuple[float, float] = (500.0, 520.0)) -> tuple[DataFrame, DataFrame]:
    """A ring of cameras around a cube whose surface is covered with points; the same every time, in any partitioning."""
    k = F.col("id")
    angle = F.lit(2 * pi) * k / n_cameras
    ring = spark.range(n_cameras).select(k.alias("k"), F.format_string("%04d", k + 1).alias("frame_id"), (F.cos(angle) * radius).alias("px"), F.lit(height).alias("py"), (F.sin(angle) * radius).alias("pz"))
    ring = cam.look_at(ring, la.lit3(0, 0, 0), la.lit3(0, 1, 0)).drop("px", "py", "pz")
    ring = ring.select("k", "frame_id", *cam.R, *cam.T, *(F.lit(v).alias(c) for c, v in zip(("fx", "fy", "cx", "cy"), (*focal, size[0] / 2, size[1] / 2))), F.lit(size[0]).alias("width"), F.lit(size[1]).alias("height"))
    part = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20) * 2 - 1) * half
    side, u, v = F.col("id") % 6, part(1), part(2)
    fixed = F.when(side % 2 == 0, half).otherwise(-half)
    axis = F.floor(side / 2)
    place = {"x": F.when(axis == 0, fixed).otherwise(u), "y": F.when(axis == 1, fixed).when(axis == 0, u).otherwise(v), "z": F.when(axis == 2, fixed).otherwise(v)}
    colour = {c: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(256)).cast("int") for c, s in (("r", 3), ("g", 4), ("b", 5))}
    return ring, spark.range(n_points).select(F.col("id").alias("point_id"), *(e.alias(n) for n, e in (place | colour).items()))


def scene_with_tracks(spark: SparkSession, distortion: DataFrame | None = None, jitter: float = 0.0, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``make_scene`` and what its cameras see: cameras with image_id, points, and seen (image_id, point_id, u, v).

    ``distortion`` is a rigid transform of the whole world (r00 to r22, t0 to t2; one row); ``jitter`` moves each camera up or down by at most that much
    without turning it. Both leave every observation consistent with its pose, so that an alignment can be held against what was put in.
    """
    cameras, points = make_scene(spark, **options)
    if jitter:
        # t = -R c, so a step of the camera along +Y takes that step's second column of R from t.
        lift = (F.pmod(F.xxhash64("k", F.lit(9)), F.lit(1 << 20)) / float(1 << 20) * 2 - 1) * jitter
        cameras = cameras.withColumns({f"t{i}": F.col(f"t{i}") - F.col(f"r{i}1") * lift for i in range(3)})
    if distortion is not None:
        cameras, points = cam.transform_poses(cameras, distortion), cam.transform_points(points, distortion)
    cameras = cameras.withColumn("image_id", (F.col("k") + 1).cast("int"))
    seen = observations(points.select("point_id", *"xyz"), cameras.select("image_id", *cam.R, *cam.T, "fx", "fy", "cx", "cy", "width", "height"))
    return cameras, points, seen.select("image_id", "point_id", "u", "v")
