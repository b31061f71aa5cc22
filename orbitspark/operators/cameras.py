"""Camera poses (world to camera, x right, y down, z forward), rigid transforms, and world alignment."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.functions import linalg as la
from orbitspark.functions.measures import finite
from orbitspark.operators.cloud import medians, with_row
from orbitspark.storage import hinted, written

#: Pairs of points and cameras that are projected in a task, and the most tasks.
PAIRS_OF_A_TASK, MOST_TASKS = 5_000_000, 2000
R = [f"r{i}{j}" for i in range(3) for j in range(3)]
T = ["t0", "t1", "t2"]
#: Fixed values, the gate of the alignment: least cameras, greatest planarity, least arc, least agreement of up.
GATE = {"min_cameras": 6, "max_planarity": 0.25, "min_arc_deg": 180.0, "min_sign_agreement": 0.3}


def rotation() -> la.Mat:
    return la.mat(R)


def translation() -> la.Vec:
    return la.vec(*T)


def centre() -> la.Vec:
    """Where the camera stands: -R't."""
    return la.scale(la.matvec(la.transpose(rotation()), translation()), -1.0)


def up() -> la.Vec:
    return la.scale(rotation()[1], -1.0)


def forward() -> la.Vec:
    return rotation()[2]


def look_at(df: DataFrame, target: la.Vec, world_up: la.Vec) -> DataFrame:
    """Adds the pose of a camera at (px, py, pz) that looks at a point; another up is taken along the view."""
    toward = la.sub(target, la.vec("px", "py", "pz"))
    df = la.step(df, {"_n": la.norm(toward)} | la.named("_f0 _f1 _f2", toward))
    df = la.step(df, {f"r2{i}": F.try_divide(F.col(f"_f{i}"), F.col("_n")) for i in range(3)})
    ahead = la.vec("r20", "r21", "r22")
    df = la.step(df, la.named("_s0 _s1 _s2", la.cross(ahead, world_up)))
    df = la.step(df, {"_l": la.norm(la.vec("_s0", "_s1", "_s2"))} | la.named("_h0 _h1 _h2", la.across(ahead)))
    spare = la.cross(ahead, la.vec("_h0", "_h1", "_h2"))
    df = la.step(df, {f"_s{i}": F.when(F.col("_l") < 1e-9, x).otherwise(F.col(f"_s{i}")) for i, x in enumerate(spare)})
    df = la.step(df, la.named("r00 r01 r02", la.unit(la.vec("_s0", "_s1", "_s2"))))
    df = la.step(df, la.named("r10 r11 r12", la.cross(ahead, la.vec("r00", "r01", "r02"))))
    df = df.withColumns({f"t{i}": -x for i, x in enumerate(la.matvec(rotation(), la.vec("px", "py", "pz")))})
    return df.drop("_n", "_l", *(f"_{c}{i}" for c in "fsh" for i in range(3)))


def pinned(one: DataFrame) -> DataFrame:
    """A one-row result as a table of its values, so that what follows neither recomputes nor repeats it."""
    return one.sparkSession.createDataFrame(one.collect(), one.schema)


def orbit_position(distance: Column, azimuth_deg: Column, elevation_deg: Column) -> la.Vec:
    """A place on a sphere around the origin: +Y up, azimuth 0 in front (+Z)."""
    a, e = F.radians(azimuth_deg), F.radians(elevation_deg)
    return distance * F.cos(e) * F.sin(a), distance * F.sin(e), distance * F.cos(e) * F.cos(a)


def framing_distance(radius: Column, fov_deg: float = 35.0, margin: float = 1.12) -> Column:
    return radius * margin / F.sin(F.lit(fov_deg * pi / 360))


def transform_points(points: DataFrame, transform: DataFrame, run: str | None = None) -> DataFrame:
    """x' = A x + a for ``transform`` of columns r00..r22, t0..t2: one row, broadcast, or with ``run`` one a run."""
    moved = la.add(la.matvec(rotation(), la.vec("x", "y", "z")), translation())
    rest = [c for c in points.columns if c not in ("x", "y", "z")]
    return with_row(points, transform.select(*([] if run is None else [run]), *R, *T), run).select(*rest, *(m.alias(c) for m, c in zip(moved, "xyz")))


def transform_poses(cameras: DataFrame, transform: DataFrame, run: str | None = None) -> DataFrame:
    """Poses in the moved world: R' = R A', t' = t - R' a; one transform, or with ``run`` one a run."""
    one = transform.select(*([] if run is None else [run]), *(F.col(c).alias(f"A{c}") for c in R), *(F.col(c).alias(f"A{c}") for c in T))
    r = la.matmul(rotation(), la.transpose(la.mat([f"A{c}" for c in R])))
    t = la.sub(translation(), la.matvec(r, la.vec(*(f"A{c}" for c in T))))
    rest = [c for c in cameras.columns if c not in R + T]
    return with_row(cameras, one, run).select(*rest, *(r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), *(x.alias(c) for x, c in zip(t, T)))


def invert_transform(transform: DataFrame) -> DataFrame:
    a = la.transpose(rotation())
    t = la.scale(la.matvec(a, translation()), -1.0)
    rest = [c for c in transform.columns if c not in R + T]
    return transform.select(*rest, *(a[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), *(x.alias(c) for x, c in zip(t, T)))


def project(points: DataFrame, cameras: DataFrame, least_depth: float = 0.0) -> DataFrame:
    """Every camera's view of every point: u, v (null where invalid), depth, valid.

    The result has a row a pair, so this is for chosen views; ``visibility.observations`` finds what cameras see without all pairs.
    ``cameras`` (with fx, fy, cx, cy) are broadcast if their counted rows are few. Points are dealt to tasks by the number of pairs, as a small file
    of points is one task's otherwise.
    """
    n = cameras.count()
    tasks = points.count() * n // PAIRS_OF_A_TASK
    dealt = points.repartition(min(tasks, MOST_TASKS)) if tasks > 1 else points
    return projected(dealt, cameras, n, least_depth)


def spread(points: DataFrame, n: int) -> DataFrame:
    """Points for ``n`` cameras, to be read more than once: as they are if their tasks are even or small, else dealt and written once."""
    total, most = points.groupBy(F.spark_partition_id()).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if most * n <= PAIRS_OF_A_TASK or most * points.sparkSession.sparkContext.defaultParallelism <= 2 * total:
        return points
    return written(points.repartition(min(-(-total * n // PAIRS_OF_A_TASK), MOST_TASKS)), "spread")


def projected(points: DataFrame, cameras: DataFrame, n: int, least_depth: float = 0.0) -> DataFrame:
    """``project`` by the tasks that the points are in, of ``n`` cameras."""
    names = [c for c in cameras.columns if c not in R + T + ["fx", "fy", "cx", "cy"]]
    seen = points.crossJoin(hinted(cameras, n, 32 * len(cameras.columns)))
    c = la.add(la.matvec(rotation(), la.vec("x", "y", "z")), translation())
    seen = seen.select(*points.columns, *names, "fx", "fy", "cx", "cy", c[0].alias("_x"), c[1].alias("_y"), c[2].alias("depth"))
    valid = finite(F.col("_x")) & finite(F.col("_y")) & finite(F.col("depth")) & (F.col("depth") > least_depth)
    seen = seen.withColumn("valid", valid)
    u, v = F.col("fx") * F.try_divide("_x", "depth") + F.col("cx"), F.col("fy") * F.try_divide("_y", "depth") + F.col("cy")
    return seen.withColumn("u", F.when(F.col("valid"), u)).withColumn("v", F.when(F.col("valid"), v)).drop("fx", "fy", "cx", "cy", "_x", "_y")


RING, RAYS = [f"s{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")], [f"a{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]


def keys(run: str | None) -> list[str]:
    return [] if run is None else [run]


def ring_sums() -> list[Column]:
    """Aggregates of camera centres (cx, cy, cz) and ups (ux, uy, uz): count, means, covariances."""
    means = [F.avg(f"{n}{a}").alias(f"{n}{a}") for n in "cu" for a in "xyz"]
    return [F.count("*").alias("n"), *means, *(F.covar_pop(f"c{s[1]}", f"c{s[2]}").alias(s) for s in RING)]


def ring_frame(one: DataFrame) -> DataFrame:
    """Adds the plane's normal (nx, ny, nz; its sign by the mean up), singular values s1 to s3 and planarity to rows of ``ring_sums``."""
    one = la.with_eigenvalues(one, RING, ["_e1", "_e2", "_e3"])
    one = la.with_null_vector(one, RING, "_e3", ["_m0", "_m1", "_m2"])
    m = la.vec("_m0", "_m1", "_m2")
    one = la.step(one, {"_sign": F.when(la.dot(m, la.vec("ux", "uy", "uz")) < 0, -1.0).otherwise(1.0)} | {f"s{i}": F.sqrt(F.greatest(F.col(f"_e{i}"), F.lit(0.0)) * F.col("n")) for i in (1, 2, 3)})
    one = one.withColumns({f"n{a}": x * F.col("_sign") for a, x in zip("xyz", m)}).withColumn("planarity", F.when(F.col("s2") > 1e-12, F.col("s3") / F.col("s2")))
    return one.drop("_sign", *(f"_e{i}" for i in (1, 2, 3)), *(f"_m{i}" for i in range(3)), *RING)


def ray_sums() -> list[Column]:
    """Aggregates of rays (ox, oy, oz) along unit vectors (dx, dy, dz): the normal equations of their nearest point."""
    o, d = la.vec("ox", "oy", "oz"), la.vec("dx", "dy", "dz")
    at = dict(zip("xyz", range(3)))
    sums = [F.sum(F.lit(1.0 if s[1] == s[2] else 0.0) - d[at[s[1]]] * d[at[s[2]]]).alias(s) for s in RAYS]
    return sums + [F.sum(o[i] - d[i] * la.dot(d, o)).alias(f"b{a}") for a, i in at.items()]


def ray_point(one: DataFrame) -> DataFrame:
    """Adds the least-squares point (px, py, pz) to rows of ``ray_sums``, null where rays are nearly parallel."""
    one = la.with_eigenvalues(one, RAYS, ["_high", "_mid", "_low"])
    a = {s[1:]: F.col(s) for s in RAYS}
    m = (a["xx"], a["xy"], a["xz"]), (a["xy"], a["yy"], a["yz"]), (a["xz"], a["yz"], a["zz"])
    good = (F.col("_low") > 0) & (F.col("_high") / F.nullif(F.col("_low"), F.lit(0.0)) <= 1e8)
    one = la.step(one, {f"p{a}": F.when(good, x) for a, x in zip("xyz", la.solve(m, la.vec("bx", "by", "bz")))})
    return one.drop("_high", "_mid", "_low", *RAYS, "bx", "by", "bz")


def ring_plane(cameras: DataFrame, run: str | None = None) -> DataFrame:
    """Cameras, centroid, plane normal (its sign by the mean up), singular values and planarity s3/s2: one row, or one a run."""
    rows = cameras.select(*keys(run), *(c.alias(f"c{a}") for c, a in zip(centre(), "xyz")), *(c.alias(f"u{a}") for c, a in zip(up(), "xyz")))
    one = ring_frame(rows.groupBy(*keys(run)).agg(*ring_sums()))
    return one.select(*keys(run), "n", "cx", "cy", "cz", "ux", "uy", "uz", "nx", "ny", "nz", "s1", "s2", "s3", "planarity")


def nearest_point_to_rays(rays: DataFrame, run: str | None = None) -> DataFrame:
    """The least-squares point of all rays (o, d), null if they are nearly parallel: one row, or one a run."""
    d = la.unit(la.vec("dx", "dy", "dz"))
    rows = la.step(rays.select(*keys(run), "ox", "oy", "oz", "dx", "dy", "dz"), la.named("dx dy dz", d))
    return ray_point(rows.groupBy(*keys(run)).agg(F.count("*").alias("n"), *ray_sums())).select(*keys(run), "n", "px", "py", "pz")


def arc_coverage(cameras: DataFrame, frame: DataFrame, run: str | None = None) -> DataFrame:
    """360 degrees less the widest gap between camera azimuths around (px, py, pz) in the plane of (nx, ny, nz): one row, or one a run."""
    n = la.vec("nx", "ny", "nz")
    axes = la.step(frame.select(*keys(run), "px", "py", "pz", "nx", "ny", "nz"), la.named("_h0 _h1 _h2", la.across(n)))
    axes = la.step(axes, la.named("_a0 _a1 _a2", la.unit(la.cross(n, la.vec("_h0", "_h1", "_h2")))))
    axes = la.step(axes, la.named("_b0 _b1 _b2", la.cross(n, la.vec("_a0", "_a1", "_a2"))))
    rows = with_row(cameras.select(*keys(run), *(c.alias(f"_c{a}") for c, a in zip(centre(), "xyz"))), axes, run)
    away = la.sub(la.vec("_cx", "_cy", "_cz"), la.vec("px", "py", "pz"))
    angle = F.pmod(F.degrees(F.atan2(la.dot(away, la.vec("_b0", "_b1", "_b2")), la.dot(away, la.vec("_a0", "_a1", "_a2")))), F.lit(360.0))
    out = widest_gap(rows.select(*(keys(run) or [F.lit(1).alias("run")]), angle.alias("angle")), run or "run")
    return out.select(*keys(run), "arc_deg")


def widest_gap(angles: DataFrame, run: str, sectors: int = 1024) -> DataFrame:
    """Per run: 360 less the widest gap between neighbouring angles around the circle; 0 below two.

    Neighbours are found within sectors of the circle first, so that a run of any length is dealt over tasks; then
    between the ends of its sectors, ``sectors`` rows a run at most.
    """
    sector = F.floor(F.pmod("angle", F.lit(360.0)) / 360.0 * sectors)
    rows = angles.select(run, "angle", sector.alias("_sector"))
    within_ = Window.partitionBy(run, "_sector").orderBy("angle")
    rows = rows.withColumn("_gap", F.lead("angle").over(within_) - F.col("angle"))
    ends = rows.groupBy(run, "_sector").agg(F.max("_gap").alias("_gap"), F.min("angle").alias("_low"), F.max("angle").alias("_high"), F.count("*").alias("_n"))
    w = Window.partitionBy(run)
    following = F.coalesce(F.lead("_low").over(w.orderBy("_low")), F.min("_low").over(w) + 360)
    ends = ends.withColumn("_gap", F.greatest("_gap", following - F.col("_high")))
    return ends.groupBy(run).agg(F.when(F.sum("_n") < 2, 0.0).otherwise(360 - F.max("_gap")).alias("arc_deg"))


def estimate_alignment(cameras: DataFrame, points: DataFrame | None = None, gate: dict | None = None, first: str = "k", run: str | None = None) -> DataFrame:
    """Status, reason, centre method, quality and the transform that puts the object at the origin, +Y up: one row, or with ``run`` one a run, of any number of runs.

    The centre is where the optical axes meet if it lies before most cameras, else the median of the
    points, else the mean of the cameras. If a check of the gate fails, the world is only re-centred.
    The camera of the smallest ``first`` goes to the front (+Z).

    Cameras are read three times: for the sums of a run, for the share that looks at the meeting point, and for their
    azimuths. All else are formulas over one row a run; nothing goes through the driver.
    """
    gate, key = gate or GATE, keys(run) or ["_one"]
    cameras = cameras if run else cameras.withColumn("_one", F.lit(1))
    points = points if points is None or run else points.withColumn("_one", F.lit(1))
    rows = cameras.select(key[0], F.col(first).alias("_k"), *(c.alias(f"c{a}") for c, a in zip(centre(), "xyz")), *(c.alias(f"u{a}") for c, a in zip(up(), "xyz")), *(c.alias(f"d{a}") for c, a in zip(forward(), "xyz")))
    rows = la.step(rows, la.named("dx dy dz", la.unit(la.vec("dx", "dy", "dz"))) | {f"o{a}": F.col(f"c{a}") for a in "xyz"})
    one = rows.groupBy(*key).agg(*ring_sums(), *ray_sums(), F.min_by(F.struct("ox", "oy", "oz"), "_k").alias("o"))
    one = written(ray_point(ring_frame(one)).select(*key, "n", *(f"{v}{a}" for v in "cupn" for a in "xyz"), "s1", "s2", "s3", "planarity", "o.*"), "frames")
    meet = one.select(*key, "px", "py", "pz")
    toward = la.dot(la.sub(la.vec("px", "py", "pz"), la.vec("ox", "oy", "oz")), la.vec("dx", "dy", "dz"))
    before = with_row(rows.select(*key, "ox", "oy", "oz", "dx", "dy", "dz"), meet, key[0]).groupBy(*key).agg(F.avg((toward > 0).cast("double")).alias("_before"))
    one = with_row(one, before, key[0])
    if points is None:
        one = one.withColumns({f"m{a}": F.lit(None).cast("double") for a in "xyz"})
    else:
        middle = medians(points, key[0]).withColumnRenamed(key[0], "_of")
        one = one.join(middle, F.col(key[0]).eqNullSafe(F.col("_of")), "left").drop("_of")
    axes = F.col("px").isNotNull() & (F.col("_before") >= 0.5)
    by_points = F.col("mx").isNotNull()
    method = F.when(axes, "optical_axes").when(by_points, "points_median").otherwise("camera_centroid")
    one = la.step(one, {"centre_method": method} | {f"p{a}": F.when(axes, F.col(f"p{a}")).when(by_points, F.col(f"m{a}")).otherwise(F.col(f"c{a}")) for a in "xyz"})
    one = written(one, "frames")
    one = with_row(one, arc_coverage(cameras, one, key[0]), key[0])
    one = one.withColumn("sign_agreement", la.dot(la.vec("nx", "ny", "nz"), la.vec("ux", "uy", "uz")))
    some = F.col("n") >= 3
    checks = {
        "min_cameras": F.col("n") >= gate["min_cameras"], "max_planarity": some & (F.col("planarity") <= gate["max_planarity"]),
        "min_arc_deg": some & (F.col("arc_deg") >= gate["min_arc_deg"]), "min_sign_agreement": some & (F.col("sign_agreement") >= gate["min_sign_agreement"]),
    }
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items())))
    one = la.step(one, {"failed": F.array_join(failed, ", ")})
    # The tilt takes the normal to +Y; the yaw then takes the first camera, seen from above, to +Z.
    tilt_names, yaw_names = ([f"_{n}{i}{j}" for i in range(3) for j in range(3)] for n in "tw")
    one = la.with_rotation(one, ["nx", "ny", "nz"], la.lit3(0, 1, 0), tilt_names)
    tilt, yaw = la.mat(tilt_names), la.mat(yaw_names)
    one = la.step(one, la.named("_g0 _g1 _g2", la.matvec(tilt, la.sub(la.vec("ox", "oy", "oz"), la.vec("px", "py", "pz")))))
    level = la.unit((F.col("_g0"), F.lit(0.0), F.col("_g2")))
    one = la.step(one, {f"_l{i}": F.coalesce(x, F.lit(1.0 if i == 2 else 0.0)) for i, x in enumerate(level)})
    one = la.with_rotation(one, ["_l0", "_l1", "_l2"], la.lit3(0, 0, 1), yaw_names)
    good = F.col("failed") == ""
    both = la.matmul(yaw, tilt)
    one = la.step(one, {f"r{i}{j}": F.when(good, both[i][j]).otherwise(1.0 if i == j else 0.0) for i in range(3) for j in range(3)})
    t = la.scale(la.matvec(rotation(), la.vec("px", "py", "pz")), -1.0)
    return one.select(
        *keys(run), F.when(good, "estimated").otherwise("not_estimated").alias("status"), F.when(~good, F.concat(F.lit("quality gate not passed: "), F.col("failed"))).alias("reason"), "centre_method",
        F.col("n").alias("num_cameras"), "planarity", F.col("arc_deg").alias("arc_coverage_deg"), "sign_agreement", *R, *(x.alias(c) for x, c in zip(t, T)),
    )
