"""Queries over cameras, transforms and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitspark.functions import linalg as la
from orbitspark.operators import cameras as cam
from orbitspark.operators import cloud as cl
from orbitspark.operators import visibility as vis
from orbitspark.plans.book import Book, r6, rounded, s6
from orbitspark.plans.views import CAMERAS, CLOUD, cameras, cameras_sql, cloud, table, transform

QUERIES = query = Book()
IJ = [(i, j) for i in range(3) for j in range(3)]
MOVE = "mv AS (SELECT 0.6::DOUBLE AS a00, -0.8::DOUBLE AS a01, 0.0::DOUBLE AS a02, 0.8::DOUBLE AS a10, 0.6::DOUBLE AS a11, 0.0::DOUBLE AS a12, 0.0::DOUBLE AS a20, 0.0::DOUBLE AS a21, 1.0::DOUBLE AS a22, 1.0::DOUBLE AS a0, -2.0::DOUBLE AS a1, 0.5::DOUBLE AS a2)"


def r4(c, name):
    c = F.col(c) if isinstance(c, str) else c
    return rounded(c, 4).alias(name)


def s4(expr: str, name: str) -> str:
    return f"round({expr}, 4) + 0.0::DOUBLE AS {name}"


QUATS = """qq AS (SELECT s_suppkey AS k, 1.0::DOUBLE + s_suppkey % 7 AS w, CAST(s_suppkey % 5 AS DOUBLE) - 2 AS x, CAST(s_suppkey % 3 AS DOUBLE) - 1 AS y, CAST(s_suppkey % 11 AS DOUBLE) / 4 AS z FROM supplier),
q AS (SELECT k, w / n AS w, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM qq)),
m AS (SELECT *, 1 - 2 * (y * y + z * z) AS m00, 2 * (x * y - w * z) AS m01, 2 * (x * z + w * y) AS m02, 2 * (x * y + w * z) AS m10, 1 - 2 * (x * x + z * z) AS m11, 2 * (y * z - w * x) AS m12, 2 * (x * z - w * y) AS m20, 2 * (y * z + w * x) AS m21, 1 - 2 * (x * x + y * y) AS m22 FROM q)"""


def quaternions(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), (F.lit(1.0) + k % 7).alias("w"), ((k % 5).cast("double") - 2).alias("x"), ((k % 3).cast("double") - 1).alias("y"), ((k % 11).cast("double") / 4).alias("z"))


@query(f"WITH {QUATS} SELECT k, {', '.join(s6(f'm{i}{j}', f'm{i}{j}') for i, j in IJ)} FROM m")
def q_quat_to_r(spark, sf_dir):
    m = la.quaternion_to_matrix(*(F.col(c) for c in "wxyz"))
    return quaternions(spark, sf_dir).select("k", *(r6(m[i][j], f"m{i}{j}") for i, j in IJ))


@query(f"WITH {QUATS} SELECT k, {', '.join(s6(f'sign(w) * {c}', f'q{c}') for c in 'wxyz')} FROM q")
def q_r_to_quat(spark, sf_dir):
    m = la.quaternion_to_matrix(*(F.col(c) for c in "wxyz"))
    rows = quaternions(spark, sf_dir).select("k", *(m[i][j].alias(f"m{i}{j}") for i, j in IJ))
    q = la.matrix_to_quaternion(la.mat([f"m{i}{j}" for i, j in IJ]))
    return rows.select("k", *(r6(x, f"q{c}") for x, c in zip(q, "wxyz")))


@query(f"WITH {CAMERAS} SELECT k, {s6('cx', 'cx')}, {s6('cy', 'cy')}, {s6('cz', 'cz')}, {s6('ux', 'ux')}, {s6('uy', 'uy')}, {s6('uz', 'uz')}, {s6('r20', 'fx')}, {s6('r21', 'fy')}, {s6('r22', 'fz')} FROM centres")
def q_camera_centers(spark, sf_dir):
    parts = [*zip(cam.centre(), ("cx", "cy", "cz")), *zip(cam.up(), ("ux", "uy", "uz")), *zip(cam.forward(), ("fx", "fy", "fz"))]
    return cameras(spark, sf_dir).select("k", *(r6(c, n) for c, n in parts))


@query(f"WITH {CLOUD}, {MOVE} SELECT point_id, {', '.join(s6(f'a{i}0 * x + a{i}1 * y + a{i}2 * z + a{i}', 'xyz'[i]) for i in range(3))} FROM cloud, mv")
def q_transform_points(spark, sf_dir):
    return cam.transform_points(cloud(spark, sf_dir), transform(spark)).select("point_id", *(r6(c, c) for c in "xyz"))


POSES = CAMERAS + f", {MOVE}, moved AS (SELECT k, " + ", ".join(f"r{i}0 * a{j}0 + r{i}1 * a{j}1 + r{i}2 * a{j}2 AS m{i}{j}" for i, j in IJ) + ", t0, t1, t2, a0, a1, a2 FROM cams, mv)"


@query(f"WITH {POSES} SELECT k, {', '.join(s6(f'm{i}{j}', f'r{i}{j}') for i, j in IJ)}, {', '.join(s6(f't{i} - (m{i}0 * a0 + m{i}1 * a1 + m{i}2 * a2)', f't{i}') for i in range(3))} FROM moved")
def q_transform_poses(spark, sf_dir):
    return cam.transform_poses(cameras(spark, sf_dir), transform(spark)).select("k", *(r6(c, c) for c in cam.R + cam.T))


@query(f"WITH {POSES} SELECT k, {', '.join(s6(f'm{j}{i}', f'r{i}{j}') for i, j in IJ)}, {', '.join(s6('-(' + ' + '.join(f'm{j}{i} * (t{j} - (m{j}0 * a0 + m{j}1 * a1 + m{j}2 * a2))' for j in range(3)) + ')', f't{i}') for i in range(3))} FROM moved")
def q_invert(spark, sf_dir):
    """Camera-to-world poses of all cameras of the moved world."""
    moved = cam.transform_poses(cameras(spark, sf_dir), transform(spark))
    return cam.invert_transform(moved).select("k", *(r6(c, c) for c in cam.R + cam.T))


SCALED = CLOUD + """, pts AS (SELECT point_id, (x - 150) / 300 AS x, (y - 48) / 97 AS y, (z - 1200) / 2400 AS z FROM cloud)"""


def scaled_points(spark, sf_dir, *more):
    """The whole cloud, scaled into the ring, with ``more`` of its columns."""
    c = cloud(spark, sf_dir)
    return c.select("point_id", *more, ((F.col("x") - 150) / 300).alias("x"), ((F.col("y") - 48) / 97).alias("y"), ((F.col("z") - 1200) / 2400).alias("z"))


def seeing_cameras(spark, sf_dir):
    return cameras(spark, sf_dir).withColumns({"fx": F.lit(500.0), "fy": F.lit(520.0), "cx": F.lit(320.0), "cy": F.lit(240.0)})


VIEW = CAMERAS + ", " + SCALED + """, cc AS (SELECT k, point_id, r00 * x + r01 * y + r02 * z + t0 AS vx, r10 * x + r11 * y + r12 * z + t1 AS vy, r20 * x + r21 * y + r22 * z + t2 AS depth FROM cams, pts),
proj AS (SELECT k, point_id, depth, 500 * vx / depth + 320 AS u, 520 * vy / depth + 240 AS v FROM cc)"""


@query(f"WITH {VIEW} SELECT k, point_id, depth > 0 AS valid, {s4('CASE WHEN depth > 0 THEN u END', 'u')}, {s4('CASE WHEN depth > 0 THEN v END', 'v')}, {s4('depth', 'depth')} FROM proj")
def q_project(spark, sf_dir):
    seen = cam.project(scaled_points(spark, sf_dir), seeing_cameras(spark, sf_dir))
    return seen.select("k", "point_id", "valid", r4("u", "u"), r4("v", "v"), r4("depth", "depth"))


@query(f"""WITH {VIEW}, obs AS (SELECT k, point_id FROM proj WHERE depth > 1e-6 AND u >= 0 AND u < 640 AND v >= 0 AND v < 480)
SELECT point_id, count(*) AS track_length, array_to_string(list_sort(list(k)), ',') AS seen_by FROM obs GROUP BY point_id""")
def q_observations_tracks(spark, sf_dir):
    """A set of cameras is written out once for all the points of a slice that it sees."""
    t = vis.sets_of(scaled_points(spark, sf_dir), pictured(seeing_cameras(spark, sf_dir))).select("points", "track_length", F.array_join("seen_by", ",").alias("seen_by"))
    return t.select(F.explode("points").alias("point_id"), "track_length", "seen_by")


def pictured(cams):
    return cams.withColumns({"width": F.lit(640), "height": F.lit(480)})


#: The cloud thirty times as wide, so that the cameras stand within it and each sees a part.
AROUND = CAMERAS + ", " + CLOUD + """, pts AS (SELECT point_id, (x - 150) / 10 AS x, (y - 48) * 30 / 97 AS y, (z - 1200) / 80 AS z FROM cloud),
cc AS (SELECT k, point_id, r00 * x + r01 * y + r02 * z + t0 AS vx, r10 * x + r11 * y + r12 * z + t1 AS vy, r20 * x + r21 * y + r22 * z + t2 AS depth FROM cams, pts),
proj AS (SELECT k, point_id, depth, 900 * vx / depth + 320 AS u, 900 * vy / depth + 240 AS v FROM cc WHERE depth > 1e-6), seen AS (SELECT * FROM proj WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480)"""


def around(spark, sf_dir):
    c = cloud(spark, sf_dir).select("point_id", ((F.col("x") - 150) / 10).alias("x"), ((F.col("y") - 48) * 30 / 97).alias("y"), ((F.col("z") - 1200) / 80).alias("z"))
    return c, pictured(seeing_cameras(spark, sf_dir)).withColumns({"fx": F.lit(900.0), "fy": F.lit(900.0)})


@query(f"WITH {AROUND} SELECT k, count(*) AS n_points, {s4('avg(depth)', 'mean_depth')}, {', '.join(s4(f'{f}({c})', f'{f}_{c}') for f in ('min', 'max') for c in 'uv')} FROM seen GROUP BY k")
def q_pictures(spark, sf_dir):
    """What each of all cameras sees of the whole cloud around it; about a sixth of the pairs are tested."""
    p = vis.pictures_of(*around(spark, sf_dir))
    return p.select("k", "n_points", r4("mean_depth", "mean_depth"), *(r4(f"{f}_{c}", f"{f}_{c}") for f in ("min", "max") for c in "uv"))


@query(f"WITH {AROUND} SELECT point_id, count(*) AS track_length, min(k) AS first_camera, max(k) AS last_camera FROM seen GROUP BY point_id")
def q_tracks_around(spark, sf_dir):
    return vis.spans_of(*around(spark, sf_dir))


@query("""WITH n AS (SELECT n_nationkey AS k, 2.0::DOUBLE + n_nationkey % 4 AS d, radians(n_nationkey * 30.0::DOUBLE) AS a, radians(n_nationkey % 5 * 15.0::DOUBLE) AS e FROM nation)
SELECT k, round(d * cos(e) * sin(a), 6) + 0.0::DOUBLE AS x, round(d * sin(e), 6) + 0.0::DOUBLE AS y, round(d * cos(e) * cos(a), 6) + 0.0::DOUBLE AS z, round(d * 1.12::DOUBLE / sin(radians(17.5::DOUBLE)), 6) AS framing FROM n""")
def q_orbit_camera(spark, sf_dir):
    k = F.col("n_nationkey")
    d = F.lit(2.0) + k % 4
    p = cam.orbit_position(d, k * F.lit(30.0), k % 5 * F.lit(15.0))
    return table(spark, sf_dir, "nation").select(k.alias("k"), *(r6(c, n) for c, n in zip(p, "xyz")), F.round(cam.framing_distance(d), 6).alias("framing"))


@query(f"WITH {CAMERAS} SELECT k, {', '.join(s6(f'r{i}{j}', f'r{i}{j}') for i, j in IJ)}, {', '.join(s6(f't{i}', f't{i}') for i in range(3))} FROM cams")
def q_look_at(spark, sf_dir):
    at = cameras(spark, sf_dir).select("k", *(c.alias(f"p{a}") for c, a in zip(cam.centre(), "xyz")))
    posed = cam.look_at(at, la.lit3(0, 0, 0), la.lit3(0, 0, 1))
    return posed.select("k", *(r6(c, c) for c in cam.R + cam.T))


#: All cameras within three fifths of a ring that is tilted by sixty degrees about x, so that nothing is axis-aligned.
TILT_SQL = cameras_sql(0.6) + """, part_ring AS (SELECT k, cx, 0.5::DOUBLE * cy - sqrt(0.75) * cz AS cy, sqrt(0.75) * cy + 0.5::DOUBLE * cz AS cz, ux, 0.5::DOUBLE * uy - sqrt(0.75) * uz AS uy, sqrt(0.75) * uy + 0.5::DOUBLE * uz AS uz,
 r20 AS fx, 0.5::DOUBLE * r21 - sqrt(0.75) * r22 AS fy, sqrt(0.75) * r21 + 0.5::DOUBLE * r22 AS fz, (SELECT count(*) FROM cams) AS total FROM centres),
arc_ring AS (SELECT * FROM part_ring),
mo AS (SELECT count(*) AS n, avg(cx) AS mx, avg(cy) AS my, avg(cz) AS mz, avg(ux) AS ux, avg(uy) AS uy, avg(uz) AS uz, var_pop(cx) AS xx, covar_pop(cx, cy) AS xy, covar_pop(cx, cz) AS xz, var_pop(cy) AS yy, covar_pop(cy, cz) AS yz, var_pop(cz) AS zz FROM arc_ring),
e1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM mo), e2 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM e1),
e3 AS (SELECT *, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 AS phi FROM e2),
e4 AS (SELECT *, q + 2 * p * cos(phi) AS v1, q + 2 * p * cos(phi + 2.0943951023931953) AS v3 FROM e3), e5 AS (SELECT *, 3 * q - v1 - v3 AS v2 FROM e4)"""


def tilted_ring(spark, sf_dir):
    return tilted(spark, cameras(spark, sf_dir, 0.6))


def tilted(spark, c):
    root = 0.75 ** 0.5
    turn = spark.range(1).select(*(F.lit(v).alias(f"r{i // 3}{i % 3}") for i, v in enumerate((1.0, 0.0, 0.0, 0.0, 0.5, -root, 0.0, root, 0.5))), *(F.lit(0.0).alias(f"t{i}") for i in range(3)))
    return cam.transform_poses(c, turn)


@query(f"WITH {TILT_SQL} SELECT n AS num_cameras, {s6('mx', 'cx')}, {s6('my', 'cy')}, {s6('mz', 'cz')}, {s4('sqrt(v1 * n)', 's1')}, {s4('sqrt(v2 * n)', 's2')}, {s4('sqrt(greatest(v3, 0)) / sqrt(v2)', 'planarity')}, {s4('0', 'nx')}, {s4('-sqrt(0.75)', 'ny')}, {s4('0.5', 'nz')} FROM e5")
def q_ring_plane(spark, sf_dir):
    p = cam.ring_plane(tilted_ring(spark, sf_dir))
    return p.select(F.col("n").alias("num_cameras"), r6("cx", "cx"), r6("cy", "cy"), r6("cz", "cz"), r4("s1", "s1"), r4("s2", "s2"), r4("planarity", "planarity"), r4("nx", "nx"), r4("ny", "ny"), r4("nz", "nz"))


@query("""WITH a AS (SELECT s_nationkey, (s_suppkey * 37 % 360) * 1.0::DOUBLE AS angle FROM supplier),
g AS (SELECT s_nationkey, coalesce(lead(angle) OVER w, first_value(angle) OVER w + 360) - angle AS gap FROM a WINDOW w AS (PARTITION BY s_nationkey ORDER BY angle ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT s_nationkey, CASE WHEN count(*) < 2 THEN 0.0::DOUBLE ELSE 360 - max(gap) END AS arc_deg FROM g GROUP BY s_nationkey""")
def q_arc_coverage(spark, sf_dir):
    angles = table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") * 37 % 360).cast("double").alias("angle"))
    return cam.widest_gap(angles, "s_nationkey")


RAYS = TILT_SQL + """, ra AS (SELECT count(*) AS n, sum(1 - fx * fx) AS a, sum(-fx * fy) AS b, sum(-fx * fz) AS c, sum(1 - fy * fy) AS d, sum(-fy * fz) AS e, sum(1 - fz * fz) AS f,
 sum(cx - fx * (cx * fx + cy * fy + cz * fz)) AS g, sum(cy - fy * (cx * fx + cy * fy + cz * fz)) AS h, sum(cz - fz * (cx * fx + cy * fy + cz * fz)) AS i FROM arc_ring),
sol AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS dt FROM ra)"""


@query(f"WITH {RAYS} SELECT n AS num_rays, {s6('(g * (d * f - e * e) - b * (h * f - e * i) + c * (h * e - d * i)) / dt', 'px')}, {s6('(a * (h * f - e * i) - g * (b * f - e * c) + c * (b * i - h * c)) / dt', 'py')}, {s6('(a * (d * i - h * e) - b * (b * i - h * c) + g * (b * e - d * c)) / dt', 'pz')} FROM sol")
def q_nearest_point_rays(spark, sf_dir):
    c = tilted_ring(spark, sf_dir)
    rays = c.select(*(x.alias(f"o{a}") for x, a in zip(cam.centre(), "xyz")), *(x.alias(f"d{a}") for x, a in zip(cam.forward(), "xyz")))
    p = cam.nearest_point_to_rays(rays)
    return p.select(F.col("n").alias("num_rays"), r6("px", "px"), r6("py", "py"), r6("pz", "pz"))


#: The tilted ring lies 3 wide and 1 high above its centre; its azimuths are those of the plain ring, and up agrees by 3/sqrt(10).
@query(f"""WITH {TILT_SQL}, az AS (SELECT k, 216.0::DOUBLE * k / total AS angle FROM arc_ring), gaps AS (SELECT coalesce(lead(angle) OVER (ORDER BY angle), min(angle) OVER () + 360) - angle AS gap FROM az),
q AS (SELECT n, sqrt(greatest(v3, 0)) / sqrt(v2) AS planarity, (SELECT 360 - max(gap) FROM gaps) AS arc FROM e5),
o AS (SELECT arg_min(c, k) AS c, arg_min(s, k) AS s FROM ring), r AS (SELECT -s AS r00, 0.5::DOUBLE * c AS r01, sqrt(0.75) * c AS r02, 0.0::DOUBLE AS r10, -sqrt(0.75) AS r11, 0.5::DOUBLE AS r12, c AS r20, 0.5::DOUBLE * s AS r21, sqrt(0.75) * s AS r22, 0.0::DOUBLE AS t0, 0.0::DOUBLE AS t1, 0.0::DOUBLE AS t2 FROM o)
SELECT CASE WHEN n >= 6 AND planarity <= 0.25 AND arc >= 180 THEN 'estimated' ELSE 'not_estimated' END AS status, 'optical_axes' AS centre_method, n AS num_cameras, {s4('planarity', 'planarity')}, {s4('arc', 'arc_coverage_deg')}, {s4('3 / sqrt(10.0)', 'sign_agreement')},
       {', '.join(s4(x, x) for x in cam.R + cam.T)} FROM q, r""")
def q_alignment(spark, sf_dir):
    """The first camera goes to +Z and the ring's normal to +Y; the axes meet in the origin, so nothing is shifted."""
    a = cam.estimate_alignment(tilted_ring(spark, sf_dir))
    return a.select("status", "centre_method", "num_cameras", r4("planarity", "planarity"), r4("arc_coverage_deg", "arc_coverage_deg"), r4("sign_agreement", "sign_agreement"), *(r4(F.col(c), c) for c in cam.R + cam.T))


#: Four runs, each with its own part of the circle; the second one's is too short to be aligned.
ARCS = "(CASE s_suppkey % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.3 WHEN 2 THEN 1.0 ELSE 0.8 END)"
RUNS_SQL = TILT_SQL.replace("0.6::DOUBLE * s_suppkey", f"{ARCS}::DOUBLE * s_suppkey").replace("mo AS (SELECT count(*) AS n", "mo AS (SELECT k % 4 AS run_id, count(*) AS n").replace("FROM arc_ring),\ne1", "FROM arc_ring GROUP BY k % 4),\ne1")


@query(f"""WITH {RUNS_SQL}, az AS (SELECT s_suppkey % 4 AS run_id, 360 * {ARCS}::DOUBLE * s_suppkey / count(*) OVER () AS angle FROM supplier),
turned AS (SELECT run_id, CASE WHEN angle >= 360 THEN angle - 360 ELSE angle END AS angle FROM az),
gaps AS (SELECT run_id, coalesce(lead(angle) OVER (PARTITION BY run_id ORDER BY angle), min(angle) OVER (PARTITION BY run_id) + 360) - angle AS gap FROM turned), arcs AS (SELECT run_id, 360 - max(gap) AS arc FROM gaps GROUP BY run_id),
q AS (SELECT run_id, n, sqrt(greatest(v3, 0)) / sqrt(v2) AS planarity, arc FROM e5 JOIN arcs USING (run_id)),
o AS (SELECT k % 4 AS run_id, arg_min(c, k) AS c, arg_min(s, k) AS s FROM ring GROUP BY k % 4),
good AS (SELECT *, n >= 6 AND planarity <= 0.25 AND arc >= 180 AS good FROM q JOIN o USING (run_id))
SELECT run_id, CASE WHEN good THEN 'estimated' ELSE 'not_estimated' END AS status, 'optical_axes' AS centre_method, n AS num_cameras, {s4('CASE WHEN n >= 6 THEN planarity END', 'planarity')}, {s4('CASE WHEN n >= 6 THEN arc END', 'arc_coverage_deg')},
       {', '.join(s4(f'CASE WHEN good THEN {a} ELSE {b} END', x) for x, a, b in zip(cam.R, ('-s', '0.5::DOUBLE * c', 'sqrt(0.75) * c', '0', '-sqrt(0.75)', '0.5', 'c', '0.5::DOUBLE * s', 'sqrt(0.75) * s'), (1, 0, 0, 0, 1, 0, 0, 0, 1)))}, {', '.join(s4('0', x) for x in cam.T)} FROM good""")
def q_alignment_by_run(spark, sf_dir):
    """All cameras as four runs, aligned in one job; planarity and arc are stated for runs of six cameras or more, fewer may have no plane."""
    run = F.col("k") % 4
    rings = cameras(spark, sf_dir, F.when(run == 0, 0.6).when(run == 1, 0.3).when(run == 2, 1.0).otherwise(0.8))
    a = cam.estimate_alignment(tilted(spark, rings).withColumn("run_id", run), run="run_id")
    many = F.col("num_cameras") >= 6
    return a.select("run_id", "status", "centre_method", "num_cameras", *(r4(F.when(many, F.col(c)), c) for c in ("planarity", "arc_coverage_deg")), *(r4(F.col(c), c) for c in cam.R + cam.T))


@query()
def q_aligned_cloud_bbox(spark, sf_dir):
    """All cameras, squeezed into three fifths of the ring, and the whole cloud aligned, outliers dropped in the aligned world, and its box."""
    points = scaled_points(spark, sf_dir)
    a = cam.estimate_alignment(tilted(spark, cameras(spark, sf_dir, 0.6)), points)
    moved = cam.transform_points(points, a)
    return cl.bounding_box(cl.filter_outliers(moved))
