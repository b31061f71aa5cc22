"""Queries over point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitspark.operators import cloud as cl
from orbitspark.plans.book import Book, r6, s6
from orbitspark.plans.views import CLOUD, FLAWED, cloud, flawed_cloud, table

QUERIES = query = Book()
AXES = "xyz"
BOUNDS = FLAWED + ", quart AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS l{c}, quantile_cont({c}, 0.75) AS h{c}" for c in AXES) + " FROM valid), bounds AS (SELECT " + ", ".join(
    f"l{c} - 3.0::DOUBLE * (h{c} - l{c}) AS lo_{c}, h{c} + 3.0::DOUBLE * (h{c} - l{c}) AS hi_{c}" for c in AXES) + " FROM quart), kept AS (SELECT valid.* FROM valid, bounds WHERE " + " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in AXES) + ")"


@query(f"WITH {FLAWED} SELECT point_id FROM valid")
def q_valid_points(spark, sf_dir):
    return flawed_cloud(spark, sf_dir).where(cl.is_valid_point()).select("point_id")


@query(f"WITH {BOUNDS} SELECT point_id, {', '.join(s6(c, c) for c in AXES)} FROM kept")
def q_iqr_filter(spark, sf_dir):
    return cl.filter_outliers(flawed_cloud(spark, sf_dir)).select("point_id", *(r6(c, c) for c in AXES))


@query(f"""WITH {BOUNDS} SELECT (SELECT count(*) FROM flawed) AS n_total, (SELECT count(*) FROM valid) AS n_finite, (SELECT count(*) FROM kept) AS n_kept, {', '.join(s6(f'{b}_{c}', f'{b}_{c}') for c in AXES for b in ('lo', 'hi'))} FROM bounds""")
def q_iqr_info(spark, sf_dir):
    info = cl.outlier_info(flawed_cloud(spark, sf_dir))
    return info.select("n_total", "n_finite", "n_kept", *(r6(f"{b}_{c}", f"{b}_{c}") for c in AXES for b in ("lo", "hi")))


@query("""WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS l1, quantile_cont(l_quantity, 0.75) AS h1, quantile_cont(l_extendedprice / 1000, 0.25) AS l2, quantile_cont(l_extendedprice / 1000, 0.75) AS h2, quantile_cont(l_discount * 100, 0.25) AS l3, quantile_cont(l_discount * 100, 0.75) AS h3 FROM lineitem)
SELECT count(*) AS n_total, count(*) AS n_finite, count(*) FILTER (l_quantity BETWEEN l1 - 0.5::DOUBLE * (h1 - l1) AND h1 + 0.5::DOUBLE * (h1 - l1) AND l_extendedprice / 1000 BETWEEN l2 - 0.5::DOUBLE * (h2 - l2) AND h2 + 0.5::DOUBLE * (h2 - l2) AND l_discount * 100 BETWEEN l3 - 0.5::DOUBLE * (h3 - l3) AND h3 + 0.5::DOUBLE * (h3 - l3)) AS n_kept FROM lineitem, q""")
def q_iqr_heavy(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))
    return cl.outlier_info(points, 0.5).select("n_total", "n_finite", "n_kept")


@query(f"WITH {BOUNDS} SELECT count(*) AS n_points, {', '.join(s6(f'{f}({c})', f'{f}_{c}') for f in ('min', 'max') for c in AXES)}, CASE WHEN count(*) = 0 THEN 'no finite points' END AS reason FROM kept")
def q_bbox(spark, sf_dir):
    box = cl.bounding_box(cl.filter_outliers(flawed_cloud(spark, sf_dir)))
    return box.select("n_points", *(r6(f"{f}_{c}", f"{f}_{c}") for f in ("min", "max") for c in AXES), "reason")


EXTENT = FLAWED + ", mid AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz FROM valid)"


@query(f"WITH {EXTENT} SELECT {s6('any_value(mx)', 'cx')}, {s6('any_value(my)', 'cy')}, {s6('any_value(mz)', 'cz')}, {s6('quantile_cont(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 0.98)', 'radius')} FROM valid, mid")
def q_robust_extent(spark, sf_dir):
    return cl.robust_extent(flawed_cloud(spark, sf_dir)).select(r6("cx", "cx"), r6("cy", "cy"), r6("cz", "cz"), r6("radius", "radius"))


def voxels(source: str, size: str) -> str:
    return f"""low AS (SELECT min(x) AS bx, min(y) AS by_, min(z) AS bz FROM {source}),
vox AS (SELECT v.*, floor((x - bx) / {size}) AS i, floor((y - by_) / {size}) AS j, floor((z - bz) / {size}) AS k, bx, by_, bz FROM {source} v, low),
near AS (SELECT *, 0.0::DOUBLE + (x - bx - (i + 0.5::DOUBLE) * {size}) * (x - bx - (i + 0.5::DOUBLE) * {size}) + (y - by_ - (j + 0.5::DOUBLE) * {size}) * (y - by_ - (j + 0.5::DOUBLE) * {size}) + (z - bz - (k + 0.5::DOUBLE) * {size}) * (z - bz - (k + 0.5::DOUBLE) * {size}) AS dist2 FROM vox)"""


@query(f"WITH {CLOUD}, {voxels('cloud', '40.0::DOUBLE')} SELECT count(*) AS n_voxels FROM (SELECT DISTINCT i, j, k FROM vox)")
def q_voxel_count(spark, sf_dir):
    return cl.with_voxels(cloud(spark, sf_dir), 40.0).select("i", "j", "k").distinct().agg(F.count("*").alias("n_voxels"))


@query(f"WITH {CLOUD}, {voxels('cloud', '40.0::DOUBLE')} SELECT arg_min(point_id, (dist2, point_id)) AS point_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k, count(*) AS n_in_voxel FROM near GROUP BY i, j, k")
def q_voxel_representatives(spark, sf_dir):
    return cl.voxel_representatives(cloud(spark, sf_dir), 40.0).select("point_id", "i", "j", "k", "n_in_voxel")


SEEN = CLOUD + """, seen AS (SELECT point_id, r, g, b, z + 10 AS depth, CAST(round_even(x, 0) AS BIGINT) AS px, CAST(round_even(y, 0) AS BIGINT) AS py FROM cloud)"""


def seen(spark, sf_dir):
    """The cloud on a pixel grid, looking along z."""
    c = cloud(spark, sf_dir)
    return c.select("point_id", "r", "g", "b", (F.col("z") + 10).alias("depth"), F.rint("x").cast("long").alias("px"), F.rint("y").cast("long").alias("py"))


@query(f"WITH {SEEN} SELECT px, py, arg_min(point_id, (depth, point_id)) AS point_id, min(depth) AS depth FROM seen GROUP BY px, py")
def q_zbuffer(spark, sf_dir):
    return cl.nearest_per_pixel(seen(spark, sf_dir)).select("px", "py", "point_id", "depth")


@query(f"""WITH {SEEN}, o AS (SELECT dx, dy FROM range(-3, 4) a(dx), range(-3, 4) b(dy) WHERE dx * dx + dy * dy <= 2.2 * 2.2 + 1e-9),
s AS (SELECT point_id, depth, px + dx AS px, py + dy AS py FROM seen, o WHERE px + dx BETWEEN 0 AND 127 AND py + dy BETWEEN 0 AND 95)
SELECT px, py, arg_min(point_id, (depth, point_id)) AS point_id FROM s GROUP BY px, py""")
def q_splat(spark, sf_dir):
    """Points whose disk misses the picture go first, then all but the nearest of those with one middle; only then are disks spread out."""
    s = seen(spark, sf_dir).where("px between -3 and 130 and py between -3 and 98")
    s = cl.nearest_per_pixel(s).withColumn("o", F.explode(cl.disk_offsets(2.2)))
    s = s.select("point_id", "depth", (F.col("px") + F.col("o.dx")).alias("px"), (F.col("py") + F.col("o.dy")).alias("py"))
    return cl.nearest_per_pixel(s.where("px between 0 and 127 and py between 0 and 95")).select("px", "py", "point_id")


@query(f"""WITH {SEEN}, e AS (SELECT quantile_cont(depth, 0.02) AS near, quantile_cont(depth, 0.98) AS far FROM seen)
SELECT point_id, {s6('1 - 0.35::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (depth - near) / greatest(far - near, 1e-9)))', 'shade')} FROM seen, e""")
def q_depth_shade(spark, sf_dir):
    return cl.shade_by_depth(seen(spark, sf_dir)).select("point_id", r6("shade", "shade"))


RUNS = FLAWED + ", runs AS (SELECT *, point_id % 7 AS run_id FROM flawed), valid_runs AS (SELECT *, point_id % 7 AS run_id FROM valid)"
QUARTS = ", quart AS (SELECT run_id, " + ", ".join(f"quantile_cont({c}, 0.25) AS l{c}, quantile_cont({c}, 0.75) AS h{c}" for c in AXES) + " FROM valid_runs GROUP BY run_id), bounds AS (SELECT run_id, " + ", ".join(
    f"l{c} - 3.0::DOUBLE * (h{c} - l{c}) AS lo_{c}, h{c} + 3.0::DOUBLE * (h{c} - l{c}) AS hi_{c}" for c in AXES) + " FROM quart)"


def clouds(spark, sf_dir):
    """The flawed cloud as seven runs."""
    return flawed_cloud(spark, sf_dir).withColumn("run_id", F.col("point_id") % 7)


@query(f"WITH {RUNS}{QUARTS} SELECT run_id, point_id FROM valid_runs JOIN bounds USING (run_id) WHERE {' AND '.join(f'{c} BETWEEN lo_{c} AND hi_{c}' for c in AXES)}")
def q_iqr_by_run(spark, sf_dir):
    return cl.filter_outliers(clouds(spark, sf_dir), 3.0, "run_id").select("run_id", "point_id")


@query(f"WITH {RUNS}{QUARTS} SELECT run_id, count(*) AS n_total, count(*) FILTER (isfinite(x) AND isfinite(y) AND isfinite(z)) AS n_finite, count(*) FILTER ({' AND '.join(f'isfinite({c}) AND {c} BETWEEN lo_{c} AND hi_{c}' for c in AXES)}) AS n_kept, {', '.join(s6(f'any_value({b}_{c})', f'{b}_{c}') for c in AXES for b in ('lo', 'hi'))} FROM runs JOIN bounds USING (run_id) GROUP BY run_id")
def q_outliers_by_run(spark, sf_dir):
    info = cl.outlier_info(clouds(spark, sf_dir), 3.0, "run_id")
    return info.select("run_id", "n_total", "n_finite", "n_kept", *(r6(f"{b}_{c}", f"{b}_{c}") for c in AXES for b in ("lo", "hi")))


@query(f"""WITH {RUNS}, mid AS (SELECT run_id, median(x) AS mx, median(y) AS my, median(z) AS mz FROM valid_runs GROUP BY run_id)
SELECT run_id, {s6('any_value(mx)', 'cx')}, {s6('any_value(my)', 'cy')}, {s6('any_value(mz)', 'cz')}, {s6('quantile_cont(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 0.98)', 'radius')} FROM valid_runs JOIN mid USING (run_id) GROUP BY run_id""")
def q_extent_by_run(spark, sf_dir):
    return cl.robust_extent(clouds(spark, sf_dir), 98.0, "run_id").select("run_id", r6("cx", "cx"), r6("cy", "cy"), r6("cz", "cz"), r6("radius", "radius"))


@query(f"""WITH {SEEN}, v AS (SELECT *, point_id % 5 AS view FROM seen), e AS (SELECT view, quantile_cont(depth, 0.02) AS near, quantile_cont(depth, 0.98) AS far FROM v GROUP BY view)
SELECT view, point_id, {s6('1 - 0.35::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (depth - near) / greatest(far - near, 1e-9)))', 'shade')} FROM v JOIN e USING (view)""")
def q_depth_shade_by_view(spark, sf_dir):
    return cl.shade_by_depth(seen(spark, sf_dir).withColumn("view", F.col("point_id") % 5), view="view").select("view", "point_id", r6("shade", "shade"))
