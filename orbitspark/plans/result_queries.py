"""Queries over what results say: statuses, warnings, checks, experiments, exports; and over views of a scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitspark.operators import cameras as cam
from orbitspark.operators import cloud as cl
from orbitspark.operators import results as rs
from orbitspark.operators import scenes
from orbitspark.operators import runs as rn
from orbitspark.plans.book import Book, r6, s6
from orbitspark.plans.camera_queries import scaled_points
from orbitspark.plans.run_queries import COUNTS, EXPERIMENTS, counts, experiments
from orbitspark.plans.views import CAMERAS, CLOUD, FLAWED, cameras, cloud, flawed_cloud, table
from orbitspark.sources.run_folders import package_plan

QUERIES = query = Book()
FEW = "'cameras with a known place: ' || cams || ' of ' || frames_ || ' (' || CAST(floor(coalesce(CAST(cams AS DOUBLE) / nullif(frames_, 0), 0) * 100 + 0.5) AS BIGINT) || '%)'"
BANNER = "(CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rn.BANNERS.items()) + f" END) || CASE WHEN example THEN ' · {rn.EXAMPLE}' ELSE '' END"


@query(f"WITH {COUNTS} SELECT run_id, status, status IN ('success', 'partial') AS viewable, status IN ('success', 'partial') AS exportable, {BANNER} AS banner, CASE WHEN status = 'partial' THEN {FEW} END AS message FROM st")
def q_build_status(spark, sf_dir):
    """Without warnings of its own, only a partial result carries one."""
    rows = counts(spark, sf_dir)
    none = F.array().cast(f"array<{rs.WARNING}>")
    cols = rs.build_status(F.col("status"), none, F.col("cams"), F.col("frames"), F.col("example"), F.lit(None).cast("string"))
    return rows.select("run_id", *(c.alias(n) for n, c in cols.items())).select("run_id", "status", "viewable", "exportable", "banner", F.get("warnings", F.lit(0))["message"].alias("message"))


NUMBERS = """n AS (SELECT user_id AS run_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS rejected, CAST(count(*) % 5 AS DOUBLE) / 100 AS diversity, CAST(count(*) % 11 AS DOUBLE) AS seconds,
 count(*) FILTER (event_type = 'purchase') AS cams, count(*) FILTER (event_type IN ('purchase', 'click')) AS frames_, max(event_id) % 3 = 0 AS dull FROM events GROUP BY user_id)"""


@query(f"""WITH {NUMBERS} SELECT run_id, code, message, true AS observation_only FROM (
SELECT run_id, 'many_blurry_frames' AS code, 'blurry frames: ' || rejected || ' of ' || total || ' left out for sharpness (' || CAST(floor(CAST(rejected AS DOUBLE) / total * 100 + 0.5) AS BIGINT) || '%)' AS message FROM n WHERE CAST(rejected AS DOUBLE) / total >= 0.3
UNION ALL SELECT run_id, 'low_viewpoint_diversity', 'selected neighbours are alike: median difference ' || printf('%.4f', diversity) FROM n WHERE diversity <= 0.02
UNION ALL SELECT run_id, 'short_video', 'short video: ' || printf('%.1f', seconds) || ' s' FROM n WHERE seconds < 5
UNION ALL SELECT run_id, 'few_registered_cameras', {FEW} FROM n WHERE coalesce(CAST(cams AS DOUBLE) / nullif(frames_, 0), 0) <= 0.6
UNION ALL SELECT run_id, 'background_dominates', 'most points belong to the background' FROM n WHERE dull
UNION ALL SELECT run_id, 'orientation_not_estimated', 'the vertical is not estimated: too few cameras' FROM n WHERE cams < 6)""")
def q_warning_structs(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"))
    kind = F.col("event_type")
    n = e.agg(
        F.count("*").alias("total"), F.count_if(kind == "view").alias("rejected"), F.count_if(kind == "purchase").alias("cams"), F.count_if(kind.isin("purchase", "click")).alias("frames"), (F.max("event_id") % 3 == 0).alias("dull")
    )
    seen = rs.observed_warnings(F.col("rejected"), F.col("total"), (F.col("total") % 5).cast("double") / 100, (F.col("total") % 11).cast("double"), F.col("cams"), F.col("frames"))
    null = F.lit(None).cast("string")
    stated = rs.stated_warnings(null, F.col("dull"), null, F.when(F.col("cams") < 6, "too few cameras"))
    return n.select("run_id", F.explode(rs.merge_warnings(rs.merge_warnings(seen, stated), seen)).alias("w")).select("run_id", "w.*")


PAIRS = EXPERIMENTS + ", e AS (SELECT exp_id || '-' || pair AS exp_id, pair, b, v, r, br, vr, bd, vd FROM x)"


def runs_of(spark, sf_dir):
    """Three runs an experiment; some have the wrong branch, another seed, no normalized result, or no repeat."""
    x = experiments(spark, sf_dir).withColumn("exp_id", F.concat_ws("-", "exp_id", "pair"))
    of = lambda role, n, ratio, bad: F.struct(F.lit(role).alias("role"), F.col(n).cast("double").alias("num_points_valid"), (F.col(ratio) if ratio else F.lit(None)).cast("double").alias("registration_ratio"), (F.col(bad) if bad else F.lit(None)).cast("double").alias("visual_check_defects"))
    rows = x.select("exp_id", "pair", F.explode(F.array(of("baseline", "b", "br", "bd"), of("variant", "v", "vr", "vd"), of("repeat", "r", None, None))).alias("s")).select("exp_id", "pair", "s.*")
    rows = rows.where("role <> 'repeat' or num_points_valid is not null").withColumn("run_id", F.concat_ws("/", "exp_id", "role"))
    variant = F.col("role") == "variant"
    return rows.withColumns({
        "selector": F.when(variant & (F.col("pair") % 7 != 0), rs.BRANCHES[1]).otherwise(rs.BRANCHES[0]), "normalized": ~((F.col("role") == "baseline") & (F.col("pair") % 5 == 4)),
        "video_sha256": F.lit("v"), "frame_budget": F.lit(48), "seed": F.when(variant & (F.col("pair") % 11 == 3), 7).otherwise(42), "code_id": F.lit("code"),
    })


def conditions_of(runs):
    return runs.groupBy("exp_id").agg((F.max("pair") % 2 == 0).alias("repeat_baseline")).select("exp_id", F.lit("v").alias("video_sha256"), F.lit(48).alias("frame_budget"), F.lit(42).alias("seed"), F.lit("code").alias("code_id"), "repeat_baseline", F.lit(1.10).alias("improvement_ratio"), F.lit(0.90).alias("regression_ratio"))


@query(f"""WITH {PAIRS}, why AS (SELECT *, concat_ws('; ', CASE WHEN pair % 11 = 3 THEN 'differs in seed' END, CASE WHEN pair % 5 = 4 THEN 'no normalized result' END, CASE WHEN pair % 2 = 0 AND r IS NULL THEN 'no repeat run' END, CASE WHEN pair % 7 = 0 THEN 'not the branch quality_nonredundant' END) AS reasons FROM e)
SELECT exp_id, reasons, CASE WHEN reasons = '' THEN 0 ELSE 9 END AS exit_code, CASE WHEN reasons <> '' THEN NULL WHEN coalesce(abs((CAST(r AS DOUBLE) - b) / nullif(b, 0)) >= abs((CAST(v AS DOUBLE) - b) / nullif(b, 0)), false) THEN 'inconclusive'
 WHEN v >= b * 1.10::DOUBLE AND coalesce(vr >= br, false) AND vd <= bd THEN 'improvement' WHEN v <= b * 0.90::DOUBLE OR coalesce(vr < br, false) OR vd > bd THEN 'regression' ELSE 'no_difference' END AS verdict,
 {s6("CASE WHEN reasons = '' THEN (CAST(v AS DOUBLE) - b) / nullif(b, 0) END", 'relative_difference')}, {s6("CASE WHEN reasons = '' THEN (CAST(r AS DOUBLE) - b) / nullif(b, 0) END", 'repeat_difference')} FROM why""")
def q_compare_runs(spark, sf_dir):
    runs = runs_of(spark, sf_dir)
    out = rs.compare_runs(runs, conditions_of(runs))
    return out.select("exp_id", F.array_join("reasons", "; ").alias("reasons"), "exit_code", "verdict", r6("relative_difference", "relative_difference"), r6("repeat_difference", "repeat_difference"))


@query("""WITH m AS (SELECT c_mktsegment AS exp_id, c_custkey AS run_id, c_nationkey AS n, c_acctbal AS a FROM customer), v AS (SELECT exp_id, run_id, unnest([
{'metric': 'cameras_registered', 'value': CAST(n AS DOUBLE), 'units': NULL}, {'metric': 'registration_ratio', 'value': CASE WHEN n > 0 THEN 1.0::DOUBLE / n END, 'units': NULL}, {'metric': 'num_points_valid', 'value': a, 'units': NULL},
{'metric': 'alignment_arc_coverage_deg', 'value': CASE WHEN n % 3 > 0 THEN n * 10.0::DOUBLE END, 'units': 'deg'}, {'metric': 'alignment_planarity', 'value': NULL, 'units': NULL}, {'metric': 'selection_time_s', 'value': n / 4.0::DOUBLE, 'units': 's'},
{'metric': 'selection_time_share', 'value': CASE WHEN n % 4 > 0 THEN (n / 4.0::DOUBLE) / (n % 4) END, 'units': NULL}, {'metric': 'visual_check_defects', 'value': CAST(n % 2 AS DOUBLE), 'units': NULL}]) AS m FROM m)
SELECT exp_id, run_id, m.metric AS metric, round(m.value, 6) + 0.0::DOUBLE AS value, CASE WHEN m.value IS NULL THEN 'unavailable' ELSE 'available' END AS availability, CASE WHEN m.value IS NULL THEN 'not recorded: ' || m.metric END AS reason, CASE WHEN m.value IS NOT NULL THEN m.units END AS units FROM v""")
def q_declared_metrics(spark, sf_dir):
    n = F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("exp_id"), F.col("c_custkey").alias("run_id"), n.alias("cameras_registered"), F.when(n > 0, F.lit(1.0) / n).alias("registration_ratio"), F.col("c_acctbal").alias("num_points_valid"),
        F.when(n % 3 > 0, n * 10.0).alias("alignment_arc_coverage_deg"), F.lit(None).cast("double").alias("alignment_planarity"), (n / 4.0).alias("selection_time_s"), (n % 4).cast("double").alias("total_time_s"), (n % 2).alias("visual_check_defects"),
    )
    return rs.declared_metrics(rows, ("exp_id", "run_id")).withColumn("value", r6("value"))


CHECKED = ("click", "rotation", "view")


@query(f"""WITH last AS (SELECT user_id AS run_id, event_type AS item, arg_max(CASE WHEN value > 250 THEN 'defect' WHEN value < 10 THEN 'not_checked' ELSE 'ok' END, (ts, event_id)) AS result, CAST(epoch_us(max(ts)) AS VARCHAR) AS seen_at FROM events GROUP BY ALL),
need AS (SELECT run_id, unnest({list(CHECKED)!r}) AS item, unnest([0, 1, 2]) AS place FROM (SELECT DISTINCT user_id AS run_id FROM events)),
j AS (SELECT coalesce(n.run_id, l.run_id) AS run_id, coalesce(n.item, l.item) AS item, coalesce(n.place, 3) AS place, coalesce(l.result, 'not_checked') AS result, l.seen_at FROM need n FULL JOIN last l ON n.run_id = l.run_id AND n.item = l.item)
SELECT run_id, item, place, result, CASE WHEN result <> 'not_checked' THEN seen_at END AS checked_us FROM j""")
def q_visual_check(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    result = F.when(F.col("value") > 250, "defect").when(F.col("value") < 10, "not_checked").otherwise("ok")
    log = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("item"), result.alias("result"), F.lit(None).cast("string").alias("note"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    return rs.visual_checks(log, log, CHECKED).select("run_id", "item", "place", "result", F.col("checked_at").cast("string").alias("checked_us"))


@query(f"""WITH c AS (SELECT event_id, ({list(rs.ITEMS)!r} || ['sharpness'])[1 + event_id % 7] AS item, ['ok', 'defect', 'not_checked', 'fine'][1 + event_id % 4] AS result FROM events)
SELECT event_id, CASE WHEN item = 'sharpness' OR result = 'fine' THEN 2 ELSE 0 END AS exit_code FROM c""")
def q_check_entries(spark, sf_dir):
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % n).cast("int"))
    log = table(spark, sf_dir, "events").select("event_id", pick((*rs.ITEMS, "sharpness"), 7).alias("item"), pick((*rs.OUTCOMES, "fine"), 4).alias("result"))
    return rs.check_entries(log).select("event_id", "exit_code")


@query(f"""WITH {COUNTS}, g AS (SELECT *, run_id % 2 = 0 AS there, run_id % 3 = 0 AS force, 'out/' || run_id || '.ply' AS target FROM st)
SELECT run_id, CASE WHEN status NOT IN ('success', 'partial') AND NOT force THEN 6 WHEN pts = 0 THEN 6 WHEN there AND NOT force THEN 8 ELSE 0 END AS exit_code, CASE WHEN status IN ('success', 'partial') THEN target ELSE 'out/' || run_id || '.UNUSABLE.ply' END AS target FROM g""")
def q_export_guard(spark, sf_dir):
    rows = counts(spark, sf_dir)
    run = F.col("run_id")
    cols = rs.export_guard(F.col("status"), F.col("pts"), run % 2 == 0, run % 3 == 0, F.concat(F.lit("out/"), run.cast("string"), F.lit(".ply")))
    return rows.select("run_id", *(c.alias(n) for n, c in cols.items()))


@query("""WITH f AS (SELECT event_id AS src_index, 'f' || event_id AS frame_id FROM events WHERE event_type = 'purchase'), s AS (SELECT event_id AS src_index, 'in/' || event_id || '.jpg' AS path FROM events WHERE event_id % 9 <> 0)
SELECT f.frame_id, f.src_index, s.path AS source, 'images/' || f.frame_id || '.jpg' AS target FROM f LEFT JOIN s ON f.src_index = s.src_index""")
def q_package_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    frames = e.select(F.col("event_id").alias("src_index"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("frame_id"), (F.col("event_type") == "purchase").alias("selected"))
    files = e.where("event_id % 9 <> 0").select(F.col("event_id").alias("src_index"), F.concat(F.lit("in/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"))
    return package_plan(frames, files).select("frame_id", "src_index", "source", "target")


@query(f"SELECT n_name AS name, CASE WHEN n_name IN {rs.PRELIMINARY!r} THEN 'the value of ''' || n_name || ''' is preliminary: no measurement backs it' END AS note FROM (SELECT n_name FROM nation UNION ALL SELECT unnest({list(rs.PRELIMINARY)!r}))")
def q_preliminary(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return rs.preliminary_notes(names.unionByName(spark.createDataFrame([(n,) for n in rs.PRELIMINARY], "name string")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'b:2,c:3,a:1' ELSE 'b:9,a:1' END AS merged FROM orders")
def q_merge_maps(spark, sf_dir):
    pair = lambda *kv: F.create_map(*(F.lit(x) for x in kv))
    right = F.when(F.col("o_orderkey") % 3 == 0, pair("b", 2, "c", 3, "a", 1)).otherwise(pair("b", 9, "a", 1))
    text = F.array_join(F.transform(F.map_entries(rs.merge_maps(pair("a", 7, "b", 8), right)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("merged"))


@query(f"""WITH {CLOUD}, p AS (SELECT point_id % 7 AS run_id, x, y, z FROM cloud), m AS (SELECT run_id, (min(x) + max(x)) / 2 AS sx, (min(y) + max(y)) / 2 AS sy, (min(z) + max(z)) / 2 AS sz FROM p GROUP BY run_id)
SELECT p.run_id, {s6('any_value(sx)', 'sx')}, {s6('any_value(sy)', 'sy')}, {s6('any_value(sz)', 'sz')}, {s6('max(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz)))', 'radius')} FROM p JOIN m ON p.run_id = m.run_id GROUP BY p.run_id""")
def q_bounding_sphere(spark, sf_dir):
    points = cloud(spark, sf_dir).select((F.col("point_id") % 7).alias("run_id"), "x", "y", "z")
    return scenes.bounding_sphere(points).select("run_id", *(r6(c, c) for c in ("sx", "sy", "sz", "radius")))


@query("""SELECT o_custkey % 11 AS run_id, count(CASE WHEN o_orderkey % 911 > 0 OR o_custkey % 11 > 5 THEN 1 END) = count(*) AS has_colours FROM orders GROUP BY 1""")
def q_has_colours(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 11).alias("run_id"), F.when((F.col("o_orderkey") % 911 > 0) | (F.col("o_custkey") % 11 > 5), 1).alias("r"))
    return rs.has_colours(o)


@query(f"""WITH {CAMERAS}, c AS (SELECT s_nationkey AS run_id, k, cx, cy, cz FROM centres JOIN supplier ON k = s_suppkey), m AS (SELECT run_id, avg(cx) AS mx, avg(cy) AS my, avg(cz) AS mz FROM c GROUP BY run_id),
s AS (SELECT c.run_id, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my) + (cz - mz) * (cz - mz)) AS away, sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2) + pow(cz - lag(cz) OVER w, 2)) AS step FROM c JOIN m ON c.run_id = m.run_id WINDOW w AS (PARTITION BY c.run_id ORDER BY k))
SELECT run_id, {s6('avg(away)', 'mean_radius')}, {s6('stddev_pop(away)', 'radius_deviation')}, {s6('median(step)', 'median_step')}, count(*) AS num_cameras FROM s GROUP BY run_id""")
def q_trajectory_steps(spark, sf_dir):
    c = cameras(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("run_id")), "k")
    out = scenes.trajectory_steps(c)
    return out.select("run_id", r6("mean_radius", "mean_radius"), r6("radius_deviation", "radius_deviation"), r6("median_step", "median_step"), "num_cameras")


@query("""WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 > 0 THEN 500.0::DOUBLE END AS fx, CASE WHEN s_suppkey % 4 = 0 THEN 640 ELSE 320 END AS w, CASE WHEN s_suppkey % 3 = 0 THEN 200 WHEN s_suppkey % 4 = 0 THEN 480 ELSE 240 END AS h FROM supplier)
SELECT k, round(fx * w / 640, 6) AS fx, round(520.0::DOUBLE * h / 480, 6) AS fy, w AS width, h AS height, CASE WHEN fx IS NULL THEN 'no intrinsics' WHEN abs(640.0::DOUBLE / 480 - CAST(w AS DOUBLE) / h) > 0.01 THEN 'the image has another shape' END AS reason FROM c""")
def q_camera_records(spark, sf_dir):
    k = F.col("k")
    c = cameras(spark, sf_dir).withColumns({"fx": F.when(k % 5 > 0, 500.0), "fy": F.lit(520.0), "cx": F.lit(320.0), "cy": F.lit(240.0), "width": F.lit(640), "height": F.lit(480)})
    out = scenes.cameras_from_records(c, F.when(k % 4 == 0, 640).otherwise(320), F.when(k % 3 == 0, 200).when(k % 4 == 0, 480).otherwise(240))
    return out.select("k", F.round("fx", 6).alias("fx"), F.round("fy", 6).alias("fy"), "width", "height", "reason")


@query()
def q_render_points(spark, sf_dir):
    """The four views of the whole cloud; a numpy twin tests it."""
    points = scaled_points(spark, sf_dir, "r", "g", "b")
    return scenes.render_points(points, scenes.view_cameras(cl.robust_extent(points), 160))


@query(f"""WITH v(view, a, e) AS (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {e}::DOUBLE)" for n, a, e in scenes.VIEWS)}), x AS (SELECT s_nationkey, min(s_acctbal) / 1000 AS cx, CAST(count(*) AS DOUBLE) AS cy, max(s_acctbal) / 1000 AS cz, 1 + count(*) / 10.0::DOUBLE AS radius FROM supplier GROUP BY s_nationkey),
d AS (SELECT s_nationkey, view, cx, cy, cz, radius * 1.12 / sin(radians(17.5::DOUBLE)) AS d, sin(radians(a)) * cos(radians(e)) AS x, sin(radians(e)) AS y, cos(radians(a)) * cos(radians(e)) AS z FROM v, x)
SELECT s_nationkey, view, {s6('d * x + cx', 'px')}, {s6('d * y + cy', 'py')}, {s6('d * z + cz', 'pz')}, {s6('-x', 'r20')}, {s6('-y', 'r21')}, {s6('-z', 'r22')}, {s6('320 / tan(radians(17.5::DOUBLE))', 'fx')} FROM d""")
def q_view_cameras(spark, sf_dir):
    """The four views of an extent a nation."""
    b = F.col("s_acctbal") / 1000
    extent = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min(b).alias("cx"), F.count("*").cast("double").alias("cy"), F.max(b).alias("cz"), (1 + F.count("*") / 10).alias("radius"))
    return scenes.view_cameras(extent).select("s_nationkey", "view", *(r6(c, n) for c, n in zip(cam.centre(), ("px", "py", "pz"))), *(r6(f"r2{i}", f"r2{i}") for i in range(3)), r6("fx", "fx"))


def voxel_search(points: str, target: int, rounds: int = 4, probes: int = 16) -> str:
    """The search for a voxel size in SQL: each round's sizes, their counts, and the range that goes on."""
    out = [f"box AS (SELECT min(x) AS bx, min(y) AS by_, min(z) AS bz, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS dg FROM {points})",
           f"s0 AS (SELECT dg / pow({target}, 1 / 3.0::DOUBLE) / 1000 AS low, dg / pow({target}, 1 / 3.0::DOUBLE) * 1000 AS high, dg * 2 AS best, false AS done FROM box)"]
    for r in range(1, rounds + 1):
        out += [
            f"z{r} AS (SELECT i, low * pow(high / low, i / {probes - 1}.0::DOUBLE) AS size FROM s{r - 1}, range({probes}) t(i))",
            f"c{r} AS (SELECT i, any_value(size) AS size, count(*) AS n FROM (SELECT DISTINCT i, size, floor((x - bx) / size) AS a, floor((y - by_) / size) AS b, floor((z - bz) / size) AS c FROM {points}, box, z{r}) GROUP BY i)",
            f"f{r} AS (SELECT min(i) AS i, arg_min(size, i) AS size, arg_min(n, i) AS n FROM c{r} WHERE n <= {target})",
            f"s{r} AS (SELECT CASE WHEN done OR f.i IS NULL THEN low ELSE (SELECT size FROM z{r} z WHERE z.i = greatest(f.i - 1, 0)) END AS low, CASE WHEN done OR f.i IS NULL THEN high ELSE f.size END AS high, CASE WHEN done OR f.i IS NULL THEN best ELSE f.size END AS best, done OR f.i IS NULL OR f.n = {target} OR f.i = 0 AS done FROM s{r - 1}, f{r} f)",
        ]
    return ", ".join(out)


DECIMATED = f"""{FLAWED}, {voxel_search('valid', 500)}, n AS (SELECT v.*, best, floor((x - bx) / best) AS i, floor((y - by_) / best) AS j, floor((z - bz) / best) AS k, bx, by_, bz FROM valid v, box, s4),
d AS (SELECT *, 0.0::DOUBLE + (x - bx - (i + 0.5::DOUBLE) * best) * (x - bx - (i + 0.5::DOUBLE) * best) + (y - by_ - (j + 0.5::DOUBLE) * best) * (y - by_ - (j + 0.5::DOUBLE) * best) + (z - bz - (k + 0.5::DOUBLE) * best) * (z - bz - (k + 0.5::DOUBLE) * best) AS dist2 FROM n),
w AS (SELECT arg_min(point_id, (dist2, point_id)) AS point_id, any_value(best) AS best FROM d GROUP BY i, j, k)"""


@query(f"WITH {DECIMATED} SELECT v.point_id, {', '.join(s6(f'v.{c}', c) for c in 'xyz')}, {s6('best', 'voxel_size')} FROM w JOIN valid v ON v.point_id = w.point_id")
def q_voxel_decimate(spark, sf_dir):
    kept, size = cl.voxel_decimate(flawed_cloud(spark, sf_dir), 500)
    return kept.select("point_id", *(r6(c, c) for c in "xyz"), r6(F.lit(size).cast("double"), "voxel_size"))
