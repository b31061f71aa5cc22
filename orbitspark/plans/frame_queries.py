"""Queries over candidate frames and gray images."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbitspark.functions import measures as ms
from orbitspark.operators import frames as fr
from orbitspark.operators import runs as rn
from orbitspark.plans.book import Book, r6, s6
from orbitspark.plans.views import FRAMES, GRAY, UNIFORM, frames, gray, selected_uniform, table

QUERIES = query = Book()
RATES = ("30000/1001", "25/1", "30", "0/0", "N/A", "24000/1001", "", "0/1")


@query(f"""WITH {FRAMES}, s AS (SELECT *, CAST(greatest(1, ceil(count(*) OVER (PARTITION BY run_id) / 20.0)) AS INTEGER) AS stride FROM frames)
SELECT run_id, CAST(src_index AS INTEGER) AS src_index, timestamp_us, stride FROM s WHERE src_index % stride = 0""")
def q_candidate_stride(spark, sf_dir):
    return fr.stride_sample(frames(spark, sf_dir), "run_id", 20).select("run_id", "src_index", "timestamp_us", "stride")


@query(f"""WITH {FRAMES}, l AS (SELECT *, lag(timestamp_us) OVER (PARTITION BY run_id ORDER BY src_index) AS before FROM frames)
SELECT run_id, count(*) AS n_frames, max(timestamp_us) AS last_us, count(*) FILTER (before > timestamp_us) AS n_backwards FROM l GROUP BY run_id""")
def q_timestamps_us(spark, sf_dir):
    before = F.lag("timestamp_us").over(Window.partitionBy("run_id").orderBy("src_index"))
    return frames(spark, sf_dir).withColumn("before", before).groupBy("run_id").agg(F.count("*").alias("n_frames"), F.max("timestamp_us").alias("last_us"), F.count_if(F.col("before") > F.col("timestamp_us")).alias("n_backwards"))


@query("""WITH p AS (SELECT p_partkey, 100 + p_size * 40 AS w, 80 + p_partkey % 50 * 30 AS h FROM part), s AS (SELECT *, least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(w, h)) AS s FROM p)
SELECT p_partkey, CAST(greatest(1, round_even(w * s, 0)) AS INTEGER) AS width, CAST(greatest(1, round_even(h * s, 0)) AS INTEGER) AS height FROM s""")
def q_target_size(spark, sf_dir):
    w, h = 100 + F.col("p_size") * 40, 80 + F.col("p_partkey") % 50 * 30
    width, height = ms.target_size(w, h, 1024)
    return table(spark, sf_dir, "part").select("p_partkey", width.alias("width"), height.alias("height"))


@query(f"""WITH t AS (SELECT n_nationkey, list_extract({list(RATES)!r}, CAST(n_nationkey % 8 AS INTEGER) + 1) AS rate FROM nation),
n AS (SELECT n_nationkey, rate, try_cast(split_part(rate, '/', 1) AS DOUBLE) AS top, CASE WHEN contains(rate, '/') THEN try_cast(split_part(rate, '/', 2) AS DOUBLE) ELSE 1 END AS low FROM t)
SELECT n_nationkey, rate, {s6("nullif(CASE WHEN low = 0 THEN NULL ELSE top / low END, 0)", "fps")} FROM n""")
def q_rate_parse(spark, sf_dir):
    rate = F.get(F.array(*map(F.lit, RATES)), (F.col("n_nationkey") % 8).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", rate.alias("rate")).withColumn("fps", r6(ms.parse_rate(F.col("rate"))))


@query("SELECT p_partkey, p_size * 25 - 600 AS degrees, CAST((CAST(round_even((p_size * 25 - 600) / 90.0::DOUBLE, 0) AS BIGINT) % 4 + 4) % 4 * 90 AS INTEGER) AS rotation FROM part")
def q_rotation_snap(spark, sf_dir):
    degrees = F.col("p_size") * 25 - 600
    return table(spark, sf_dir, "part").select("p_partkey", degrees.alias("degrees"), ms.snap_rotation(degrees).alias("rotation"))


@query(f"""WITH {GRAY}, inner_px AS (SELECT r * 8 + c AS i FROM range(1, 7) a(r), range(1, 7) b(c)),
resp AS (SELECT vec_id, CAST(px[i - 8 + 1] AS DOUBLE) + px[i + 8 + 1] + px[i - 1 + 1] + px[i + 1 + 1] - 4 * CAST(px[i + 1] AS DOUBLE) AS v FROM gray, inner_px)
SELECT vec_id, {s6("var_pop(v)", "sharpness")} FROM resp GROUP BY vec_id""")
def q_sharpness(spark, sf_dir):
    return gray(spark, sf_dir).select("vec_id", r6(fr.laplacian_variance(F.col("px"), F.lit(8), F.lit(8)), "sharpness"))


@query(f"""WITH {GRAY}, l AS (SELECT vec_id, run_id, src_index, px, lag(px) OVER (PARTITION BY run_id ORDER BY src_index) AS before FROM gray), u AS (SELECT vec_id, unnest(px) AS a, unnest(before) AS b FROM l)
SELECT l.run_id, CAST(l.src_index AS INTEGER) AS src_index, {s6("avg(abs(CAST(a AS DOUBLE) - CAST(b AS DOUBLE)))", "diff")} FROM l LEFT JOIN u ON l.vec_id = u.vec_id GROUP BY ALL""")
def q_frame_difference(spark, sf_dir):
    before = F.lag("px").over(Window.partitionBy("run_id").orderBy("src_index"))
    return gray(spark, sf_dir).withColumn("before", before).select("run_id", "src_index", r6(fr.frame_difference(F.col("px"), F.col("before")), "diff"))


@query(f"""WITH {UNIFORM} SELECT run_id, CAST(src_index AS INTEGER) AS src_index, selected, CASE WHEN selected THEN printf('%04d_%06d', CAST(seq AS INTEGER), CAST(src_index AS INTEGER)) ELSE printf('----_%06d', CAST(src_index AS INTEGER)) END AS frame_id,
CASE WHEN NOT selected THEN 'budget_exhausted' END AS reject_reason FROM uniform""")
def q_select_uniform(spark, sf_dir):
    return selected_uniform(spark, sf_dir).select("run_id", "src_index", "selected", "frame_id", "reject_reason")


WINDOWS = FRAMES + """, numbered AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM frames),
windowed AS (SELECT *, (SELECT count(*) FROM range(1, 8) t(k) WHERE k < least(8, n) AND round_even(k * (n / least(8, n)::DOUBLE), 0) <= src_index) AS win FROM numbered)"""


@query(f"WITH {WINDOWS} SELECT run_id, CAST(win AS INTEGER) AS win, CAST(min(src_index) AS INTEGER) AS first_index, CAST(max(src_index) + 1 AS INTEGER) AS end_index FROM windowed GROUP BY run_id, win")
def q_window_bounds(spark, sf_dir):
    rows = fr.with_windows(frames(spark, sf_dir), "run_id", 8)
    return rows.groupBy("run_id", F.col("window").alias("win")).agg(F.min("src_index").alias("first_index"), (F.max("src_index") + 1).alias("end_index"))


QUALITY = "RECURSIVE " + WINDOWS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, win ORDER BY sharpness DESC, src_index) AS rank FROM windowed),
nexts AS (SELECT a.run_id, a.win, a.rank AS from_rank, coalesce(min(b.rank) FILTER (abs(b.sharpness - a.sharpness) / 500 >= 0.1), 1) AS to_rank, count(*) FILTER (abs(b.sharpness - a.sharpness) / 500 >= 0.1) = 0 AS fallback
          FROM ranked a JOIN ranked b ON a.run_id = b.run_id AND b.win = a.win + 1 GROUP BY a.run_id, a.win, a.rank),
picked AS (SELECT run_id, win, rank, false AS fallback FROM ranked WHERE win = 0 AND rank = 1
           UNION ALL SELECT n.run_id, n.win + 1, n.to_rank, n.fallback FROM picked p JOIN nexts n ON p.run_id = n.run_id AND p.win = n.win AND p.rank = n.from_rank),
quality AS (SELECT r.run_id, r.src_index, r.win, r.rank, p.rank AS pick_rank, p.fallback, r.rank = p.rank AS selected FROM ranked r JOIN picked p ON r.run_id = p.run_id AND r.win = p.win)"""


def quality(spark, sf_dir):
    return fr.select_quality(frames(spark, sf_dir), "run_id", 8, 0.1)


@query(f"""WITH {QUALITY} SELECT run_id, CAST(src_index AS INTEGER) AS src_index, CAST(win AS INTEGER) AS win, selected,
CASE WHEN selected THEN NULL WHEN fallback OR rank < pick_rank THEN 'redundant' ELSE 'less_sharp_in_window' END AS reject_reason FROM quality""")
def q_select_quality(spark, sf_dir):
    return quality(spark, sf_dir).select("run_id", "src_index", F.col("window").alias("win"), "selected", "reject_reason")


@query(f"""WITH {QUALITY}, per AS (SELECT run_id, win, max(pick_rank) AS pick_rank, bool_or(fallback) AS fallback, count(*) AS n FROM quality GROUP BY run_id, win)
SELECT run_id, count(*) AS windows, count(*) AS selected, count(*) FILTER (fallback) AS fallbacks, CAST(sum(CASE WHEN win = 0 THEN 0 WHEN fallback THEN n ELSE pick_rank END) AS BIGINT) AS diff_evaluations FROM per GROUP BY run_id""")
def q_selection_info(spark, sf_dir):
    return fr.selection_info(quality(spark, sf_dir), "run_id")


@query(f"""WITH {QUALITY} SELECT run_id, CASE WHEN fallback OR rank < pick_rank THEN 'redundant' ELSE 'less_sharp_in_window' END AS reject_reason, count(*) AS n FROM quality WHERE NOT selected GROUP BY ALL""")
def q_reject_counts(spark, sf_dir):
    return quality(spark, sf_dir).where("not selected").groupBy("run_id", "reject_reason").agg(F.count("*").alias("n"))


@query(f"WITH {UNIFORM} SELECT run_id, 'uniform' AS selector, count(*) AS considered, count(*) FILTER (selected) AS selected, count(*) FILTER (NOT selected) AS rejected FROM uniform GROUP BY run_id")
def q_selection_summary(spark, sf_dir):
    return selected_uniform(spark, sf_dir).groupBy("run_id").agg(F.lit("uniform").alias("selector"), F.count("*").alias("considered"), F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("rejected"))


@query(f"WITH {UNIFORM} SELECT run_id, count(*) FILTER (selected) AS selected, CASE WHEN count(*) FILTER (selected) >= 12 THEN 0 ELSE 3 END AS exit_code FROM uniform GROUP BY run_id")
def q_enough_frames(spark, sf_dir):
    picked = selected_uniform(spark, sf_dir).groupBy("run_id").agg(F.count_if("selected").alias("selected"))
    return picked.withColumn("exit_code", F.when(F.col("selected") >= 12, 0).otherwise(3))


DIFFS = UNIFORM + """, diffs AS (SELECT run_id, src_index, abs(sharpness - lag(sharpness) OVER (PARTITION BY run_id ORDER BY src_index)) / 500 AS diff FROM uniform WHERE selected)"""


def diffs(spark, sf_dir):
    return fr.diff_to_previous(selected_uniform(spark, sf_dir), "run_id", lambda w: F.abs(F.col("sharpness") - F.lag("sharpness").over(w)) / 500)


@query(f"WITH {DIFFS} SELECT run_id, CAST(src_index AS INTEGER) AS src_index, {s6('diff', 'diff')} FROM diffs")
def q_selected_diffs(spark, sf_dir):
    return diffs(spark, sf_dir).select("run_id", "src_index", r6("diff_to_prev_selected", "diff"))


@query(f"WITH {DIFFS} SELECT run_id, {s6('median(diff)', 'median_diff')}, coalesce(median(diff) <= 0.02, false) AS low_diversity FROM diffs GROUP BY run_id")
def q_low_diversity(spark, sf_dir):
    m = diffs(spark, sf_dir).groupBy("run_id").agg(F.median("diff_to_prev_selected").alias("m"))
    return m.select("run_id", r6("m", "median_diff"), F.coalesce(F.col("m") <= rn.LOW_DIVERSITY, F.lit(False)).alias("low_diversity"))


@query(f"""WITH {DIFFS}, m AS (SELECT run_id, median(diff) AS d FROM diffs GROUP BY run_id),
f AS (SELECT run_id, avg(CASE WHEN sharpness < 100 THEN 1.0::DOUBLE ELSE 0 END) AS blurry, max(timestamp_us) / 1e6 AS seconds, avg(CASE WHEN event_type = 'purchase' THEN 0.0::DOUBLE ELSE 1 END) AS registered FROM frames GROUP BY run_id)
SELECT f.run_id, concat_ws(',', CASE WHEN blurry >= 0.3 THEN 'many_blurry_frames' END, CASE WHEN d <= 0.02 THEN 'low_viewpoint_diversity' END, CASE WHEN seconds < 5.0 THEN 'short_video' END, CASE WHEN registered <= 0.6 THEN 'few_registered_cameras' END) AS codes
FROM f JOIN m ON f.run_id = m.run_id""")
def q_warnings(spark, sf_dir):
    m = diffs(spark, sf_dir).groupBy("run_id").agg(F.median("diff_to_prev_selected").alias("d"))
    f = frames(spark, sf_dir).groupBy("run_id").agg(
        F.avg((F.col("sharpness") < 100).cast("double")).alias("blurry"), (F.max("timestamp_us") / 1e6).alias("seconds"), F.avg((F.col("event_type") != "purchase").cast("double")).alias("registered")
    )
    codes = rn.warning_codes(F.col("blurry"), F.col("d"), F.col("seconds"), F.col("registered"))
    return f.join(m, "run_id").select("run_id", F.array_join(codes, ",").alias("codes"))


@query(f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM frames) SELECT run_id, CAST(src_index AS INTEGER) AS src_index FROM n WHERE src_index IN (0, n // 3, 2 * n // 3)")
def q_pair_indices(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("run_id")))
    third = lambda k: F.floor(F.col("n") * k / 3)
    return rows.where((F.col("src_index") == 0) | (F.col("src_index") == third(1)) | (F.col("src_index") == third(2))).select("run_id", "src_index")


@query("""WITH s AS (SELECT p_partkey, 640 + p_size * 8 AS w, 480 + p_size * 6 + (p_partkey % 3) * 40 AS h FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'no camera for this frame' WHEN abs(w * 480.0::DOUBLE / (h * 640.0::DOUBLE) - 1) > 0.01 THEN 'aspect differs' ELSE 'rendered' END AS outcome, round(500.0::DOUBLE * w / 640, 6) AS fx, round(500.0::DOUBLE * h / 480, 6) AS fy FROM s""")
def q_frame_vs_render(spark, sf_dir):
    w, h = 640 + F.col("p_size") * 8, 480 + F.col("p_size") * 6 + (F.col("p_partkey") % 3) * 40
    differs = F.abs(w * F.lit(480.0) / (h * F.lit(640.0)) - 1) > 0.01
    outcome = F.when(F.col("p_partkey") % 7 == 0, "no camera for this frame").when(differs, "aspect differs").otherwise("rendered")
    return table(spark, sf_dir, "part").select("p_partkey", outcome.alias("outcome"), F.round(F.lit(500.0) * w / 640, 6).alias("fx"), F.round(F.lit(500.0) * h / 480, 6).alias("fy"))
