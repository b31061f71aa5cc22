"""Queries over what a decoder reports: times with rejects, rotations, images of unlike sizes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbitspark.operators import images, intake
from orbitspark.plans.book import Book, r6, s6
from orbitspark.plans.views import FRAMES, GRAY, frames, gray, table

QUERIES = query = Book()

#: Events as decoded frames: every fifth has no best time; of ten runs one lacks times, one runs backwards, and one has a frame less than expected.
DECODED = FRAMES + """, decoded AS (SELECT *, CASE WHEN run_id % 10 = 3 AND event_id % 7 = 0 THEN NULL WHEN run_id % 10 = 4 THEN 1000000.0::DOUBLE - timestamp_us / 1000000.0::DOUBLE ELSE timestamp_us / 1000000.0::DOUBLE END AS t FROM frames),
counted AS (SELECT run_id, count(*) AS n_frames, count(*) - count(t) AS n_missing, count(*) + CASE WHEN run_id % 10 = 5 THEN 1 ELSE 0 END AS expected, min(t) AS origin FROM decoded GROUP BY run_id),
fates AS (SELECT *, CASE WHEN n_missing > 0 THEN n_missing || ' of ' || n_frames || ' frames have no time' WHEN n_frames <> expected THEN n_frames || ' frames instead of ' || expected END AS reason FROM counted)"""


def decoded(spark, sf_dir):
    """The frames, and how many each run is expected to have."""
    f = frames(spark, sf_dir)
    ten, s = F.col("run_id") % 10, F.col("timestamp_us") / F.lit(1_000_000.0)
    t = F.when((ten == 3) & (F.col("event_id") % 7 == 0), None).when(ten == 4, F.lit(1_000_000.0) - s).otherwise(s)
    f = f.select("run_id", "event_id", "src_index", t.alias("pts_s"), F.when(F.col("event_id") % 5 != 0, t).alias("best_s"))
    return f, f.groupBy("run_id").agg((F.count("*") + F.max(F.when(ten == 5, 1).otherwise(0))).alias("expected"))


@query(f"""WITH {DECODED}, good AS (SELECT d.*, origin FROM decoded d JOIN fates USING (run_id) WHERE reason IS NULL),
places AS (SELECT run_id, src_index, row_number() OVER (PARTITION BY run_id ORDER BY src_index) AS place FROM good),
times AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY t, src_index) AS place, CAST(round_even((t - origin) * 1000000, 0) AS BIGINT) AS timestamp_us FROM good)
SELECT run_id, src_index, timestamp_us FROM places JOIN times USING (run_id, place)""")
def q_frame_times(spark, sf_dir):
    timed, _ = intake.frame_times(*decoded(spark, sf_dir))
    return timed.select("run_id", "src_index", "timestamp_us")


@query(f"WITH {DECODED} SELECT run_id, n_frames, n_missing, expected, reason, 2 AS exit_code FROM fates WHERE reason IS NOT NULL")
def q_frame_rejects(spark, sf_dir):
    return intake.frame_times(*decoded(spark, sf_dir))[1]


#: Parts as videos: a size, a rotation, and the size that was decoded, wrong for every eleventh.
VIDEOS = "v AS (SELECT p_partkey, 100 + p_size AS width, 60 + CAST(p_partkey % 30 AS INTEGER) AS height, CAST(p_partkey % 4 AS INTEGER) * 90 AS rotation, (p_partkey % 2 = 1) <> (p_partkey % 11 = 0) AS swapped FROM part)"


@query(f"WITH {VIDEOS} SELECT p_partkey, CASE WHEN swapped = (rotation IN (90, 270)) THEN rotation END AS rotation_deg, CASE WHEN swapped = (rotation IN (90, 270)) THEN 0 ELSE 2 END AS exit_code FROM v")
def q_verified_rotation(spark, sf_dir):
    key = F.col("p_partkey")
    w, h = (F.lit(100) + F.col("p_size")).cast("int"), (F.lit(60) + key % 30).cast("int")
    swapped = (key % 2 == 1) != (key % 11 == 0)
    out = intake.verified_rotation((key % 4 * 90).cast("int"), w, h, F.when(swapped, h).otherwise(w), F.when(swapped, w).otherwise(h))
    return table(spark, sf_dir, "part").select("p_partkey", out["rotation_deg"].alias("rotation_deg"), out["exit_code"].alias("exit_code"))


#: Every other image has its last two lines cut off; all are brought to 8 x 8 before neighbours are compared.
SIZED = GRAY + """, sized AS (SELECT run_id, src_index, px, CASE WHEN src_index % 2 = 0 THEN 8 ELSE 6 END AS h FROM gray),
targets AS (SELECT n, t, (t + 0.5::DOUBLE) * n / 8.0::DOUBLE AS centre FROM (VALUES (6), (8)) s(n), range(8) r(t)),
raw AS (SELECT n, t, x, greatest(0.0::DOUBLE, 1 - abs(x - centre + 0.5::DOUBLE)) AS wt FROM targets, range(8) q(x) WHERE x < n AND x >= floor(centre - 0.5::DOUBLE) AND x < floor(centre + 1.5::DOUBLE)),
wts AS (SELECT n, t, x, wt / sum(wt) OVER (PARTITION BY n, t) AS wt FROM raw),
small AS (SELECT s.run_id, s.src_index, w.t AS y, c.x, sum(w.wt * CAST(px[w.x * 8 + c.x + 1] AS DOUBLE)) AS v FROM sized s JOIN wts w ON w.n = s.h, range(8) c(x) GROUP BY s.run_id, s.src_index, w.t, c.x),
pairs AS (SELECT a.run_id, a.src_index, avg(abs(a.v - b.v)) AS diff FROM small a JOIN small b ON a.run_id = b.run_id AND a.src_index = b.src_index + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.run_id, a.src_index)"""


@query(f"WITH {SIZED} SELECT run_id, src_index, {s6('diff', 'diff')} FROM pairs")
def q_difference_of_sizes(spark, sf_dir):
    h = F.when(F.col("src_index") % 2 == 0, 8).otherwise(6)
    rows = gray(spark, sf_dir).withColumn("h", h).withColumn("w", F.lit(8)).withColumn("px", F.slice("px", 1, F.col("h") * 8))
    small = images.resized(rows.select("run_id", "src_index", "px", "h", "w"), 8)
    before = F.lag("small").over(Window.partitionBy("run_id").orderBy("src_index"))
    return small.select("run_id", "src_index", images.difference(F.col("small"), before).alias("diff")).where("diff is not null").select("run_id", "src_index", r6("diff", "diff"))
