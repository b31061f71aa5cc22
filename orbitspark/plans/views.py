"""Adapter views: the driver's tables as frames, gray images, clouds, cameras and files; and the same in SQL."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitspark.operators import frames as fr

DAY0 = "1992-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run a user, one frame an event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", "event_type", F.col("value").alias("sharpness"))
    return fr.with_offsets(fr.numbered(e, "run_id", "ts", "event_id"), "run_id", "ts")


FRAMES = """frames AS (
  SELECT user_id AS run_id, event_id, event_type, value AS sharpness, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS src_index,
         epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS timestamp_us
  FROM events)"""


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run a label, one 8 x 8 image a vector."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("run_id"), "vec_id", F.col("embedding").alias("px"))
    return fr.numbered(v, "run_id", "vec_id")


GRAY = "gray AS (SELECT label AS run_id, vec_id, embedding AS px, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS src_index FROM embeddings)"


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("point_id"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") % 97).cast("double").alias("y"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit(DAY0).cast("date")).cast("double").alias("z"),
        (F.col("o_orderkey") % 256).cast("int").alias("r"), (F.col("o_custkey") * 7 % 256).cast("int").alias("g"), (F.col("o_orderkey") * 13 % 256).cast("int").alias("b"),
    )


CLOUD = f"""cloud AS (
  SELECT o_orderkey AS point_id, o_totalprice / 1000 AS x, CAST(o_custkey % 97 AS DOUBLE) AS y, CAST(date_diff('day', DATE '{DAY0}', CAST(o_orderdate AS DATE)) AS DOUBLE) AS z,
         CAST(o_orderkey % 256 AS INTEGER) AS r, CAST(o_custkey * 7 % 256 AS INTEGER) AS g, CAST(o_orderkey * 13 % 256 AS INTEGER) AS b
  FROM orders)"""


def flawed_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud with some coordinates not finite and a few far away."""
    x = F.when(F.col("point_id") % 50 == 0, float("nan")).when(F.col("point_id") % 77 == 0, float("inf")).when(F.col("point_id") % 501 == 0, F.col("x") * 1000).otherwise(F.col("x"))
    return cloud(spark, sf_dir).withColumn("x", x).withColumn("z", F.when(F.col("point_id") % 91 == 0, float("-inf")).otherwise(F.col("z")))


FLAWED = CLOUD + """, flawed AS (
  SELECT point_id, CASE WHEN point_id % 50 = 0 THEN 'NaN'::DOUBLE WHEN point_id % 77 = 0 THEN 'Infinity'::DOUBLE WHEN point_id % 501 = 0 THEN x * 1000 ELSE x END AS x,
         y, CASE WHEN point_id % 91 = 0 THEN '-Infinity'::DOUBLE ELSE z END AS z, r, g, b
  FROM cloud), valid AS (SELECT * FROM flawed WHERE isfinite(x) AND isfinite(y) AND isfinite(z))"""


def cameras(spark: SparkSession, sf_dir: str, arc: float | Column = 1.0) -> DataFrame:
    """A ring of cameras, one a supplier: radius 3, 1 above the plane, each looking at the origin; all within ``arc`` of the circle."""
    s = table(spark, sf_dir, "supplier")
    n = s.agg(F.count("*").alias("n"))
    s = s.select(F.col("s_suppkey").alias("k")).crossJoin(F.broadcast(n))
    phi = F.lit(2 * pi) * arc * F.col("k") / F.col("n")
    s = s.withColumn("c", F.cos(phi)).withColumn("s", F.sin(phi))
    q = F.sqrt(F.lit(10.0))
    zero = F.lit(0.0)
    rows = [-F.col("s"), F.col("c"), zero, F.col("c") / q, F.col("s") / q, F.lit(-3.0) / q, F.lit(-3.0) * F.col("c") / q, F.lit(-3.0) * F.col("s") / q, F.lit(-1.0) / q]
    s = s.select("k", *(x.alias(f"r{i // 3}{i % 3}") for i, x in enumerate(rows)), (F.col("c") * 3).alias("px"), (F.col("s") * 3).alias("py"), F.lit(1.0).alias("pz"))
    return s.select("k", *(f"r{i}{j}" for i in range(3) for j in range(3)), *((-(F.col(f"r{i}0") * F.col("px") + F.col(f"r{i}1") * F.col("py") + F.col(f"r{i}2") * F.col("pz"))).alias(f"t{i}") for i in range(3)))


CAMERAS = """ring AS (SELECT s_suppkey AS k, cos(2 * pi() * 1.0::DOUBLE * s_suppkey / count(*) OVER ()) AS c, sin(2 * pi() * 1.0::DOUBLE * s_suppkey / count(*) OVER ()) AS s FROM supplier),
cams0 AS (SELECT k, -s AS r00, c AS r01, 0.0::DOUBLE AS r02, c / sqrt(10) AS r10, s / sqrt(10) AS r11, -3 / sqrt(10) AS r12, -3 * c / sqrt(10) AS r20, -3 * s / sqrt(10) AS r21, -1 / sqrt(10) AS r22,
          3 * c AS px, 3 * s AS py, 1.0::DOUBLE AS pz FROM ring),
cams AS (SELECT *, -(r00 * px + r01 * py + r02 * pz) AS t0, -(r10 * px + r11 * py + r12 * pz) AS t1, -(r20 * px + r21 * py + r22 * pz) AS t2 FROM cams0),
centres AS (SELECT *, -(r00 * t0 + r10 * t1 + r20 * t2) AS cx, -(r01 * t0 + r11 * t1 + r21 * t2) AS cy, -(r02 * t0 + r12 * t1 + r22 * t2) AS cz, -r10 AS ux, -r11 AS uy, -r12 AS uz FROM cams)"""


def cameras_sql(arc: float | str) -> str:
    """The ring within a part of the circle."""
    return CAMERAS.replace("1.0::DOUBLE * s_suppkey", f"{arc}::DOUBLE * s_suppkey")


def transform(spark: SparkSession) -> DataFrame:
    """A fixed rigid transform: a turn by the 3-4-5 angle about z, then a shift."""
    return spark.range(1).select(*(F.lit(float(v)).alias(f"r{i // 3}{i % 3}") for i, v in enumerate((0.6, -0.8, 0, 0.8, 0.6, 0, 0, 0, 1))), F.lit(1.0).alias("t0"), F.lit(-2.0).alias("t1"), F.lit(0.5).alias("t2"))


def selected_uniform(spark: SparkSession, sf_dir: str, budget: int = 12) -> DataFrame:
    return fr.select_uniform(frames(spark, sf_dir), "run_id", budget)


UNIFORM = FRAMES + """, sized AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM frames),
picks AS (SELECT DISTINCT run_id, CAST(round_even(i * ((n - 1) / 11.0::DOUBLE), 0) AS BIGINT) AS pos FROM (SELECT DISTINCT run_id, n FROM sized), range(12) t(i) WHERE n > 12
          UNION SELECT run_id, src_index FROM sized WHERE n <= 12),
uniform AS (SELECT s.*, p.pos IS NOT NULL AS selected, sum(CASE WHEN p.pos IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.run_id ORDER BY s.src_index) AS seq
            FROM sized s LEFT JOIN picks p ON s.run_id = p.run_id AND s.src_index = p.pos)"""
