"""Queries over run records: integrity, statuses, diagnostics, comparison, identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitspark.functions import measures as ms
from orbitspark.operators import runs as rn
from orbitspark.plans.book import Book, r6, s6
from orbitspark.plans.views import FRAMES, frames, table

QUERIES = query = Book()


@query("SELECT DISTINCT c_mktsegment AS run, CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_foreign_names(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("run"), F.col("c_custkey").cast("string").alias("name"))
    known = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("name"))
    return rn.foreign_names(names, known, "name").select("run", "name").distinct()


@query("""WITH want AS (SELECT CAST(doc_id AS VARCHAR) || '.txt' AS path, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0),
have AS (SELECT CAST(doc_id AS VARCHAR) || '.txt' AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0)
SELECT * FROM (SELECT coalesce(w.path, f.path) AS path, CASE WHEN f.h IS NULL THEN 'missing' WHEN w.h IS NULL THEN 'extra' WHEN w.h <> f.h THEN 'changed' END AS problem FROM want w FULL JOIN have f ON w.path = f.path) WHERE problem IS NOT NULL""")
def q_integrity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    want = d.where("doc_id % 11 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    have = d.where("doc_id % 13 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return rn.compare_manifests(want, have)


@query("""WITH m AS (SELECT source AS owner, min(lang) AS want FROM documents GROUP BY source), d AS (SELECT doc_id, source AS owner, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS run_id FROM documents)
SELECT doc_id, d.owner, CASE WHEN run_id IS NULL THEN 'missing' ELSE 'different' END AS problem FROM d JOIN m ON d.owner = m.owner WHERE run_id IS DISTINCT FROM want""")
def q_same_run(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    manifest = d.groupBy(F.col("source").alias("owner")).agg(F.min("lang").alias("run_id"))
    documents = d.select("doc_id", F.col("source").alias("owner"), F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("run_id"))
    return rn.other_run(documents, manifest).select("doc_id", "owner", "problem")


REQUIRED = ("cameras.bin", "images.bin", "points3D.bin", "points.ply")


@query(f"""WITH runs AS (SELECT DISTINCT user_id AS run FROM events), need AS (SELECT run, unnest({list(REQUIRED)!r}) AS name FROM runs),
have AS (SELECT user_id AS run, list_extract({list(REQUIRED)!r}, CAST(event_id % 4 AS INTEGER) + 1) AS name, max(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END) AS length FROM events WHERE event_id % 5 < 2 GROUP BY ALL)
SELECT need.run, need.name, CASE WHEN length IS NULL THEN 7 WHEN length = 0 THEN 5 ELSE 0 END AS exit_code FROM need LEFT JOIN have ON need.run = have.run AND need.name = have.name""")
def q_required_files(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "run")
    names = F.array(*map(F.lit, REQUIRED))
    need = e.select("run").distinct().select("run", F.explode(names).alias("name"))
    have = e.where("event_id % 5 < 2").groupBy("run", F.get(names, (F.col("event_id") % 4).cast("int")).alias("name")).agg(F.max(F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id"))).alias("length"))
    return rn.check_files(have, need).select("run", "name", "exit_code")


COUNTS = """c AS (SELECT user_id AS run_id, count(*) FILTER (event_type = 'purchase') AS cams, count(*) FILTER (event_type = 'click') AS pts, count(*) FILTER (event_type IN ('purchase', 'view')) AS frames_, max(event_id) % 5 <> 0 AS complete, max(event_id) % 4 = 0 AS example FROM events GROUP BY user_id),
st AS (SELECT *, CASE WHEN NOT complete THEN 'interrupted' WHEN cams = 0 OR pts = 0 OR frames_ = 0 THEN 'invalid_result' WHEN cams = frames_ THEN 'success' ELSE 'partial' END AS status FROM c)"""


def counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"))
    c = e.agg(F.count_if(F.col("event_type") == "purchase").alias("cams"), F.count_if(F.col("event_type") == "click").alias("pts"), F.count_if(F.col("event_type").isin("purchase", "view")).alias("frames"), F.max("event_id").alias("m"))
    c = c.withColumn("complete", F.col("m") % 5 != 0).withColumn("example", F.col("m") % 4 == 0)
    return c.withColumn("status", rn.status(F.col("cams"), F.col("pts"), F.col("frames"), F.col("complete")))


@query(f"WITH {COUNTS} SELECT run_id, status, status IN ('success', 'partial') AS viewable FROM st")
def q_status(spark, sf_dir):
    return counts(spark, sf_dir).select("run_id", "status", rn.viewable(F.col("status")).alias("viewable"))


CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rn.BANNERS.items())


@query(f"WITH {COUNTS} SELECT run_id, (CASE status {CASES} END) || CASE WHEN example THEN ' · {rn.EXAMPLE}' ELSE '' END AS banner FROM st")
def q_banner(spark, sf_dir):
    return counts(spark, sf_dir).select("run_id", rn.banner(F.col("status"), F.col("example")).alias("banner"))


@query(f"WITH {COUNTS} SELECT run_id, {s6('CASE WHEN frames_ = 0 THEN NULL ELSE CAST(cams AS DOUBLE) / frames_ END', 'ratio')}, CASE WHEN frames_ = 0 THEN 'no frames were selected' END AS reason FROM st")
def q_registration_ratio(spark, sf_dir):
    m = ms.measure(F.try_divide(F.col("cams").cast("double"), F.col("frames").cast("double")), "no frames were selected")
    return counts(spark, sf_dir).select("run_id", m.alias("m")).select("run_id", r6("m.value", "ratio"), F.col("m.reason").alias("reason"))


@query(f"""WITH {COUNTS}, er AS (SELECT user_id AS run_id, avg(CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END) AS err, count(*) AS n FROM events GROUP BY user_id)
SELECT c.run_id, cams AS cameras_registered, frames_ AS frames_selected, pts AS num_points_valid, {s6('err', 'mean_error')}, CASE WHEN err IS NULL THEN 'no point has an error' END AS error_reason FROM c JOIN er ON c.run_id = er.run_id""")
def q_diagnostics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    errors = e.groupBy(F.col("user_id").alias("run_id")).agg(F.avg(F.when(F.col("event_id") % 6 != 0, F.col("value"))).alias("err"))
    m = ms.measure(F.col("err"), "no point has an error", "px")
    rows = counts(spark, sf_dir).join(errors, "run_id").withColumn("m", m)
    return rows.select("run_id", F.col("cams").alias("cameras_registered"), F.col("frames").alias("frames_selected"), F.col("pts").alias("num_points_valid"), r6("m.value", "mean_error"), F.col("m.reason").alias("error_reason"))


EXPERIMENTS = """x AS (SELECT c_mktsegment AS exp_id, c_nationkey AS pair, count(*) FILTER (o_orderkey % 3 = 0) AS b, count(*) FILTER (o_orderkey % 3 = 1) AS v, nullif(count(*) FILTER (o_orderkey % 3 = 2), 0) AS r,
 CAST(count(*) FILTER (o_orderkey % 3 = 0 AND o_orderstatus = 'F') AS DOUBLE) / nullif(count(*) FILTER (o_orderkey % 3 = 0), 0) AS br, CAST(count(*) FILTER (o_orderkey % 3 = 1 AND o_orderstatus = 'F') AS DOUBLE) / nullif(count(*) FILTER (o_orderkey % 3 = 1), 0) AS vr,
 count(*) FILTER (o_orderkey % 21 = 0) AS bd, count(*) FILTER (o_orderkey % 21 = 1) AS vd FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def experiments(spark, sf_dir):
    """Run pairs of made-up experiments, one a segment and nation: order counts stand for points."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, f = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    n = lambda test: F.count_if(test)
    return j.groupBy(F.col("c_mktsegment").alias("exp_id"), F.col("c_nationkey").alias("pair")).agg(
        n(k % 3 == 0).alias("b"), n(k % 3 == 1).alias("v"), F.nullif(n(k % 3 == 2), F.lit(0)).alias("r"), F.try_divide(n((k % 3 == 0) & f).cast("double"), n(k % 3 == 0).cast("double")).alias("br"),
        F.try_divide(n((k % 3 == 1) & f).cast("double"), n(k % 3 == 1).cast("double")).alias("vr"), n(k % 21 == 0).alias("bd"), n(k % 21 == 1).alias("vd"),
    )


@query(f"""WITH {EXPERIMENTS} SELECT exp_id, pair, metric, round(value, 6) + 0.0::DOUBLE AS value, CASE WHEN value IS NULL THEN 'unavailable' ELSE 'available' END AS availability FROM (
SELECT exp_id, pair, 'num_points_valid' AS metric, CAST(v AS DOUBLE) AS value FROM x UNION ALL SELECT exp_id, pair, 'registration_ratio', vr FROM x UNION ALL SELECT exp_id, pair, 'visual_check_defects', CAST(vd AS DOUBLE) FROM x UNION ALL SELECT exp_id, pair, 'repeat_points', CAST(r AS DOUBLE) FROM x)""")
def q_metrics_unpivot(spark, sf_dir):
    x = experiments(spark, sf_dir)
    metrics = {"num_points_valid": "v", "registration_ratio": "vr", "visual_check_defects": "vd", "repeat_points": "r"}
    rows = x.select("exp_id", "pair", *(F.col(c).cast("double").alias(m) for m, c in metrics.items())).unpivot(["exp_id", "pair"], list(metrics), "metric", "value")
    m = ms.measure(F.col("value"), "not recorded")
    return rows.withColumn("m", m).select("exp_id", "pair", "metric", r6("m.value", "value"), F.col("m.availability").alias("availability"))


@query(f"""WITH {EXPERIMENTS} SELECT exp_id, pair, {s6('CASE WHEN b = 0 THEN NULL ELSE (CAST(r AS DOUBLE) - b) / b END', 'relative')}, CASE WHEN r IS NULL THEN 'one of the compared values is unavailable' WHEN b = 0 THEN 'baseline value is zero, relative difference is undefined' END AS reason FROM x""")
def q_relative_difference(spark, sf_dir):
    v, b = F.col("r").cast("double"), F.col("b").cast("double")
    return experiments(spark, sf_dir).select("exp_id", "pair", r6(ms.relative_difference(v, b), "relative"), ms.relative_difference_reason(v, b).alias("reason"))


@query(f"""WITH {EXPERIMENTS} SELECT exp_id, pair, CASE WHEN coalesce(abs((CAST(r AS DOUBLE) - b) / nullif(b, 0)) >= abs((CAST(v AS DOUBLE) - b) / nullif(b, 0)), false) THEN 'inconclusive' WHEN b IS NULL OR v IS NULL THEN 'inconclusive'
WHEN v >= b * 1.10::DOUBLE AND coalesce(vr >= br, false) AND vd <= bd THEN 'improvement' WHEN v <= b * 0.90::DOUBLE OR coalesce(vr < br, false) OR vd > bd THEN 'regression' ELSE 'no_difference' END AS verdict FROM x""")
def q_verdict(spark, sf_dir):
    c = lambda n: F.col(n).cast("double")
    return experiments(spark, sf_dir).select("exp_id", "pair", rn.verdict(c("b"), c("v"), c("r"), c("br"), c("vr"), c("bd"), c("vd")).alias("verdict"))


@query("""WITH v AS (SELECT c_mktsegment AS exp_id, c_custkey AS run_id, c_nationkey % 3 AS budget, c_custkey % 4 AS seed FROM customer)
SELECT exp_id, run_id, concat_ws(',', CASE WHEN budget <> 1 THEN 'frame_budget' END, CASE WHEN seed = 3 THEN 'seed' END) AS differs, 9 AS exit_code FROM v WHERE budget <> 1 OR seed = 3""")
def q_condition_violations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    fixed = [F.lit("v").alias("video_sha256"), F.lit("code").alias("code_id")]
    runs = c.select(F.col("c_mktsegment").alias("exp_id"), F.col("c_custkey").alias("run_id"), (F.col("c_nationkey") % 3).alias("frame_budget"), F.when(F.col("c_custkey") % 4 == 3, 7).otherwise(42).alias("seed"), *fixed)
    conditions = c.select(F.col("c_mktsegment").alias("exp_id"), F.lit(1).alias("frame_budget"), F.lit(42).alias("seed"), *fixed).distinct()
    return rn.condition_violations(runs, conditions).withColumn("differs", F.array_join("differs", ","))


@query("""WITH c AS (SELECT user_id AS run_id, min(event_id) FILTER (event_type = 'purchase') AS f FROM events GROUP BY user_id)
SELECT c.run_id, round(e.value + e.value / 2, 6) AS selection_time_s FROM c LEFT JOIN events e ON e.event_id = c.f""")
def q_selection_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = F.expr("min_by(struct(value), event_id) FILTER (WHERE event_type = 'purchase')")
    stages = F.create_map(F.lit("select"), F.col("first.value"), F.lit("package"), F.col("first.value") / 2)
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(first.alias("first")).withColumn("commands", F.when(F.col("first").isNotNull(), F.array(stages)))
    return runs.select("run_id", F.round(rn.selection_time(F.col("commands")), 6).alias("selection_time_s"))


ITEMS = ("click", "view", "purchase", "rotation")


@query(f"""WITH need AS (SELECT run_id, unnest({list(ITEMS)!r}) AS item FROM (SELECT DISTINCT user_id AS run_id FROM events)),
last AS (SELECT user_id AS run_id, event_type AS item, arg_max(CASE WHEN value > 250 THEN 'defect' ELSE 'ok' END, (ts, event_id)) AS result, max(ts) AS at FROM events GROUP BY ALL)
SELECT n.run_id, n.item, coalesce(l.result, 'not_checked') AS result, CAST(epoch_us(l.at) AS VARCHAR) AS checked_us FROM need n LEFT JOIN last l ON n.run_id = l.run_id AND n.item = l.item""")
def q_visual_check_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("item"), F.when(F.col("value") > 250, "defect").otherwise("ok").alias("result"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    need = e.select(F.col("user_id").alias("run_id")).distinct().select("run_id", F.explode(F.array(*map(F.lit, ITEMS))).alias("item"))
    return rn.latest_checks(log, need, "run_id").withColumn("checked_at", F.col("checked_at").cast("string")).withColumnRenamed("checked_at", "checked_us")


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y%m%d-%H%M%S') || '-' || sha256(CAST(o_orderkey AS VARCHAR) || '{\"budget\":48}' || 'code' || '42')[1:8] AS run_id FROM orders")
def q_run_id(spark, sf_dir):
    digest = rn.inputs_digest(F.col("o_orderkey").cast("string"), F.lit('{"budget":48}'), F.lit("code"), F.lit(42))
    return table(spark, sf_dir, "orders").select("o_orderkey", rn.run_id(F.col("o_orderdate"), digest).alias("run_id"))


@query("SELECT doc_id, sha256(sha256(text) || '{\"lang\":\"' || lang || '\"}' || source || '7') AS digest FROM documents")
def q_inputs_digest(spark, sf_dir):
    params = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "documents").select("doc_id", rn.inputs_digest(F.sha2("text", 256), params, F.col("source"), F.lit(7)).alias("digest"))


@query("SELECT source AS artifact, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes FROM documents GROUP BY source")
def q_artifact_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("artifact")).agg(F.count("*").alias("file_count"), F.sum(F.octet_length("text").cast("long")).alias("total_bytes"))


#: Runs with frames, cameras and points; of one in twenty five every frame has a camera, which is more than were selected.
EVIDENCE = """fr AS (SELECT user_id AS run_id, count(*) AS frames_considered, count(*) FILTER (event_id % 3 = 0) AS frames_selected, count(*) FILTER (event_id % 6 = 0 OR user_id % 25 = 7) AS cameras_registered,
 count(*) FILTER (event_id % 3 <> 0 AND event_type = 'click') AS less_sharp FROM events GROUP BY user_id),
pt AS (SELECT o_custkey % 200 AS run_id, count(*) AS num_points, count(*) FILTER (o_orderkey % 50 <> 0) AS num_points_valid, min(o_totalprice) FILTER (o_orderkey % 50 <> 0) AS min_x, max(o_totalprice) FILTER (o_orderkey % 50 <> 0) AS max_x,
 avg(o_totalprice / 70000) FILTER (o_orderkey % 4 <> 0) AS error FROM orders GROUP BY o_custkey % 200),
ev AS (SELECT run_id, coalesce(frames_considered, 0) AS frames_considered, coalesce(frames_selected, 0) AS frames_selected, coalesce(cameras_registered, 0) AS cameras_registered, coalesce(less_sharp, 0) AS less_sharp, coalesce(num_points, 0) AS num_points,
 coalesce(num_points_valid, 0) AS num_points_valid, min_x, max_x, error FROM fr FULL OUTER JOIN pt USING (run_id))"""


def evidence(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("run_id", F.col("user_id"))
    frames = e.select("run_id", (F.col("event_id") % 3 == 0).alias("selected"), F.when((F.col("event_id") % 3 != 0) & (F.col("event_type") == "click"), "less_sharp").alias("reject_reason"))
    cameras = e.where("event_id % 6 = 0 or run_id % 25 = 7").select("run_id")
    o = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 200).alias("run_id"), F.when(o % 50 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"), F.lit(7).alias("r"),
        F.when(o % 4 != 0, F.col("o_totalprice") / 70000).alias("error"),
    )
    return rn.diagnostics(frames, cameras, points)


@query(f"""WITH {EVIDENCE} SELECT run_id, frames_considered, frames_selected, less_sharp, cameras_registered, num_points, num_points_valid, {s6('CAST(cameras_registered AS DOUBLE) / nullif(frames_selected, 0)', 'registration_ratio')}, CASE WHEN frames_selected = 0 THEN 'no frames were selected' END AS ratio_reason,
{s6('min_x', 'min_x')}, {s6('max_x', 'max_x')}, round(error, 6) AS error, num_points > 0 AS has_colours,
CASE WHEN cameras_registered = 0 OR num_points_valid = 0 OR frames_selected = 0 THEN 'invalid_result' WHEN cameras_registered = frames_selected THEN 'success' ELSE 'partial' END AS status FROM ev WHERE cameras_registered <= frames_selected""")
def q_run_diagnostics(spark, sf_dir):
    d, _ = evidence(spark, sf_dir)
    return d.select(
        "run_id", "frames_considered", "frames_selected", F.coalesce(F.element_at("reject_reasons", "less_sharp"), F.lit(0)).cast("long").alias("less_sharp"), "cameras_registered", "num_points", "num_points_valid", r6("registration_ratio.value", "registration_ratio"),
        F.col("registration_ratio.reason").alias("ratio_reason"), r6("bounding_box.min_x", "min_x"), r6("bounding_box.max_x", "max_x"), F.round("mean_reprojection_error.value", 6).alias("error"), "has_colours", "status",
    )


@query(f"WITH {EVIDENCE} SELECT run_id, cameras_registered || ' cameras of ' || frames_selected || ' selected frames' AS reason, 7 AS exit_code FROM ev WHERE cameras_registered > frames_selected")
def q_contradictory_runs(spark, sf_dir):
    return evidence(spark, sf_dir)[1]
