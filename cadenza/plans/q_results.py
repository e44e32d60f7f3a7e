"""Queries of the scoring, job, log and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import dims
from cadenza.functions.dims import ACTION_NAMES, ACTIONS, SUPERSEDED_CODES
from cadenza.operators import jobs as J
from cadenza.operators import scoring as S
from cadenza.plans.q_measure import FR, V, rq
from cadenza.plans.q_pose import q_list
from cadenza.plans.q_series import JUDGE, K, SIG, judged, r6
from cadenza.plans.registry import query
from cadenza.plans.views import FPS, frames, frames_sql, sig, sig_sql

TIE = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
TIE_SQL = "l_partkey, l_suppkey, l_shipdate, l_extendedprice"
CODES = ["TORSO_SWAY", "SQUAT_DEPTH_LIMITED", "HINGE_RANGE_LIMITED", "ISOLATION_BODY_SWING", "COUNT_UNSTABLE", "WRIST_STACK", "TEMPO_TOO_FAST"]
ISS = f"""iss AS (SELECT l_orderkey AS job, l_linenumber AS rep, CASE l_returnflag WHEN 'R' THEN 'red' WHEN 'A' THEN 'yellow' ELSE 'green' END AS severity,
 l_returnflag || l_linestatus AS flag, {q_list(CODES)}[l_suppkey % 7 + 1] AS code, l_discount * 10 AS confidence, {TIE_SQL} FROM lineitem)"""


def read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def issues(spark, d):
    c = F.col
    sev = F.when(c("l_returnflag") == "R", "red").when(c("l_returnflag") == "A", "yellow").otherwise("green")
    code = F.element_at(F.array(*[F.lit(x) for x in CODES]), (c("l_suppkey") % 7 + 1).cast("int"))
    return read(spark, d, "lineitem").select(
        c("l_orderkey").alias("job"), c("l_linenumber").alias("rep"), sev.alias("severity"), F.concat("l_returnflag", "l_linestatus").alias("flag"),
        code.alias("code"), (c("l_discount") * 10).alias("confidence"), *TIE)


def cols(names):
    return [F.col(n) for n in names]


@query("a18_dedupe_issues", f"""WITH {ISS}, r AS (SELECT *, row_number() OVER (PARTITION BY job, flag, rep ORDER BY {TIE_SQL}) AS rn FROM iss) SELECT job, flag AS code, rep, severity, l_partkey FROM r WHERE rn = 1""")
def a18(spark, d):
    i = issues(spark, d).drop("code").withColumnsRenamed({"flag": "code", "rep": "reps"})
    return S.dedupe_issues(i, ["job"], cols(TIE)).select("job", "code", F.col("reps").alias("rep"), "severity", "l_partkey")


@query("u1_except_codes", f"WITH {ISS} SELECT job, code, count(*) AS issues FROM iss WHERE code NOT IN ({', '.join(repr(c) for c in SUPERSEDED_CODES)}) GROUP BY 1, 2")
def u1(spark, d):
    return S.drop_superseded_codes(issues(spark, d)).groupBy("job", "code").agg(F.count(F.lit(1)).alias("issues"))


BLOCKED = ", ".join(repr(c) for c in S.BLOCKING)
SUPER = """, st AS (SELECT job, code, severity, rep FROM iss WHERE flag IN ('NO', 'RF')), rp AS (SELECT job, code, severity, rep FROM iss WHERE flag NOT IN ('NO', 'RF')),
 ok AS (SELECT * FROM rp WHERE job NOT IN (SELECT job FROM {base} WHERE code IN (""" + BLOCKED + """))), j10 AS (SELECT * FROM {base} s WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.job = s.job AND ok.code = s.code) UNION ALL SELECT * FROM ok)"""


def split(spark, d):
    i = issues(spark, d)
    c = ["job", "code", "severity", "rep"]
    at_set = F.col("flag").isin("NO", "RF")
    return i.where(at_set).select(*c), i.where(~at_set).select(*c)


@query("j10_supersede_issues", f"WITH {ISS}{SUPER.format(base='st')} SELECT job, code, severity, rep, count(*) AS issues FROM j10 GROUP BY ALL")
def j10(spark, d):
    return S.supersede(*split(spark, d), ["job"]).groupBy("job", "code", "severity", "rep").agg(F.count(F.lit(1)).alias("issues"))


NOT_OLD = ", ".join(repr(c) for c in SUPERSEDED_CODES)
U2_BASE = f"""bs AS (SELECT * FROM st WHERE code NOT IN ({NOT_OLD}) UNION ALL SELECT DISTINCT job, 'TRUNK_ABSOLUTE_INSTABILITY', 'yellow', NULL::INT FROM iss WHERE confidence > .9
 UNION ALL SELECT DISTINCT job, 'COUNT_UNSTABLE', 'yellow', NULL::INT FROM iss WHERE job % 13 = 0 UNION ALL SELECT DISTINCT job, 'TARGET_UNCERTAIN', 'yellow', NULL::INT FROM iss WHERE job % 17 = 0)"""


@query("u2_all_issues", f"WITH {ISS}" + SUPER.format(base="bs").replace(", ok AS", ", " + U2_BASE + ", ok AS", 1).replace(",\n ok AS", ",\n " + U2_BASE + ",\n ok AS", 1)
       + f" SELECT job, code, severity, count(*) AS issues FROM j10 WHERE code NOT IN ({NOT_OLD}) GROUP BY ALL")
def u2(spark, d):
    i = issues(spark, d)
    st, rp = split(spark, d)
    stab = i.where("confidence > 0.9").select("job").distinct().select("job", F.lit("TRUNK_ABSOLUTE_INSTABILITY").alias("code"), F.lit("yellow").alias("severity"))
    some = lambda m: i.where(F.col("job") % m == 0).select("job").distinct()
    out = S.all_issues(st, rp, stab, some(13), some(17), ["job"])
    return out.groupBy("job", "code", "severity").agg(F.count(F.lit(1)).alias("issues"))


@query("a19_score", f"""WITH {ISS}, s AS (SELECT o_orderkey AS job, greatest(0, least(.98, ((o_totalprice % 100) / 100) * least(1, (o_custkey % 10 + 1) / 10 / .8))) AS confidence FROM orders),
 i AS (SELECT job, code, severity FROM iss WHERE flag <> 'NO' UNION ALL SELECT job, 'ACTION_MISMATCH', 'red' FROM iss WHERE job % 29 = 0), a AS (SELECT job, sum(CASE WHEN severity = 'red' THEN 28 ELSE 10 END) AS ded, bool_or(code = 'ACTION_MISMATCH') AS mis, bool_or(severity = 'red') AS red FROM i GROUP BY 1)
 SELECT job, CASE WHEN mis THEN 0 ELSE greatest(35, least(98, 95 - coalesce(ded, 0) - greatest(0, trunc((.75 - confidence) * 30)::INT))) END::BIGINT AS overall_score,
 CASE WHEN mis OR red THEN 'red' WHEN ded IS NOT NULL THEN 'yellow' ELSE 'green' END AS safety_level FROM s LEFT JOIN a USING (job)""")
def a19(spark, d):
    o = read(spark, d, "orders")
    q = (F.col("o_totalprice") % 100) / 100
    conf = S.result_confidence(q, (F.col("o_custkey") % 10 + 1) / 10)
    stats = o.select(F.col("o_orderkey").alias("job"), conf.alias("confidence"))
    i = issues(spark, d)
    c = ["job", "code", "severity"]
    extra = i.where("job % 29 = 0").select("job", F.lit("ACTION_MISMATCH").alias("code"), F.lit("red").alias("severity"))
    return S.score(stats, i.where("flag <> 'NO'").select(*c).unionByName(extra), ["job"])


@query("a20_score_simple", f"WITH {ISS} SELECT job, greatest(0, 100 - sum(CASE WHEN severity = 'yellow' THEN 18 ELSE 35 END))::BIGINT AS score FROM iss GROUP BY 1")
def a20(spark, d):
    return S.score_simple(issues(spark, d), ["job"])


VID = f"vid AS (SELECT l_orderkey AS job, l_partkey AS video, l_linenumber::DOUBLE AS sets, l_quantity - 5 AS reps, l_extendedprice / 1000 AS load_kg, {q_list(ACTION_NAMES)}[l_partkey % 37 + 1] AS action_type FROM lineitem)"


def videos(spark, d):
    c = F.col
    act = F.element_at(F.array(*[F.lit(a) for a in ACTION_NAMES]), (c("l_partkey") % 37 + 1).cast("int"))
    return read(spark, d, "lineitem").select(
        c("l_orderkey").alias("job"), c("l_partkey").alias("video"), c("l_linenumber").cast("double").alias("sets"), (c("l_quantity") - 5).alias("reps"),
        (c("l_extendedprice") / 1000).alias("load_kg"), act.alias("action_type"))


@query("a13_training_volume", f"WITH {VID} SELECT job, round(sum(sets), 6) AS sets, round(sum(sets * greatest(0, reps)), 6) AS repetitions, round(sum(sets * greatest(0, reps) * load_kg), 6) AS tonnage_kg FROM vid GROUP BY 1")
def a13(spark, d):
    return S.training_volume(videos(spark, d), ["job"]).select("job", r6("sets"), r6("repetitions"), r6("tonnage_kg"))


@query("x12_next_load", f"WITH {VID} SELECT job, video, sets, reps, CASE WHEN load_kg > 0 THEN floor((load_kg + greatest(1, load_kg * .025)) * 2 + .5) / 2 END AS next_load_kg FROM vid")
def x12(spark, d):
    return videos(spark, d).select("job", "video", "sets", "reps", J.next_load(F.col("load_kg")).alias("next_load_kg"))


DIMS = ", ".join(f"('{a}', '{f}', '{dims.group_of(f)}', '{dims.STABILITY.get(a, dims.DEFAULT_STABILITY)[0]}', {dims.STABILITY.get(a, dims.DEFAULT_STABILITY)[1]})" for a, (f, _) in ACTIONS.items())
DIM = f"dim(action_type, family, body_group, mode, angle_threshold) AS (VALUES {DIMS})"


@query("src8_dims", f"WITH {VID}, {DIM} SELECT body_group, family, mode, count(*) AS videos, count(DISTINCT action_type) AS actions, max(angle_threshold)::DOUBLE AS top_threshold FROM vid JOIN dim USING (action_type) GROUP BY 1, 2, 3")
def src8(spark, d):
    j = videos(spark, d).join(dims.action_dim(spark), "action_type")
    return j.groupBy("body_group", "family", "mode").agg(F.count(F.lit(1)).alias("videos"), F.countDistinct("action_type").alias("actions"), F.max("angle_threshold").alias("top_threshold"))


@query("j9_dimension_lookup", f"WITH {VID}, {DIM}, u AS (SELECT job, video, CASE WHEN video % 5 = 0 THEN 'mystery' ELSE action_type END AS a FROM vid) SELECT job, video, coalesce(dim.action_type, 'other') AS action_type, coalesce(family, 'general') AS family, coalesce(mode, 'disabled') AS mode FROM u LEFT JOIN dim ON a = dim.action_type")
def j9(spark, d):
    v = videos(spark, d).select("job", "video", F.when(F.col("video") % 5 == 0, "mystery").otherwise(F.col("action_type")).alias("action_type"))
    return dims.with_dim(v, dims.action_dim(spark), "action_type", "other").select("job", "video", "action_type", "family", "mode")


@query("p14_expand_engines", "WITH e AS (SELECT l_orderkey AS job, l_partkey AS video, unnest(CASE l_partkey % 3 WHEN 0 THEN ['rtmo', 'mediapipe'] WHEN 1 THEN ['mediapipe'] ELSE ['rtmo'] END) AS engine FROM lineitem) SELECT job, video, engine, CASE WHEN engine = 'mediapipe' THEN 'mediapipe' ELSE 'rtmlib' END AS backend FROM e")
def p14(spark, d):
    m = F.element_at(F.array(F.lit("both"), F.lit("mediapipe"), F.lit("rtmo")), (F.col("video") % 3 + 1).cast("int"))
    return J.expand_engines(videos(spark, d).withColumn("pose_engine_mode", m)).select("job", "video", "engine", "backend")


RES = """res AS (SELECT l_orderkey AS job, l_linenumber AS no, CASE WHEN l_quantity > 25 THEN l_quantity * 2 ELSE 0 END AS overall_score, CASE l_returnflag WHEN 'R' THEN 'red' WHEN 'A' THEN 'yellow' ELSE 'green' END AS safety_level,
 CASE WHEN l_suppkey % 4 = 0 THEN 'insufficient' ELSE 'good' END AS capture_quality FROM lineitem)"""


@query("a14_job_rollup", f"""WITH {RES} SELECT job, coalesce(floor(avg(overall_score) FILTER (WHERE overall_score > 0) + .5), 0)::BIGINT AS average_score, CASE WHEN bool_and(capture_quality = 'insufficient') THEN 'not_applicable' WHEN bool_or(safety_level = 'red') THEN 'red'
 WHEN bool_or(safety_level = 'yellow') THEN 'yellow' ELSE 'green' END AS safety_level, count(*) FILTER (WHERE capture_quality = 'insufficient') AS insufficient, count(*) AS results FROM res GROUP BY 1""")
def a14(spark, d):
    c = F.col
    r = read(spark, d, "lineitem").select(
        c("l_orderkey").alias("job"), F.when(c("l_quantity") > 25, c("l_quantity") * 2).otherwise(0.0).alias("overall_score"),
        F.when(c("l_returnflag") == "R", "red").when(c("l_returnflag") == "A", "yellow").otherwise("green").alias("safety_level"),
        F.when(c("l_suppkey") % 4 == 0, "insufficient").otherwise("good").alias("capture_quality"))
    return S.job_rollup(r, ["job"])


@query("a15_tracking_diagnostics", FR + f""" SELECT video_id, count(*) FILTER (WHERE vec_id % 13 = 0) AS switches, count(*) FILTER (WHERE vec_id % 11 = 0) AS lost, count(*) FILTER (WHERE vec_id % 7 = 0) AS rejected,
 count(*) FILTER (WHERE vec_id % 3 + 1 > 1) AS multi_person_frames, {rq('avg(v0)', 3)} AS lock_confidence FROM fr GROUP BY 1""")
def a15(spark, d):
    m = lambda k: F.col("vec_id") % k == 0
    f = frames(spark, d).select("video_id", m(13).alias("switched"), m(11).alias("lost"), m(7).alias("rejected"), (F.col("vec_id") % 3 + 1).alias("candidates"), F.col("landmarks")[0]["vis"].alias("lock_confidence"))
    return S.tracking_diagnostics(f, V)


@query("a15_motion_summary", FR + f""" SELECT video_id, count(*) FILTER (WHERE vec_id % 4 <> 0) AS available_frames, count(*) AS frame_count, {rq('count(*) FILTER (WHERE vec_id % 4 <> 0) / count(*)', 3)} AS coverage,
 {rq('coalesce(quantile_cont(v0, .5) FILTER (WHERE vec_id % 4 <> 0), 0)', 3)} AS median_inlier_ratio, CASE WHEN count(*) FILTER (WHERE vec_id % 4 <> 0) / count(*) >= .6 THEN 'ready' ELSE 'insufficient' END AS status FROM fr GROUP BY 1""")
def a15b(spark, d):
    ok = F.col("vec_id") % 4 != 0
    f = frames(spark, d).select("video_id", ok.alias("available"), F.when(ok, F.col("landmarks")[0]["vis"]).alias("inlier_ratio"))
    return S.motion_summary(f, V)


@query("p11_capture_quality", f"""WITH s AS (SELECT user_id, avg(((event_id * 37) % 100) / 100.0::DOUBLE) + .1 AS q, count(*) AS n, count(*) FILTER (WHERE event_type <> 'click') / count(*) AS cov FROM events GROUP BY 1)
 SELECT user_id, CASE WHEN cov < .45 OR q < .48 OR n < 8 THEN 'insufficient' WHEN cov < .72 OR q < .65 THEN 'limited' ELSE 'good' END AS capture_quality FROM s""")
def p11(spark, d):
    # summed in whole hundredths: a mean that equals a limit does not hang on the order of the rows
    hundredths = F.sum(F.col("event_id") * 37 % 100) / F.count(F.lit(1))
    e = read(spark, d, "events").groupBy("user_id").agg(
        ((hundredths + 10.0) / 100.0).alias("q"), F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") != "click").cast("int")).alias("cov"))
    return e.select("user_id", S.capture_quality(F.col("cov"), F.col("q"), F.col("n")).alias("capture_quality"))


QUEUE = "q AS (SELECT o_orderkey AS job_id, o_custkey AS user_key, o_orderdate AS enqueued_at, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'active' ELSE 'done' END AS state FROM orders)"


def queue(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "active").otherwise("done")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_key"), F.col("o_orderdate").alias("enqueued_at"), s.alias("state"))


@query("a21_backlog_report", f"""WITH {QUEUE}, g AS (SELECT user_key, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'active') AS active, grouping(user_key) AS t FROM q GROUP BY GROUPING SETS ((user_key), ()))
 SELECT CASE WHEN t = 1 THEN '*' ELSE user_key::VARCHAR END AS user_key, pending, active, CASE WHEN t = 1 THEN greatest(0, 32 - pending) ELSE greatest(0, 8 - pending - active) END AS slots_left, CASE WHEN t = 1 THEN pending >= 32 ELSE pending + active >= 8 END AS overloaded FROM g""")
def a21(spark, d):
    return S.backlog_report(queue(spark, d))


@query("t6_fair_pick", f"""WITH {QUEUE}, b AS (SELECT user_key, count(*) AS busy FROM q WHERE state = 'active' GROUP BY 1), p AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY enqueued_at, job_id) AS rn FROM q WHERE state = 'pending')
 SELECT job_id, user_key, rn FROM p LEFT JOIN b USING (user_key) WHERE rn <= 3 - coalesce(busy, 0)""")
def t6(spark, d):
    return S.fair_pick(queue(spark, d), 3, ["enqueued_at", "job_id"]).select("job_id", "user_key", F.col("rn").cast("long").alias("rn"))


@query("t7_prioritise", f"""WITH {ISS}, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY CASE severity WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END, rep, {TIE_SQL}) AS rn FROM iss)
 SELECT job, rn, code, CASE WHEN severity = 'red' THEN 'high' WHEN rn = 1 THEN 'primary' ELSE 'secondary' END AS priority FROM r WHERE rn <= 4""")
def t7(spark, d):
    worst = F.when(F.col("severity") == "red", 0).when(F.col("severity") == "yellow", 1).otherwise(2)
    p = S.prioritise(issues(spark, d), ["job"], [worst, F.col("rep"), *cols(TIE)])
    return p.select("job", F.col("rn").cast("long").alias("rn"), "code", "priority")


@query("t5_caps_per_group", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) SELECT conv_id, turn FROM r WHERE rn <= 5")
def t5(spark, d):
    from cadenza.core.rangejoin import top_k

    return top_k(read(spark, d, "conversations"), ["conv_id"], [F.col("turn")], 5).select("conv_id", "turn")


JB = "jb AS (SELECT o_orderkey AS job_id, o_custkey AS user_key, o_orderdate::DATE AS created_on, o_orderpriority AS body_part, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status, floor(o_totalprice % 100) AS score FROM orders)"


def job_view(spark, d):
    c = F.col
    s = F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "O", "queued").otherwise("processing")
    return read(spark, d, "orders").select(
        c("o_orderkey").alias("job_id"), c("o_custkey").alias("user_key"), c("o_orderdate").cast("date").alias("created_on"), c("o_orderpriority").alias("body_part"),
        s.alias("status"), F.floor(c("o_totalprice") % 100).cast("double").alias("score"))


@query("j8_previous_session", f"""WITH {JB}, ac AS (SELECT DISTINCT l_orderkey AS job_id, l_partkey % 37 AS a FROM lineitem), pr AS (SELECT c.job_id, max(struct_pack(t := p.created_on, i := p.job_id, s := p.score)) AS p FROM jb c JOIN jb p ON p.user_key = c.user_key AND p.status = 'completed'
 AND (p.created_on < c.created_on OR p.created_on = c.created_on AND p.job_id < c.job_id) AND (p.body_part = c.body_part OR EXISTS (SELECT 1 FROM ac x JOIN ac y USING (a) WHERE x.job_id = c.job_id AND y.job_id = p.job_id)) GROUP BY 1)
 SELECT job_id, user_key, p.i AS previous_job, CASE WHEN p.s <> 0 AND score <> 0 THEN score - p.s END AS score_change FROM jb LEFT JOIN pr USING (job_id)""")
def j8(spark, d):
    acts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_partkey") % 37).alias("action_type"))
    return J.previous_session(job_view(spark, d), acts).select("job_id", "user_key", "previous_job", "score_change")


@query("t4_list_jobs", f"WITH {JB} SELECT job_id, user_key, status, row_number() OVER (PARTITION BY user_key ORDER BY created_on DESC, job_id DESC) AS position FROM jb")
def t4(spark, d):
    return J.list_jobs(job_view(spark, d)).select("job_id", "user_key", "status", "position")


LOG = "lg AS (SELECT event_id, user_id AS job, ts AS noted, event_type AS stage FROM events)"


@query("snk2_append_log", f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY noted DESC, event_id DESC) AS rn FROM lg) SELECT job, event_id, stage FROM r WHERE rn <= 40")
def snk2(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_type").alias("stage"))
    out = J.append_log(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["job"], [F.desc("at"), F.desc("event_id")], 40)
    return out.select("job", "event_id", "stage")


@query("snk3_latest_jobs", """WITH p AS (SELECT user_id AS job_id, event_id AS version, CASE WHEN event_type <> 'view' THEN event_type END AS status, CASE WHEN event_id % 3 = 0 THEN value END AS score FROM events)
 SELECT job_id, arg_max(status, version) FILTER (WHERE status IS NOT NULL) AS status, round(arg_max(score, version) FILTER (WHERE score IS NOT NULL), 6) AS score, max(version) AS version FROM p GROUP BY 1""")
def snk3(spark, d):
    p = read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("version"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("score"))
    return J.latest_jobs(p, ["status", "score"]).select("job_id", "status", r6("score"), "version")


@query("snk4_expire", "SELECT o_orderkey AS job_id FROM orders WHERE CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END IS NULL AND o_orderkey % 5 <> 0 OR CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 200 DAY ELSE o_orderdate END >= TIMESTAMP '1998-08-01 00:00:00' - INTERVAL 21612 HOUR")
def snk4(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate") + F.expr("INTERVAL 200 DAYS")).cast("timestamp_ntz").alias("updated_at"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("created_at"))
    return J.expire(o, F.expr("TIMESTAMP_NTZ'1998-08-01 00:00:00'"), 900.5).select("job_id")


@query("snk5_recover", f"WITH {JB} SELECT job_id, CASE WHEN status IN ('queued', 'processing') THEN 'queued' ELSE status END AS status, status IN ('queued', 'processing') AS recovered FROM jb")
def snk5(spark, d):
    return J.recover(job_view(spark, d)).select("job_id", "status", "recovered")


@query("snk6_pick_engine", f"""WITH {frames_sql()}, e AS (SELECT video_id, 'first' AS engine, CASE WHEN video_id % 3 <> 0 AND vec_id % 2 = 0 THEN frame_index END AS fi FROM fr UNION ALL SELECT video_id, 'second', CASE WHEN video_id % 2 = 0 AND vec_id % 5 <> 0 THEN frame_index END FROM fr
 UNION ALL SELECT video_id, 'last', CASE WHEN video_id = 0 THEN frame_index END FROM fr), c AS (SELECT video_id, engine, count(fi) AS frames, CASE engine WHEN 'first' THEN 0 WHEN 'second' THEN 1 ELSE 2 END AS r FROM e GROUP BY 1, 2)
 SELECT video_id, arg_min(engine, r) AS engine, arg_min(frames, r) AS frames FROM c WHERE frames > 0 OR engine = 'last' GROUP BY 1""")
def snk6(spark, d):
    f = frames(spark, d).select("video_id", "vec_id", "frame_index")
    one = lambda name, cond: f.select("video_id", F.lit(name).alias("engine"), F.when(F.expr(cond), F.col("frame_index")).alias("frame_index"))
    e = one("first", "video_id % 3 <> 0 AND vec_id % 2 = 0").unionByName(one("second", "video_id % 2 = 0 AND vec_id % 5 <> 0")).unionByName(one("last", "video_id = 0"))
    return J.pick_engine(e, V, ["first", "second", "last"])


@query("p13_valid_ids", """WITH i AS (SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' x' ELSE '_0123' END AS u, CASE WHEN c_custkey % 2 = 0 THEN 'abcdef0123-' || lpad(c_custkey::VARCHAR, 12, '0') ELSE 'xyz' END AS j FROM customer)
 SELECT c_custkey, regexp_matches(replace(u, '#', '_'), '^[a-zA-Z0-9_-]{16,100}$') AS user_ok, regexp_matches(j, '^[a-fA-F0-9-]{20,50}$') AS job_ok,
 CASE WHEN regexp_matches(replace(u, '#', '_'), '^[a-zA-Z0-9_-]{16,100}$') THEN sha256(replace(u, '#', '_'))[1:32] END AS user_key FROM i""")
def p13(spark, d):
    c = read(spark, d, "customer")
    u = F.replace(F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " x").otherwise("_0123")), F.lit("#"), F.lit("_"))
    j = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("abcdef0123-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))).otherwise("xyz")
    return c.select("c_custkey", J.valid_user_id(u).alias("user_ok"), J.valid_job_id(j).alias("job_ok"), J.user_key(u).alias("user_key"))


@query("x14_bounded", """WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN ' ' || p_size || '.5 ' WHEN 2 THEN 'n/a' WHEN 3 THEN NULL ELSE '-' || p_size END AS t, CASE p_partkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '' WHEN 2 THEN 'off' ELSE ' ON ' END AS b FROM part),
 n AS (SELECT *, try_cast(trim(t) AS DOUBLE) AS v FROM r) SELECT p_partkey, CASE WHEN v BETWEEN 5 AND 30 AND v = floor(v) THEN v::BIGINT ELSE 12 END AS int_value, CASE WHEN v BETWEEN -20 AND 30 THEN v ELSE 1.5 END AS num_value,
 CASE WHEN b = '' THEN true ELSE lower(trim(b)) IN ('1', 'true', 'yes', 'on') END AS flag, CASE WHEN lower(trim(b)) IN ('yes', 'off') THEN lower(trim(b)) ELSE 'auto' END AS mode FROM n""")
def x14(spark, d):
    p = read(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    t = F.when(k % 5 == 0, size).when(k % 5 == 1, F.concat(F.lit(" "), size, F.lit(".5 "))).when(k % 5 == 2, "n/a").when(k % 5 == 4, F.concat(F.lit("-"), size))
    b = F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "").when(k % 4 == 2, "off").otherwise(" ON ")
    return p.select("p_partkey", J.bounded(t, 5, 30, 12, integer=True).alias("int_value"), J.bounded(t, -20, 30, 1.5).alias("num_value"), J.truthy(b, True).alias("flag"), J.option(b, ["yes", "off"], "auto").alias("mode"))


@query("r3_stability_issue", SIG + JUDGE + f""", c AS (SELECT *, CASE WHEN lag(state || direction) OVER p IS DISTINCT FROM (state || direction) THEN 1 ELSE 0 END AS ch FROM j WINDOW p AS (PARTITION BY user_id ORDER BY pose_idx)),
 i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY pose_idx) AS isl FROM c), sg AS (SELECT user_id, min(time_ms) AS s, max(time_ms) + 100 AS e, max(time_ms) - min(time_ms) + 100 AS dur, max(abs(angle_delta)) AS mx, avg(confidence) AS cf FROM i WHERE state = 'unstable' GROUP BY user_id, isl)
 SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'TRUNK_RELATIVE_INSTABILITY' ELSE 'TRUNK_ABSOLUTE_INSTABILITY' END AS code, count(*) AS segments, sum(dur)::BIGINT AS unstable_ms, {rq('avg(cf)', 3)} AS confidence, {rq('max(mx)', 2)} AS max_angle_delta,
 array_to_string(list(s || '-' || e ORDER BY s)[1:12], ',') AS ranges FROM sg GROUP BY 1, 2""")
def r3(spark, d):
    from cadenza.operators.smoothing import judgment_segments

    seg = judgment_segments(judged(spark, d), K, ["state", "direction"], FPS)
    mode = F.when(F.col("user_id") % 2 == 0, "relative_coupled").otherwise("absolute_fixed")
    out = S.stability_issue(seg, K, mode)
    text = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start_ms"].cast("string"), r["end_ms"].cast("string"))), ",")
    return out.select("user_id", "code", "segments", "unstable_ms", "confidence", "max_angle_delta", text.alias("ranges"))


CMP = """cm AS (SELECT o_orderkey AS job, (o_custkey % 100) / 100 AS coverage_a, (o_orderkey % 97) / 97 AS coverage_b, (o_totalprice % 100) / 100 AS confidence_a, (o_totalprice % 71) / 71 AS confidence_b, o_custkey % 11 <> 0 AS has_comparison,
 CASE WHEN o_custkey % 9 = 0 THEN 'insufficient' ELSE 'good' END AS capture_quality, CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS switches, (o_orderkey % 5) / 4 AS lock_confidence, o_totalprice % 40 AS worst_delta, o_orderkey % 6 AS reps_a, o_custkey % 7 AS reps_b,
 o_orderkey % 4 = 0 AS unstable_a, o_custkey % 4 = 0 AS unstable_b, ['pull', 'hinge', 'press', 'squat', 'isolation_elbow', 'isolation_knee'][o_custkey % 6 + 1] AS family FROM orders)"""


def comparisons(spark, d):
    k, c, t = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    fam = F.element_at(F.array(*[F.lit(x) for x in ["pull", "hinge", "press", "squat", "isolation_elbow", "isolation_knee"]]), (c % 6 + 1).cast("int"))
    return read(spark, d, "orders").select(
        k.alias("job"), ((c % 100) / 100).alias("coverage_a"), ((k % 97) / 97).alias("coverage_b"), ((t % 100) / 100).alias("confidence_a"), ((t % 71) / 71).alias("confidence_b"),
        (c % 11 != 0).alias("has_comparison"), F.when(c % 9 == 0, "insufficient").otherwise("good").alias("capture_quality"), F.when(k % 8 == 0, 1).otherwise(0).alias("switches"),
        ((k % 5) / 4).alias("lock_confidence"), (t % 40).alias("worst_delta"), (k % 6).alias("reps_a"), (c % 7).alias("reps_b"), (k % 4 == 0).alias("unstable_a"), (c % 4 == 0).alias("unstable_b"), fam.alias("family"))


@query("r7_recommend", f"WITH {CMP} SELECT job, CASE WHEN worst_delta >= 30 THEN 'needs_manual_review' WHEN coverage_b >= coverage_a + .15::DOUBLE OR confidence_b >= confidence_a + .12::DOUBLE THEN 'import_secondary_metrics' ELSE 'keep_primary' END AS recommendation FROM cm")
def r7(spark, d):
    c = comparisons(spark, d)
    return c.select("job", S.recommend(c).alias("recommendation"))


FUSED = f"""{CMP}, z AS (SELECT *, coverage_a * .55::DOUBLE + confidence_a * .45::DOUBLE AS qa, coverage_b * .55::DOUBLE + confidence_b * .45::DOUBLE AS qb, switches > 0 OR (lock_confidence <> 0 AND lock_confidence < .55) AS risky, family IN ('pull', 'hinge', 'isolation_elbow') AS arm FROM cm),
 b AS (SELECT *, CASE WHEN NOT has_comparison THEN 1 WHEN capture_quality = 'insufficient' THEN 2 WHEN risky THEN 3 WHEN worst_delta >= 30 THEN 4 WHEN reps_b > reps_a AND NOT unstable_b AND arm THEN 5 WHEN qb >= qa + .1::DOUBLE AND arm THEN 6 WHEN unstable_a AND qb >= qa - .05::DOUBLE THEN 7 ELSE 8 END AS br FROM z),
 fu AS (SELECT job, ['primary', 'needs_review', 'primary', 'hybrid_review', 'secondary', 'secondary', 'hybrid_review', 'primary'][br] AS selected_engine, [.52, .35, .72, .46, .74, .72, .58, .68][br]::DOUBLE AS fusion_confidence,
 CASE WHEN br > 3 AND reps_b > 0 AND NOT unstable_b AND family IN ('pull', 'hinge', 'isolation_elbow', 'isolation_knee', 'isolation_shoulder') THEN 'secondary' ELSE 'primary' END AS rep_source, reps_a, reps_b FROM b)"""


@query("r6_fuse_engines", f"WITH {FUSED} SELECT job, selected_engine, fusion_confidence, rep_source, CASE WHEN rep_source = 'secondary' THEN reps_b ELSE reps_a END AS fused_reps FROM fu")
def r6q(spark, d):
    return S.fuse_engines(comparisons(spark, d)).select("job", "selected_engine", "fusion_confidence", "rep_source", "fused_reps")


@query("u3_published_reps", f"""WITH {FUSED}, pa AS (SELECT l_orderkey AS job, l_linenumber AS rep, l_quantity AS amplitude, {TIE_SQL} FROM lineitem WHERE l_returnflag <> 'R'), pb AS (SELECT l_orderkey AS job, l_linenumber AS rep, l_quantity AS amplitude, {TIE_SQL} FROM lineitem WHERE l_returnflag = 'R'),
 c AS (SELECT job, CASE WHEN rep_source = 'secondary' AND job IN (SELECT job FROM pb) THEN 'secondary' ELSE 'primary' END AS src FROM fu) SELECT job, rep, amplitude, src AS source_engine FROM pa JOIN c USING (job) WHERE src = 'primary' UNION ALL SELECT job, rep, amplitude, src FROM pb JOIN c USING (job) WHERE src = 'secondary'""")
def u3(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("rep"), F.col("l_quantity").alias("amplitude"), "l_returnflag")
    a, b = li.where("l_returnflag <> 'R'").drop("l_returnflag"), li.where("l_returnflag = 'R'").drop("l_returnflag")
    return S.published_reps(a, b, S.fuse_engines(comparisons(spark, d)), ["job"])


@query("u4_shared_frames", f"WITH {frames_sql()}, {frames_sql('b', 'fb')} SELECT video_id, frame_index FROM fr INTERSECT SELECT video_id, frame_index FROM fb")
def u4(spark, d):
    c = ["video_id", "frame_index"]
    return frames(spark, d).select(*c).intersect(frames(spark, d, "b").select(*c))


@query("j12_job_summary", f"""WITH {VID}, e AS (SELECT job, video, unnest(CASE video % 3 WHEN 0 THEN ['rtmo', 'mediapipe'] WHEN 1 THEN ['mediapipe'] ELSE ['rtmo'] END) AS engine, sets, reps FROM vid)
 SELECT job, video, count(DISTINCT engine) AS engines, array_to_string(list_sort(list(DISTINCT engine)), ',') AS engine_list, CASE WHEN count(DISTINCT engine) > 1 THEN 'both' ELSE min(engine) END AS engine_mode FROM e GROUP BY 1, 2""")
def j12(spark, d):
    from cadenza.operators.review import job_summary

    m = F.element_at(F.array(F.lit("both"), F.lit("mediapipe"), F.lit("rtmo")), (F.col("video") % 3 + 1).cast("int"))
    e = J.expand_engines(videos(spark, d).withColumn("pose_engine_mode", m)).select("job", "video", "engine").distinct()
    out = job_summary(e, ["job", "video"])
    return out.select("job", "video", F.size("engine_results").cast("long").alias("engines"), F.array_join(F.transform("engine_results", lambda x: x["engine"]), ",").alias("engine_list"), "engine_mode")


FB = """fb AS (SELECT event_id, user_id AS job, ts AS noted, CASE event_type WHEN 'click' THEN 'helpful' WHEN 'view' THEN 'missed' WHEN 'error' THEN 'incorrect' ELSE 'other' END AS t FROM events),
 ff AS (SELECT event_id, job, CASE WHEN t IN ('helpful', 'missed', 'incorrect') THEN t ELSE 'helpful' END AS type, row_number() OVER (PARTITION BY job ORDER BY noted DESC, event_id DESC) AS rn FROM fb)"""


@query("r15_feedback", f"WITH {FB} SELECT job, type, count(*) AS entries FROM ff WHERE rn <= 50 GROUP BY 1, 2")
def r15(spark, d):
    e = read(spark, d, "events")
    t = F.when(F.col("event_type") == "click", "helpful").when(F.col("event_type") == "view", "missed").when(F.col("event_type") == "error", "incorrect").otherwise("other")
    f = e.select("event_id", F.col("user_id").alias("job"), F.col("ts").alias("at"), t.alias("type"), F.col("props").alias("note"))
    return J.feedback(f, "job", [F.desc("at"), F.desc("event_id")]).groupBy("job", "type").agg(F.count(F.lit(1)).alias("entries"))


def q_chat(n, cap):
    return f"""WITH c AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations), b AS (SELECT conv_id FROM c WHERE role NOT IN ('user', 'assistant') OR text = '' OR length(text) > {cap}),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM c WHERE conv_id NOT IN (SELECT conv_id FROM b)) SELECT conv_id, turn, role, length(text)::BIGINT AS chars FROM r WHERE rn <= {n}"""


def chat(spark, d, n, cap):
    kept, _ = J.chat_window(read(spark, d, "conversations"), "conv_id", n, cap)
    return kept.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("r14_chat_window", q_chat(12, 8000))
def r14(spark, d):
    return chat(spark, d, 12, 8000)


@query("r14_chat_window_short", q_chat(4, 500))
def r14b(spark, d):
    return chat(spark, d, 4, 500)


@query("r14_rejected_chats", """WITH c AS (SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'INVALID_ROLE' WHEN trim(text) = '' THEN 'MESSAGE_REQUIRED' WHEN length(trim(text)) > 500 THEN 'TEXT_TOO_LONG' END AS r FROM conversations)
 SELECT conv_id, arg_min(r, turn) AS reason FROM c WHERE r IS NOT NULL GROUP BY 1""")
def r14c(spark, d):
    return J.chat_window(read(spark, d, "conversations"), "conv_id", 12, 500)[1]
