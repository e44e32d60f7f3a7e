"""Queries of the text, source, review and streaming operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from cadenza.core.layout import with_ordinal
from cadenza.core.rangejoin import first_per, top_k
from cadenza.core.session import materialise, settings
from cadenza.functions import dims, text
from cadenza.operators import jobs as J
from cadenza.operators import review, scoring
from cadenza.plans.q_joins import IV, rep_view
from cadenza.plans.q_measure import FR, V, q_in
from cadenza.plans.q_pose import lm, q_list
from cadenza.plans.q_results import CODES, DIM, ISS, JB, TIE, TIE_SQL, VID, cols, issues, job_view, read, videos
from cadenza.plans.q_series import K, SIG, r6
from cadenza.plans.registry import query
from cadenza.plans.views import FPS, frames, frames_sql, sig, sig_sql
from cadenza.sources import scans


@query("x5_repair_text", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def x5(spark, d):
    with text.charsets(spark):
        return materialise(read(spark, d, "documents").select("doc_id", F.sha2(text.repair_text(F.col("text")), 256).alias("text_hash")))


@query("x5_repair_damaged_text")
def x5b(spark, d):
    t = F.regexp_replace("text", "(?i)the|que|der|los", "动作建议，稳定。")
    damaged = F.decode(F.encode(F.concat(t, F.lit(" 动作建议，训练问题的视频")), "UTF-8"), "GB18030")
    with text.charsets(spark):
        out = read(spark, d, "documents").select("doc_id", text.damage_score(damaged).cast("long").alias("damage"), F.length(text.repair_text(damaged)).cast("long").alias("chars"))
        return materialise(out)


def q_terms(e):
    for term, word in text.TERMS.items():
        e = f"regexp_replace({e}, '\\b{term}\\b', '{word}', 'gi')"
    return e


@query("x6_translate_terms", f"SELECT doc_id, sha256({q_terms(chr(34) + 't' + chr(34))}) AS text_hash FROM (SELECT doc_id, regexp_replace(regexp_replace(text, ' (the|que) ', ' Lat Pulldown ', 'g'), ' (in|le) ', ' pull-up ', 'g') AS t FROM documents)")
def x6(spark, d):
    t = F.regexp_replace(F.regexp_replace("text", " (the|que) ", " Lat Pulldown "), " (in|le) ", " pull-up ")
    return read(spark, d, "documents").select("doc_id", F.sha2(text.translate_terms(t), 256).alias("text_hash"))


@query("x7_clean_text", "SELECT doc_id, sha256(replace(replace(trim(t), 'pose engine', '动作分析'), 'invalid frame', '动作分析')) AS text_hash FROM (SELECT doc_id, replace(replace(text, ' the ', ' pose engine '), ' la ', ' invalid frame ') AS t FROM documents)")
def x7(spark, d):
    t = F.replace(F.replace("text", F.lit(" the "), F.lit(" pose engine ")), F.lit(" la "), F.lit(" invalid frame "))
    return read(spark, d, "documents").select("doc_id", F.sha2(text.clean_text(t), 256).alias("text_hash"))


@query("x8_drop_sentences", """WITH s AS (SELECT doc_id, list_transform(regexp_extract_all(trim(regexp_replace(replace(text, '.', ';'), '\\s+', ' ', 'g')), '[^。！？!?；;]+[。！？!?；;]?'), lambda x: trim(x)) AS a FROM documents)
 SELECT doc_id, len(list_filter(a, lambda x: x <> ''))::BIGINT AS sentences, sha256(array_to_string(list_filter(a, lambda x: x <> '' AND NOT regexp_matches(x, '(?i)est|ing') AND NOT regexp_matches(x, '[0-9]')), '')) AS text_hash FROM s""")
def x8(spark, d):
    t = F.replace("text", F.lit("."), F.lit(";"))
    parts = text.split_sentences(text.squeeze(t))
    n = F.size(F.filter(parts, lambda s: F.trim(s) != "")).cast("long")
    return read(spark, d, "documents").select("doc_id", n.alias("sentences"), F.sha2(text.drop_sentences(t, ["(?i)est|ing", "[0-9]"]), 256).alias("text_hash"))


@query("u5_distinct_text", """WITH s AS (SELECT doc_id, generate_subscripts(a, 1) AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)), k AS (SELECT doc_id, no, line, lower(regexp_replace(line, '[\\s，。！？!?；;：:、]', '', 'g')) AS tk FROM s)
 SELECT doc_id, count(DISTINCT tk) AS lines, min(no) AS first_no FROM k WHERE tk <> '' GROUP BY 1""")
def u5(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    lines = lines.withColumn("k", text.text_key(F.col("line"))).where("k <> ''")
    kept = first_per(lines, ["doc_id", "k"], [F.col("no")])
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), (F.min("no") + 1).cast("long").alias("first_no"))


@query("x9_escape_html", """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#039;')) AS html_hash FROM pages""")
def x9(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(text.escape_html(F.col("html")), 256).alias("html_hash"))


@query("x9_report_markdown", f"""WITH {JB}, {VID}, v AS (SELECT job AS job_id, list(action_type || ': ' || video ORDER BY video, action_type) AS lines FROM vid GROUP BY 1)
 SELECT job_id, sha256('# Session ' || job_id || chr(10) || chr(10) || '- Body part: ' || body_part || chr(10) || '- Status: ' || status || chr(10) || chr(10) || '## Videos' || chr(10) || chr(10) || array_to_string(list_transform(lines, lambda x: '- ' || x), chr(10))) AS report FROM jb JOIN v USING (job_id)""")
def x9b(spark, d):
    # at most ten videos per job by the upload bound
    lines = videos(spark, d).groupBy(F.col("job").alias("job_id")).agg(F.array_sort(F.collect_list(F.struct("video", "action_type"))).alias("v"))
    j = job_view(spark, d).join(lines, "job_id")
    lines = F.transform("v", lambda x: F.concat(x["action_type"], F.lit(": "), x["video"].cast("string")))
    md = text.report_markdown(F.concat(F.lit("Session "), F.col("job_id").cast("string")), {"Body part": F.col("body_part"), "Status": F.col("status")}, {"Videos": lines})
    return j.select("job_id", F.sha2(md, 256).alias("report"))


CAT = "CASE " + " ".join(f"WHEN regexp_matches(upper({{t}}), '{p}') THEN '{n}'" for n, p in text.CATEGORIES.items()) + " ELSE 'movement_task' END"


@query("x10_issue_category", f"WITH {ISS} SELECT job, {CAT.format(t=chr(40) + 'code || ' + chr(39) + ' ' + chr(39) + ' || flag' + chr(41))} AS category, count(*) AS issues FROM iss GROUP BY 1, 2")
def x10(spark, d):
    c = text.issue_category(F.col("code"), F.col("flag"))
    return issues(spark, d).groupBy("job", c.alias("category")).agg(F.count(F.lit(1)).alias("issues"))


@query("x11_parse_json", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def x11(spark, d):
    e = read(spark, d, "events")
    i = F.col("event_id") % 5
    t = F.when(i == 0, "no json").when(i == 1, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))).otherwise(F.col("props"))
    return e.select("event_id", F.get_json_object(text.parse_json_object(t), "$.k").alias("k"))


@query("x13_digest", """SELECT o_orderkey AS job, sha256('{"job":' || o_orderkey || ',"part":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def x13(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("job"), J.digest(F.struct(F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("part"), F.col("o_orderstatus").alias("status"))).alias("digest"))


# ---- sources ------------------------------------------------------------------------


@query("src1_scan_frames", f"WITH {frames_sql()}, r AS (SELECT video_id, pose_idx AS frame_index, CASE WHEN video_id % 2 = 0 THEN 25.0 ELSE 30.0 END::DOUBLE AS source_fps FROM fr), s AS (SELECT *, greatest(1, round_even(source_fps / 10, 0)::INT) AS step FROM r) SELECT video_id, frame_index, round(source_fps / step, 6) AS fps FROM s WHERE frame_index % step = 0")
def src1(spark, d):
    raw = frames(spark, d).select("video_id", F.col("pose_idx").alias("frame_index"), F.when(F.col("video_id") % 2 == 0, 25.0).otherwise(30.0).alias("source_fps"))
    base = stream_folder(spark)
    raw.write.parquet(f"{base}/frames")
    return scans.scan_frames(spark, f"{base}/frames").select("video_id", "frame_index", r6("fps"))


@query("src2_scan_results", f"WITH {VID} SELECT job, video, action_type, sets AS score, count(*) AS results FROM vid GROUP BY ALL")
def src2(spark, d):
    v = F.struct(F.col("action_type").alias("actionType"), F.col("sets").alias("overallScore"), F.lit("good").alias("captureQuality"))
    k = F.col("video") % 4
    doc = F.when(k == 0, F.to_json(v)).when(k == 1, F.to_json(F.struct(F.lit(True).alias("ok"), v.alias("result")))).when(k == 2, F.to_json(F.struct(F.struct(F.array(v).alias("videos")).alias("analysis")))).otherwise(F.to_json(F.struct(F.array(v).alias("videos"))))
    out = scans.parse_results(videos(spark, d).select("job", F.col("video").alias("vid"), doc.alias("value")))
    return out.groupBy("job", F.col("vid").alias("video"), F.col("video.actionType").alias("action_type"), F.col("video.overallScore").alias("score")).agg(F.count(F.lit(1)).alias("results"))


@query("src3_scan_jobs", f"WITH {JB} SELECT job_id::VARCHAR AS id, status, body_part FROM jb WHERE job_id % 10 <> 0")
def src3(spark, d):
    j = F.to_json(F.struct(F.col("job_id").cast("string").alias("id"), "status", F.col("body_part").alias("bodyPart"), F.date_format("created_on", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt")))
    doc = F.when(F.col("job_id") % 10 == 0, F.concat(F.substring(j, 1, 9), F.lit("{{"))).otherwise(j)
    return scans.parse_jobs(job_view(spark, d).select(doc.alias("value"))).select("id", "status", F.col("bodyPart").alias("body_part"))


@query("src4_eval_manifest", """SELECT 'u' || user_id AS case_id, count(*) AS events, array_to_string(list_sort(list((event_id % 50) * 100 || '-' || greatest((event_id % 50) * 100, (event_id % 50) * 100 - 50 + 100 * (event_id % 4)))), ',') AS expected FROM events WHERE event_type = 'error' GROUP BY 1""")
def src4(spark, d):
    e = read(spark, d, "events").where("event_type = 'error'")
    s = (F.col("event_id") % 50) * 100
    one = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.array(F.array(s, s - 50 + 100 * (F.col("event_id") % 4))).alias("unstableRangesMs"))
    docs = e.select(F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.array(one).alias("cases")))).otherwise(F.to_json(F.array(one))).alias("value"))
    c = scans.parse_manifest(docs)
    r = F.col("expected")[0]
    flat = c.select("case_id", F.concat_ws("-", r["start_ms"].cast("string"), r["end_ms"].cast("string")).alias("t"))
    # error events of one user in this fixture: a handful of short strings
    return flat.groupBy("case_id").agg(F.count(F.lit(1)).alias("events"), F.array_join(F.array_sort(F.collect_list("t")), ",").alias("expected"))


@query("src4_eval_results", """SELECT 'n' || n_nationkey AS case_id, n_name AS action_type, sum(s_acctbal) > 0 AS rich, max(CASE WHEN n_nationkey % 2 = 0 THEN 'squat' ELSE 'row' END) AS result_action, count(*) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def src4_results(spark, d):
    """One result file per nation, in folders that differ while file names may
    not, and one manifest that names them relative to its folder."""
    base = f"{stream_folder(spark)}"
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    per = s.groupBy("n_nationkey", "n_name").agg((F.sum("s_acctbal") > 0).alias("rich"), F.count(F.lit(1)).alias("suppliers"))
    action = F.when(F.col("n_nationkey") % 2 == 0, "squat").otherwise("row")
    doc = F.to_json(F.struct(action.alias("actionType"), F.col("suppliers").cast("double").alias("overallScore")))
    per.select(F.col("n_nationkey").alias("n"), doc.alias("value")).repartition("n").write.partitionBy("n").text(f"{base}/results")
    file = F.regexp_extract("path", r"(n=[0-9]+/[^/]+)$", 1)
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{base}/results").select(F.regexp_extract(file, r"n=([0-9]+)/", 1).cast("long").alias("k"), F.concat(F.lit("./x/../"), file).alias("resultPath"))
    one = F.struct(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("actionType"), F.when(F.col("rich"), "rich").alias("view"), "resultPath")
    cases = per.join(named, F.col("n_nationkey") == F.col("k")).select(F.to_json(F.array(one)).alias("value"))
    cases.write.text(f"{base}/manifest")
    lines = spark.read.text(f"{base}/manifest")
    assert scans.parse_manifest(lines).columns[0] == "case_id"
    lines.agg(F.array_join(F.array_sort(F.collect_list(F.substring("value", 2, 100_000))), ",").alias("v")).select(F.concat(F.lit("["), F.replace("v", F.lit("}],{"), F.lit("},{"))).alias("value")).coalesce(1).write.text(f"{base}/whole")
    out = scans.scan_eval_manifest(spark, f"{base}/whole", f"{base}/results")
    return out.select("case_id", "action_type", (F.col("view") == "rich").alias("rich"), F.col("video.actionType").alias("result_action"), F.col("video.overallScore").cast("long").alias("suppliers"))


@query("src5_scan_priors", f"""WITH {frames_sql()} SELECT vec_id, 15::INT AS slot, CASE WHEN vec_id % 2 = 0 THEN frame_index END AS frame_index, CASE WHEN vec_id % 2 = 1 THEN time_ms END AS time_ms, round(greatest(0, least(1, x15)), 6) AS x, round(greatest(0, least(1, y15)), 6) AS y,
 round(greatest(.75, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE least(1, v15) END), 6) AS conf FROM fr WHERE vec_id % 7 <> 0""")
def src5(spark, d):
    p = lm()[15]
    obj = F.to_json(F.struct(p["x"].alias("x"), p["y"].alias("y"), p["vis"].alias("confidence")))
    arr = F.to_json(F.array(p["x"], p["y"]))
    name = F.when(F.col("vec_id") % 7 == 0, "unknown_point").when(F.col("vec_id") % 4 == 0, "L-Wrist").otherwise("left wrist")
    point = F.concat(F.lit('{"'), name, F.lit('":'), F.when(F.col("vec_id") % 3 == 0, arr).otherwise(obj), F.lit("}"))
    body = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit('[{"frameIndex":'), F.col("frame_index").cast("string"), F.lit(',"landmarks":'), point, F.lit("}]"))).otherwise(
        F.concat(F.lit('{"time_ms":'), F.col("time_ms").cast("string"), F.lit(',"keypoints":'), point, F.lit("}")))
    out = scans.parse_priors(frames(spark, d).select("vec_id", body.alias("value")), ["vec_id"])
    return out.select("vec_id", "slot", "frame_index", "time_ms", r6("x"), r6("y"), r6("conf"))


@query("src6_normalize_videos", """WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Auto' WHEN 1 THEN 'deadlift ' WHEN 2 THEN 'dance' WHEN 3 THEN 'row' END AS a, CASE p_partkey % 3 WHEN 0 THEN 'side' WHEN 1 THEN 'top' END AS c, p_retailprice FROM part)
 SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'auto_detect' WHEN 1 THEN 'deadlift' WHEN 2 THEN 'other' WHEN 3 THEN 'row' ELSE 'auto_detect' END AS action_type, CASE WHEN c = 'side' THEN 'side' ELSE 'unknown' END AS camera_angle, round(least(2000, p_retailprice * 2), 6) AS load_kg,
 CASE p_partkey % 4 WHEN 0 THEN 'mediapipe' WHEN 1 THEN 'rtmo' WHEN 2 THEN 'both' ELSE 'rtmo' END AS pose_engine_mode, p_partkey % 6 = 0 AS has_roi FROM p""")
def src6(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    half = F.when(k % 6 == 0, "0.4").when(k % 6 == 1, "0.7").otherwise("x")
    raw = p.select(
        "p_partkey", F.when(k % 5 == 0, "Auto").when(k % 5 == 1, "deadlift ").when(k % 5 == 2, "dance").when(k % 5 == 3, "row").alias("action_type"), F.when(k % 3 == 0, "side").when(k % 3 == 1, "top").alias("camera_angle"),
        (F.col("p_retailprice") * 2).cast("string").alias("load_kg"), F.lit("-3").alias("sets"), F.lit("12").alias("reps"), F.lit("").alias("rpe"), F.col("p_name").alias("notes"),
        F.when(k % 4 == 0, " MediaPipe").when(k % 4 == 1, "rtmlib").alias("pose_engine_mode"), F.when(k % 4 == 3, "false").alias("pose_engine_compare"), *[half.alias(f"roi_{x}") for x in "xywh"])
    return J.normalize_videos(raw).select("p_partkey", "action_type", "camera_angle", r6("load_kg"), "pose_engine_mode", F.col("target_roi").isNotNull().alias("has_roi"))


@query("src7_normalize_equipment", """WITH r AS (SELECT c_nationkey AS job, c_custkey AS no, CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE ' eq' || (c_custkey % 20) || ' ' END AS id, c_acctbal / 100 AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer),
 k AS (SELECT job, no, trim(id) AS equipment_id, greatest(1, least(20, CASE WHEN s = 0 THEN 4 ELSE s END)) AS default_sets, row_number() OVER (PARTITION BY job, trim(id) ORDER BY no) AS rn FROM r WHERE p <= 60 AND trim(id) <> '') SELECT job, equipment_id, no, round(default_sets, 6) AS default_sets FROM k WHERE rn = 1""")
def src7(spark, d):
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    raw = c.select(F.col("c_nationkey").alias("job"), k.alias("no"), F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit(" eq"), (k % 20).cast("string"), F.lit(" "))).alias("equipment_id"), F.col("c_name").alias("name"),
                   (F.col("c_acctbal") / 100).cast("string").alias("default_sets"), F.lit("").alias("default_rest_seconds"))
    return J.normalize_equipment(raw, ["job"], "no").select("job", "equipment_id", "no", r6("default_sets"))


@query("snk1_result_record", """SELECT l_orderkey AS job, l_linenumber AS no, '{"score":' || CASE WHEN l_quantity > 40 THEN 'null' ELSE l_quantity::VARCHAR END || ',"level":"' || l_returnflag || '"}' AS record, count(*) AS results FROM lineitem GROUP BY ALL""")
def snk1(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("no"), F.when(F.col("l_quantity") > 40, float("nan")).otherwise(F.col("l_quantity")).alias("score"), F.col("l_returnflag").alias("level"))
    return scans.result_record(li, ["job", "no"], ["score", "level"]).groupBy("job", "no", "record").agg(F.count(F.lit(1)).alias("results"))


@query("p12_public_view", f"WITH {VID} SELECT job, video, action_type, sets AS score, CASE WHEN action_type IN {q_in([a for a, (f, _) in dims.ACTIONS.items() if dims.group_of(f) == 'lower_body'])} THEN 'lower_body' WHEN action_type IN {q_in([a for a, (f, _) in dims.ACTIONS.items() if dims.group_of(f) == 'upper_body'])} THEN 'upper_body' ELSE 'general' END AS body_group, 'score,note' AS fields FROM vid")
def p12(spark, d):
    v = dims.with_dim(videos(spark, d), dims.action_dim(spark), "action_type", "other")
    nested = v.select("job", "video", "action_type", "family", F.col("reps").alias("repCount"), F.struct(F.col("sets").alias("score"), F.col("reps").alias("repCount"), F.lit("x").alias("note")).alias("result"), F.col("sets").alias("poseStart"))
    out = review.without_fields(nested, prefix="pose")
    fields = ",".join(f for f in out.schema["result"].dataType.fieldNames())
    assert "repCount" not in out.columns and "poseStart" not in out.columns
    return out.select("job", "video", "action_type", F.col("result.score").alias("score"), dims.family_group(F.col("family")).alias("body_group"), F.lit(fields).alias("fields"))


# ---- review -------------------------------------------------------------------------

RS = f"""rs AS (SELECT o_orderkey AS job, floor(o_totalprice % 100) AS overall_score, CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'yellow' ELSE 'red' END AS safety_level, CASE WHEN o_custkey % 19 = 0 THEN 'insufficient' ELSE 'good' END AS capture_quality, o_custkey % 5 = 0 AS cu, o_custkey % 7 = 0 AS sw,
 o_orderkey % 3 = 0 AS kf, o_orderkey % 4 AS lost, ['squat', 'hinge', 'press', 'isolation_hip', 'pull'][o_custkey % 5 + 1] AS sf, ['squat', 'press', 'hinge', 'pull'][o_orderkey % 4 + 1] AS df, (o_totalprice % 10) / 10 AS sc, (o_totalprice % 7) / 7 AS wc, o_custkey % 100 AS an FROM orders),
 gr AS (SELECT *, CASE WHEN sf IN ('squat', 'hinge') THEN 'lower' WHEN sf IN ('press', 'pull') THEN 'upper' ELSE 'general' END AS sg, CASE WHEN df IN ('squat', 'hinge') THEN 'lower' ELSE 'upper' END AS dg FROM rs),
 rr AS (SELECT job, unnest(list_filter([CASE WHEN capture_quality = 'insufficient' THEN 'INSUFFICIENT_EVIDENCE' END, CASE WHEN cu THEN 'COUNT_UNSTABLE' END, CASE WHEN sw THEN 'TARGET_UNCERTAIN' END, CASE WHEN kf AND lost > 0 THEN 'STAGE_EVIDENCE_VISUAL_REVIEW' END,
  CASE WHEN sf <> df AND sc < .45 AND sg <> dg AND sg <> 'general' THEN 'ACTION_CLASS_UNCERTAIN' END, CASE WHEN sf <> df AND sc < .45 AND NOT (sg <> dg AND sg <> 'general') THEN 'ACTION_SUBTYPE_VISUAL_REVIEW' END, CASE WHEN wc < .22 AND an < 55 THEN 'ACTIVE_WINDOW_UNCERTAIN' END], lambda x: x IS NOT NULL)) AS code FROM gr)"""


def arb_results(spark, d):
    k, c, t = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    s = F.when(F.col("o_orderstatus") == "F", "green").when(F.col("o_orderstatus") == "O", "yellow").otherwise("red")
    return read(spark, d, "orders").select(
        k.alias("job"), F.floor(t % 100).cast("double").alias("overall_score"), s.alias("safety_level"), F.when(c % 19 == 0, "insufficient").otherwise("good").alias("capture_quality"), F.array().cast("array<string>").alias("codes"),
        (c % 5 == 0).alias("count_unstable"), F.when(c % 7 == 0, 1).otherwise(0).alias("switches"), (k % 3 == 0).alias("has_keyframes"), (k % 4).alias("lost"), F.lit(0).alias("rejected"), F.lit(0).alias("rejected_reps"),
        pick(["squat", "hinge", "press", "isolation_hip", "pull"], c % 5).alias("selected_family"), pick(["squat", "press", "hinge", "pull"], k % 4).alias("detected_family"), F.lit(False).alias("mismatch"), ((t % 10) / 10).alias("signature_confidence"),
        F.lit(True).alias("window_enabled"), ((t % 7) / 7).alias("window_confidence"), F.lit(100).alias("full_frames"), (c % 100).alias("analysis_frames"), F.lit(0).alias("trimmed_start"), F.lit(0).alias("trimmed_end"), F.lit(False).alias("has_count_issue"))


@query("r8_arbitration_reasons", f"WITH {RS} SELECT job, code FROM rr")
def r8(spark, d):
    return review.arbitration_reasons(arb_results(spark, d), ["job"]).select("job", "code")


@query("r9_apply_arbitration", f"""WITH {RS}, dec AS (SELECT l_orderkey AS job, l_linenumber AS no, CASE l_suppkey % 4 WHEN 0 THEN 'cap_score' WHEN 1 THEN 'confirm_algorithm' WHEN 2 THEN 'nonsense' ELSE 'mark_insufficient' END AS action, CASE WHEN l_partkey % 9 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'X' END AS rc, 40 + l_quantity AS cap, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM lineitem),
 c AS (SELECT job, bool_or(code = 'INSUFFICIENT_EVIDENCE') AS ins, min(CASE code WHEN 'ACTION_CLASS_UNCERTAIN' THEN 75 WHEN 'ACTIVE_WINDOW_UNCERTAIN' THEN 80 WHEN 'COUNT_UNSTABLE' THEN 85 END) AS cap, bool_or(code NOT IN ('STAGE_EVIDENCE_VISUAL_REVIEW', 'ACTION_SUBTYPE_VISUAL_REVIEW')) AS rv FROM rr GROUP BY 1),
 dd AS (SELECT job, bool_or(action = 'mark_insufficient' AND (coalesce(ins, false) OR rc = 'INSUFFICIENT_EVIDENCE')) AS mk, min(CASE WHEN action = 'cap_score' THEN dec.cap WHEN action = 'mark_insufficient' AND NOT (coalesce(ins, false) OR rc = 'INSUFFICIENT_EVIDENCE') THEN 80 END) AS cp,
  bool_or(action = 'cap_score' AND dec.cap < 80 OR action = 'mark_insufficient' AND NOT (coalesce(ins, false) OR rc = 'INSUFFICIENT_EVIDENCE')) AS wn FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY no, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM dec WHERE action <> 'nonsense') WHERE rn <= 8) dec LEFT JOIN c USING (job) GROUP BY 1),
 z AS (SELECT rs.*, coalesce(ins, false) OR coalesce(mk, false) AS bad, least(c.cap, cp) AS cap, c.cap IS NOT NULL OR coalesce(wn, false) AS warn, coalesce(rv, false) AS review FROM rs LEFT JOIN c USING (job) LEFT JOIN dd USING (job))
 SELECT job, CASE WHEN bad THEN 0 ELSE least(overall_score, coalesce(cap, 1e9)) END::DOUBLE AS overall_score, CASE WHEN bad THEN 'not_applicable' WHEN warn AND safety_level = 'green' THEN 'yellow' ELSE safety_level END AS safety_level, CASE WHEN bad THEN 'insufficient' ELSE capture_quality END AS capture_quality, review FROM z""")
def r9(spark, d):
    res = arb_results(spark, d)
    k = F.col("l_suppkey") % 4
    action = F.when(k == 0, "cap_score").when(k == 1, "confirm_algorithm").when(k == 2, "nonsense").otherwise("mark_insufficient")
    dec = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.struct("l_linenumber", *TIE).alias("no"), action.alias("action"),
        F.when(F.col("l_partkey") % 9 == 0, "INSUFFICIENT_EVIDENCE").otherwise("X").alias("reason_code"), (F.lit(40.0) + F.col("l_quantity")).alias("cap"))
    return review.apply_arbitration(res, review.arbitration_reasons(res, ["job"]), dec, ["job"]).select("job", "overall_score", "safety_level", "capture_quality", "review")


ACTS, WHYS = ["cap_score", "confirm_algorithm", "nonsense", "mark_insufficient", "mark_uncertain", "request_rerun"], ["INSUFFICIENT_EVIDENCE", "ACTION_CLASS_UNCERTAIN", "ACTIVE_WINDOW_UNCERTAIN", "X", "Y"]


@query("r9_arbitration_effects", f"""WITH {RS}, c AS (SELECT job, bool_or(code = 'INSUFFICIENT_EVIDENCE') AS i, bool_or(code = 'ACTION_CLASS_UNCERTAIN') AS a, bool_or(code = 'ACTIVE_WINDOW_UNCERTAIN') AS w, bool_or(code = 'COUNT_UNSTABLE') AS u, bool_or(code NOT IN ('STAGE_EVIDENCE_VISUAL_REVIEW', 'ACTION_SUBTYPE_VISUAL_REVIEW')) AS rv FROM rr GROUP BY 1),
 dec AS (SELECT l_orderkey AS job, {q_list(ACTS)}[l_suppkey % 6 + 1] AS action, {q_list(WHYS)}[l_partkey % 5 + 1] AS rc, CASE WHEN l_partkey % 3 > 0 THEN greatest(0, least(100, l_quantity * 2.5 - 10))::DOUBLE END AS cap, l_linenumber = 3 AS ask, 'line ' || l_linenumber AS note,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {TIE_SQL}) AS rn FROM lineitem WHERE l_suppkey % 6 <> 2),
 dn AS (SELECT dec.*, action IN ('mark_uncertain', 'request_rerun') AS soft, action = 'mark_insufficient' AND (coalesce(i, false) OR rc = 'INSUFFICIENT_EVIDENCE') AS mk FROM (SELECT * REPLACE (CASE WHEN action NOT IN ('confirm_algorithm', 'mark_insufficient') THEN cap END AS cap), row_number() OVER (PARTITION BY job ORDER BY rn) AS k FROM dec) dec LEFT JOIN c USING (job) WHERE k <= 8),
 de AS (SELECT job, bool_or(mk) AS mk, bool_or(ask) AS ask, first(note ORDER BY k) FILTER (WHERE mk) AS note,
  min(least(cap, CASE WHEN action = 'mark_insufficient' AND NOT mk THEN 80 WHEN soft AND rc = 'ACTION_CLASS_UNCERTAIN' THEN 75 WHEN soft AND rc = 'ACTIVE_WINDOW_UNCERTAIN' THEN 80 END)) AS cap,
  flatten(list(list_filter([CASE WHEN mk THEN 'mark_insufficient' WHEN action = 'mark_insufficient' THEN 'reject_ai_mark_insufficient' WHEN soft AND rc = 'ACTION_CLASS_UNCERTAIN' THEN 'mark_action_class_uncertain' WHEN soft AND rc = 'ACTIVE_WINDOW_UNCERTAIN' THEN 'mark_active_window_uncertain' END,
   'cap_score_' || CASE WHEN cap = floor(cap) THEN cap::BIGINT::VARCHAR ELSE cap::VARCHAR END], lambda x: x IS NOT NULL) ORDER BY k)) AS names FROM dn GROUP BY 1),
 z AS (SELECT rs.*, CASE WHEN job % 11 = 0 THEN ['ACTION_CLASS_UNCERTAIN'] WHEN job % 13 = 0 THEN ['COUNT_UNSTABLE'] ELSE [] END AS have, coalesce(i, false) AS i, coalesce(a, false) AS a, coalesce(w, false) AS w, coalesce(u, false) AND NOT (job % 13 = 0 AND job % 11 <> 0) AS u, coalesce(rv, false) OR coalesce(ask, false) AS review, coalesce(i, false) OR coalesce(mk, false) AS bad, de.cap, note, names FROM rs LEFT JOIN c USING (job) LEFT JOIN de USING (job)),
 y AS (SELECT *, list_filter([CASE WHEN i THEN 'mark_insufficient' END, CASE WHEN a THEN 'mark_action_class_uncertain' END, CASE WHEN w THEN 'mark_active_window_uncertain' END, CASE WHEN u THEN 'mark_count_unstable' END], lambda x: x IS NOT NULL) || coalesce(names, []) AS al FROM z),
 x AS (SELECT *, list_filter(al, lambda v, n: list_position(al, v) = n) AS ap FROM y),
 w AS (SELECT *, list_filter(list_transform(ap, lambda v: CASE v WHEN 'mark_insufficient' THEN 'INSUFFICIENT_EVIDENCE' WHEN 'mark_action_class_uncertain' THEN 'ACTION_CLASS_UNCERTAIN' WHEN 'mark_active_window_uncertain' THEN 'ACTIVE_WINDOW_UNCERTAIN' WHEN 'mark_count_unstable' THEN 'COUNT_UNSTABLE' END), lambda v: v IS NOT NULL AND NOT list_contains(have, v)) AS ad FROM x)
 SELECT job, CASE WHEN bad THEN 0 ELSE least(overall_score, CASE WHEN a THEN 75 END, CASE WHEN w THEN 80 END, CASE WHEN u THEN 85 END, cap) END::DOUBLE AS overall_score, review, CASE WHEN bad THEN 0 ELSE lost END::BIGINT AS rep_count, bad AS cleared, array_to_string(ap, ',') AS applied, array_to_string(ad, ',') AS added,
  CASE WHEN list_contains(ad, 'INSUFFICIENT_EVIDENCE') AND NOT i THEN note END AS observation, round(CASE WHEN list_contains(ad, 'ACTION_CLASS_UNCERTAIN') THEN sc ELSE 0 END + CASE WHEN list_contains(ad, 'ACTIVE_WINDOW_UNCERTAIN') THEN wc ELSE 0 END, 6) AS confidence FROM w""")
def r9_effects(spark, d):
    res = arb_results(spark, d)
    pick = lambda xs, c, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(c) % n + 1).cast("int"))
    dec = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job"), F.struct("l_linenumber", *TIE).alias("no"), pick(ACTS, "l_suppkey", 6).alias("action"), pick(WHYS, "l_partkey", 5).alias("reason_code"),
        F.when(F.col("l_partkey") % 3 > 0, F.col("l_quantity") * 2.5 - 10).alias("cap"), F.lit(1.5).alias("confidence"), (F.col("l_linenumber") == 3).alias("require_review"), F.concat(F.lit(" line "), F.col("l_linenumber").cast("string")).alias("note"))
    own = F.when(F.col("job") % 11 == 0, F.array(F.lit("ACTION_CLASS_UNCERTAIN"))).when(F.col("job") % 13 == 0, F.array(F.lit("COUNT_UNSTABLE"))).otherwise(F.array().cast("array<string>"))
    held = res.withColumn("codes", own).withColumn("has_count_issue", F.array_contains("codes", "COUNT_UNSTABLE")).withColumn("rep_count", F.col("lost"))
    out = review.apply_arbitration(held, review.arbitration_reasons(res, ["job"]), dec, ["job"])
    sure = F.aggregate("added", F.lit(0.0), lambda s, x: s + F.coalesce(x["confidence"], F.lit(0.0)))
    said = F.array_max(F.transform("added", lambda x: x["observation"]))
    return out.select("job", "overall_score", "review", "rep_count", "cleared", F.array_join("applied", ",").alias("applied"), F.array_join("added.code", ",").alias("added"), said.alias("observation"), r6(sure, "confidence"))


@query("r11_standard_impact", f"""WITH {ISS}, {DIM}, f AS (SELECT job, code, row_number() OVER (PARTITION BY job ORDER BY rep, {TIE_SQL}) AS rn FROM iss), l AS (SELECT job, list(code ORDER BY rn) AS t FROM f WHERE rn <= 10 GROUP BY 1), r AS (SELECT o_orderkey AS job, {q_list(dims.ACTION_NAMES)}[o_custkey % 37 + 1] AS action_type FROM orders)
 SELECT job, action_type, family, mode, coalesce(array_to_string(t, ','), '') AS triggered FROM r JOIN dim USING (action_type) LEFT JOIN l USING (job)""")
def r11(spark, d):
    a = F.element_at(F.array(*[F.lit(x) for x in dims.ACTION_NAMES]), (F.col("o_custkey") % 37 + 1).cast("int"))
    res = read(spark, d, "orders").select(F.col("o_orderkey").alias("job"), a.alias("action_type"))
    out = review.standard_impact(res, issues(spark, d), dims.action_dim(spark), ["job"], [F.col("rep"), *cols(TIE)])
    return out.select("job", "action_type", "family", "mode", F.array_join("triggered", ",").alias("triggered"))


@query("r12_review_sections", f"""WITH {ISS}, c AS (SELECT job, {CAT.format(t='code')} AS section, count(*) AS relevant FROM iss GROUP BY 1, 2), g AS (SELECT o_orderkey AS job, o_custkey % 19 = 0 AS bad, unnest({q_list(review.SECTIONS)}) AS section FROM orders)
 SELECT job, section, coalesce(relevant, 0) AS relevant, CASE WHEN bad THEN 'limited_evidence' WHEN relevant > 0 THEN 'needs_attention' ELSE 'mostly_meets' END AS status FROM g LEFT JOIN c USING (job, section)""")
def r12(spark, d):
    i = issues(spark, d).withColumn("category", text.issue_category(F.col("code"), F.lit("")))
    res = read(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_custkey") % 19 == 0, "insufficient").otherwise("good").alias("capture_quality"))
    return review.review_sections(i, res, ["job"])


@query("r13_session_facts", f"""WITH {JB}, {VID}, {ISS}, f AS (SELECT job, code, row_number() OVER (PARTITION BY job ORDER BY rep, {TIE_SQL}) AS rn FROM iss), l AS (SELECT job, list(code ORDER BY rn) AS p FROM f WHERE rn <= 8 GROUP BY 1), q AS (SELECT job, count(*) FILTER (WHERE severity = 'red') AS rf, count(*) FILTER (WHERE severity = 'yellow') AS yf FROM iss GROUP BY 1),
 v AS (SELECT job, sum(sets) AS sets, sum(sets * greatest(0, reps) * load_kg) AS t FROM vid GROUP BY 1) SELECT job_id, coalesce(array_to_string(p, ','), '') AS priorities, coalesce(rf, 0) AS red_flags, coalesce(yf, 0) AS yellow_flags, round(coalesce(sets, 0), 6) AS sets, round(coalesce(t, 0), 6) AS tonnage_kg
 FROM jb LEFT JOIN l ON l.job = job_id LEFT JOIN q ON q.job = job_id LEFT JOIN v ON v.job = job_id""")
def r13(spark, d):
    acts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_partkey") % 37).alias("action_type"))
    j = job_view(spark, d)
    vol = scoring.training_volume(videos(spark, d), ["job"]).withColumnRenamed("job", "job_id")
    out = review.session_facts(j, issues(spark, d).withColumnRenamed("job", "job_id"), vol, J.previous_session(j, acts), [F.col("rep"), *cols(TIE)])
    return out.select("job_id", F.array_join("priorities", ",").alias("priorities"), "red_flags", "yellow_flags", r6("sets"), r6("tonnage_kg"))


# ---- segmentation dispatch and key samples -------------------------------------------

@query("s9_segment_dispatch")
def s9(spark, d):
    """Every action of the catalogue, by the first and by the second engine's rules."""
    from cadenza.operators.dispatch import segment_engines

    names = list(dims.ACTIONS)
    no = (F.col("user_id") % len(names) + 1).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), no)
    s = sig(spark, d).withColumn("action_type", of(names)).withColumn("family", of([dims.ACTIONS[x][0] for x in names]))
    return segment_engines(s, K, "v", FPS).select("user_id", "secondary", "algorithm", "rep_index", "start_idx", "key_idx", "end_idx")


@query("t3_key_samples", SIG + IV + """, e AS (SELECT user_id, n, min(struct_pack(v := -v, i := pose_idx)).i AS b FROM sig GROUP BY 1, 2),
 q AS (SELECT user_id, rep_index, start_ms // 100 AS a, key_ms // 100 AS b, end_ms // 100 AS c FROM rp WHERE user_id % 3 = 0), m AS (SELECT user_id, max(rep_index) // 2 + 1 AS rep_index FROM q GROUP BY 1),
 w AS (SELECT user_id, [a, (a + b) // 2, b, c] AS r FROM q JOIN m USING (user_id, rep_index))
 SELECT user_id, array_to_string(list_sort(list_distinct(coalesce(r, CASE WHEN user_id % 2 = 0 THEN [0, b // 2, b, n - 1] ELSE [0, n // 3, 2 * n // 3, n - 1] END))), ',') AS samples FROM e LEFT JOIN w USING (user_id)""")
def t3(spark, d):
    from cadenza.operators.dispatch import key_samples

    idx = lambda c: F.floor(F.col(c) / 100).alias(c.replace("_ms", "_idx"))
    reps = rep_view(spark, d).where("user_id % 3 = 0").select("user_id", "rep_index", idx("start_ms"), idx("key_ms"), idx("end_ms"))
    out = key_samples(sig(spark, d), reps, K, "v", F.col("user_id") % 2 == 0)
    return out.select("user_id", F.array_join("samples", ",").alias("samples"))


# ---- streaming ----------------------------------------------------------------------


@query("st1_track_target_stream")
def st1(spark, d):
    from cadenza.plans.q_motion import people
    from cadenza.streaming.live import track_target_stream

    base = stream_folder(spark)
    people(spark, d).write.mode("overwrite").parquet(f"{base}/in")
    store = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    source = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    out = track_target_stream(source)
    with settings(spark, store):
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    r = spark.read.parquet(f"{base}/out").where("not late")
    return r.select("video_id", "frame_index", "selected", "candidates", "rejected", "switched", r6("lock_confidence"), r6("score"))


@query("st2_ingest_results_stream", f"WITH {JB} SELECT job_id, status, 1::BIGINT AS version FROM jb WHERE job_id % 2 = 1 UNION ALL SELECT job_id, 'completed', 2 FROM jb WHERE job_id % 2 = 0")
def st2(spark, d):
    from cadenza.streaming.live import current_status, ingest_results_stream

    base = stream_folder(spark)
    j = job_view(spark, d).select("job_id", "status", F.lit(1).cast("long").alias("version"))
    j.unionByName(j.where("job_id % 2 = 0").select("job_id", F.lit("completed").alias("status"), F.lit(2).cast("long").alias("version"))).write.mode("overwrite").json(f"{base}/in")
    source = spark.readStream.schema("job_id bigint, status string, version bigint").option("maxFilesPerTrigger", 8).json(f"{base}/in")
    ingest_results_stream(source, f"{base}/table", f"{base}/cp").awaitTermination()
    return current_status(spark.read.parquet(f"{base}/table")).select("job_id", "status", "version")


def stream_folder(spark) -> str:
    """A fresh folder next to the checkpoints, reachable by all executors."""
    import uuid

    from cadenza.core.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
