"""Queries of the join and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.landmarks import LK, LS, RW
from cadenza.operators import evaluation, joins
from cadenza.plans.q_pose import lm
from cadenza.plans.q_series import K, r6
from cadenza.plans.registry import query
from cadenza.plans.views import FPS, frames, frames_sql, sig, sig_sql

SIG, FR, V = "WITH " + sig_sql(), "WITH " + frames_sql(), ["video_id"]
IV = """, ev AS (SELECT user_id, pose_idx, time_ms, s.event_id, event_type FROM sig s JOIN (SELECT event_id, event_type FROM events) USING (event_id)),
 iv AS (SELECT user_id, event_id, time_ms AS start_ms, time_ms + 100 * (1 + event_id % 9) AS end_ms FROM ev WHERE event_type = 'error'),
 rp AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ms) AS rep_index, start_ms, start_ms + 100 * (event_id % 5) AS key_ms, greatest(end_ms, start_ms + 100 * (event_id % 5)) AS end_ms FROM iv)"""


def intervals(spark, d):
    s = sig(spark, d)
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").select("event_id", F.lit(1).alias("one"))
    return s.join(e, "event_id").select("user_id", "event_id", "pose_idx", F.col("time_ms").alias("start_ms"), (F.col("time_ms") + 100 * (1 + F.col("event_id") % 9)).alias("end_ms"))


def rep_view(spark, d):
    from cadenza.operators.segment import number_in_order

    key = F.col("start_ms") + 100 * (F.col("event_id") % 5)
    r = intervals(spark, d).withColumn("key_ms", key).withColumn("end_ms", F.greatest("end_ms", "key_ms"))
    return number_in_order(r, K, "pose_idx").select("user_id", "rep_index", "start_ms", "key_ms", "end_ms", "event_id")


@query("j1_nearest_join", FR + f""", pr AS (SELECT video_id, vec_id AS prior_id, CASE WHEN vec_id % 2 = 0 THEN vec_id + vec_id % 4 END AS fi, CASE WHEN vec_id % 2 = 1 THEN time_ms + 130 END AS tm, x{RW} AS px, y{RW} AS py, greatest(.75, v{RW}) AS pc
  FROM fr), hit AS (SELECT p.prior_id, arg_min(f.vec_id, struct_pack(d := CASE WHEN fi IS NOT NULL THEN abs(f.frame_index - fi) ELSE abs(f.time_ms - tm) END, h := f.pose_idx)) AS target
  FROM pr p JOIN fr f ON p.video_id = f.video_id AND CASE WHEN fi IS NOT NULL THEN abs(f.frame_index - fi) <= 2 ELSE abs(f.time_ms - tm) <= 180 END GROUP BY 1),
 ap AS (SELECT target, list(struct_pack(x := px, y := py, c := pc) ORDER BY prior_id) AS ps FROM hit JOIN pr USING (prior_id) GROUP BY 1),
 z AS (SELECT video_id, pose_idx, CASE WHEN ps IS NULL THEN struct_pack(x := x{LK}, y := y{LK}, c := v{LK}) ELSE list_reduce(list_prepend(struct_pack(x := x{LK}, y := y{LK}, c := v{LK}), ps),
  lambda a, q: CASE WHEN a.c < .82 THEN q ELSE struct_pack(x := .35 * a.x + .65 * q.x, y := .35 * a.y + .65 * q.y, c := greatest(a.c, q.c)) END) END AS p FROM fr LEFT JOIN ap ON target = vec_id)
 SELECT video_id, pose_idx, round(p.x, 6) AS x, round(p.y, 6) AS y, round(p.c, 6) AS vis FROM z""")
def j1(spark, d):
    f = frames(spark, d)
    p, even = lm()[RW], F.col("vec_id") % 2 == 0
    pri = f.select(
        "video_id", F.col("vec_id").alias("prior_id"), F.when(even, F.col("vec_id") + F.col("vec_id") % 4).alias("frame_index"),
        F.when(~even, F.col("time_ms") + 130).alias("time_ms"), F.lit(LK).alias("slot"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"),
        F.greatest(F.lit(0.75), p["vis"]).alias("conf"))
    out = joins.apply_priors(f, pri)
    q = lm()[LK]
    return out.select("video_id", "pose_idx", r6(q["x"], "x"), r6(q["y"], "y"), r6(q["vis"], "vis"))


@query("j2_asof_nearest", SIG + IV + """, c AS (SELECT s.user_id, s.pose_idx, arg_min(i.event_id, struct_pack(d := abs(i.start_ms + 50 - s.time_ms), t := i.start_ms)) AS judgment_id, min(abs(i.start_ms + 50 - s.time_ms)) AS gap_ms
 FROM sig s JOIN iv i USING (user_id) GROUP BY 1, 2) SELECT user_id, pose_idx, judgment_id, gap_ms FROM sig LEFT JOIN c USING (user_id, pose_idx)""")
def j2(spark, d):
    right = intervals(spark, d).select("user_id", (F.col("start_ms") + 50).alias("time_ms"), F.col("event_id").alias("judgment_id"))
    out = joins.nearest_in_time(sig(spark, d).select("user_id", "pose_idx", "time_ms"), right, K, ["judgment_id"])
    return out.select("user_id", "pose_idx", "judgment_id", F.abs(F.col("time_ms") - F.col("match_ms")).alias("gap_ms"))


TL = """, tl AS (SELECT s.user_id, s.pose_idx, s.time_ms, min(struct_pack(a := start_ms, b := rep_index, k := key_ms)) AS r FROM sig s LEFT JOIN rp ON rp.user_id = s.user_id AND s.time_ms BETWEEN start_ms AND end_ms GROUP BY 1, 2, 3),
 ph AS (SELECT user_id, pose_idx, time_ms, r.b AS rep_index, CASE WHEN r.b IS NULL THEN 'between_reps' WHEN abs(time_ms - r.k) <= 70 THEN 'key' WHEN time_ms < r.k THEN 'to_key' ELSE 'return' END AS phase FROM (SELECT user_id, pose_idx, time_ms, CASE WHEN r.a IS NOT NULL THEN r END AS r FROM tl))"""


def timeline(spark, d):
    return joins.phase_timeline(sig(spark, d), rep_view(spark, d), K, max(70, round(500.0 / FPS)))


@query("j3_phase_timeline", SIG + IV + TL + " SELECT user_id, pose_idx, rep_index, phase FROM ph")
def j3(spark, d):
    return timeline(spark, d).select("user_id", "pose_idx", "rep_index", "phase")


@query("j4_frame_feedback", SIG + IV + TL + """, iss AS (SELECT user_id, rep_index AS issue_no, 'C' || (event_id % 4) AS code, event_id % 3 = 0 AS loose, r.start_ms, r.end_ms, rep_index FROM rp r JOIN iv i ON i.user_id = r.user_id AND i.start_ms = r.start_ms WHERE event_id % 2 = 0),
 f AS (SELECT p.user_id, p.pose_idx, min(struct_pack(no := issue_no, c := code)) AS i FROM ph p JOIN iss x ON x.user_id = p.user_id AND (CASE WHEN loose THEN x.rep_index = p.rep_index ELSE p.time_ms BETWEEN x.start_ms AND x.end_ms END) GROUP BY 1, 2)
 SELECT user_id, pose_idx, phase, i.c AS issue_code FROM ph LEFT JOIN f USING (user_id, pose_idx)""".replace("r JOIN iv i ON i.user_id = r.user_id AND i.start_ms = r.start_ms", "r JOIN (SELECT user_id AS u, event_id, start_ms AS sm FROM iv) i ON i.u = r.user_id AND i.sm = r.start_ms"))
def j4(spark, d):
    loose = F.col("event_id") % 3 == 0
    none = F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")
    iss = rep_view(spark, d).where(F.col("event_id") % 2 == 0).select(
        "user_id", F.col("rep_index").alias("issue_no"), F.concat(F.lit("C"), (F.col("event_id") % 4).cast("string")).alias("code"),
        F.when(loose, none).otherwise(F.array(F.struct("start_ms", "end_ms"))).alias("ranges"), F.array("rep_index").alias("reps"))
    return joins.frame_issue(timeline(spark, d), iss, K).select("user_id", "pose_idx", "phase", "issue_code")


ISS = """, iss AS (SELECT user_id, rep_index AS issue_no, 'C' || (event_id % 4) AS code, event_id % 3 = 0 AS loose, r.start_ms, r.end_ms, rep_index FROM rp r JOIN (SELECT user_id AS u, event_id, start_ms AS sm FROM iv) i ON i.u = r.user_id AND i.sm = r.start_ms WHERE event_id % 2 = 0)"""
WIDE = lambda ms: TL.replace("<= 70", f"<= {ms}")


def issue_view(spark, d):
    loose = F.col("event_id") % 3 == 0
    none = F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")
    return rep_view(spark, d).where(F.col("event_id") % 2 == 0).select(
        "user_id", F.col("rep_index").alias("issue_no"), F.concat(F.lit("C"), (F.col("event_id") % 4).cast("string")).alias("code"),
        F.when(loose, none).otherwise(F.array(F.struct("start_ms", "end_ms"))).alias("ranges"), F.array("rep_index").alias("reps"))


@query("j4_feedback_window_220", SIG + IV + WIDE(220) + ISS + """, f AS (SELECT p.user_id, p.pose_idx, min(struct_pack(no := issue_no, c := code)) AS i FROM ph p JOIN iss x ON x.user_id = p.user_id AND (CASE WHEN loose THEN x.rep_index = p.rep_index ELSE p.time_ms BETWEEN x.start_ms AND x.end_ms END) GROUP BY 1, 2)
 SELECT user_id, pose_idx, rep_index, phase, i.c AS issue_code FROM ph LEFT JOIN f USING (user_id, pose_idx)""")
def j4_220(spark, d):
    line = joins.phase_timeline(sig(spark, d), rep_view(spark, d), K, 220)
    return joins.frame_issue(line, issue_view(spark, d), K).select("user_id", "pose_idx", "rep_index", "phase", "issue_code")


@query("j4_frame_notes_260", SIG + IV + WIDE(260) + ISS + """, f AS (SELECT p.user_id, p.pose_idx, min(struct_pack(no := issue_no, c := code)).c AS c FROM ph p JOIN iss x ON x.user_id = p.user_id AND NOT loose AND p.time_ms BETWEEN x.start_ms AND x.end_ms GROUP BY 1, 2)
 SELECT user_id, pose_idx, CASE WHEN c IS NOT NULL THEN 'issue' WHEN rep_index IS NULL THEN 'none' WHEN phase = 'key' THEN 'key' ELSE 'path' END AS note, c AS code, CASE WHEN c IS NULL THEN rep_index END AS rep_index FROM ph LEFT JOIN f USING (user_id, pose_idx)""")
def j4_260(spark, d):
    return joins.frame_notes(sig(spark, d), rep_view(spark, d), issue_view(spark, d), K).select("user_id", "pose_idx", "note", "code", "rep_index")


@query("j7_attach_motion", FR + """, m AS (SELECT *, coalesce(CASE WHEN vec_id % 7 <> 0 THEN vec_id % 4 <> 0 END, false) AS available FROM fr)
 SELECT video_id, pose_idx, available, round(avg(available::INT) OVER (PARTITION BY video_id), 6) AS coverage, avg(available::INT) OVER (PARTITION BY video_id) >= .6 AND n >= 3 AS applied FROM m""")
def j7(spark, d):
    f = frames(spark, d)
    motion = f.where(F.col("vec_id") % 7 != 0).select("video_id", "frame_index", (F.col("vec_id") % 4 != 0).alias("available"))
    out = joins.attach_motion(f.drop("landmarks"), motion, V)
    return out.select("video_id", "pose_idx", "available", r6("coverage"), "applied")


@query("j11_display_window", SIG + IV + """, ac AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN 500 END AS a, CASE WHEN user_id % 5 <> 0 THEN 6000 END AS b FROM sig GROUP BY 1),
 sp AS (SELECT user_id, min(start_ms) AS rs, max(end_ms) AS re FROM rp WHERE user_id % 2 = 0 GROUP BY 1)
 SELECT user_id, pose_idx FROM sig JOIN ac USING (user_id) LEFT JOIN sp USING (user_id) WHERE time_ms >= coalesce(CASE WHEN rs IS NULL THEN a ELSE greatest(a, rs - 650) END, -1) AND time_ms <= coalesce(CASE WHEN re IS NULL THEN b ELSE least(b, re + 650) END, 1e12)""")
def j11(spark, d):
    s = sig(spark, d)
    has = F.col("user_id") % 5 != 0
    active = s.select("user_id", "n").distinct().select("user_id", "n", F.when(has, 500).alias("start_ms"), F.when(has, 6000).alias("end_ms"))
    return joins.display_window(s, rep_view(spark, d).where("user_id % 2 = 0"), active, K).select("user_id", "pose_idx")


@query("j14_rep_keyframes", SIG + IV + """, q AS (SELECT user_id, rep_index, start_ms // 100 AS a, key_ms // 100 AS b, end_ms // 100 AS c FROM rp)
 SELECT q.user_id, rep_index, round(s1.v, 6) AS start_v, round(s2.v, 6) AS key_v, round(s3.v, 6) AS end_v FROM q LEFT JOIN sig s1 ON s1.user_id = q.user_id AND s1.pose_idx = a
 LEFT JOIN sig s2 ON s2.user_id = q.user_id AND s2.pose_idx = b LEFT JOIN sig s3 ON s3.user_id = q.user_id AND s3.pose_idx = c""")
def j14(spark, d):
    idx = lambda c: F.floor(F.col(c) / 100).alias(c.replace("_ms", "_idx"))
    reps = rep_view(spark, d).select("user_id", "rep_index", idx("start_ms"), idx("key_ms"), idx("end_ms"))
    out = joins.rep_keyframes(reps, sig(spark, d), K, ["v"])
    return out.select("user_id", "rep_index", *[r6(F.col(f"{m}_frame.v"), f"{m}_v") for m in ("start", "key", "end")])


@query("j13_join_or_position", """WITH a AS (SELECT l_orderkey AS job, l_partkey AS vid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_linenumber) AS pos FROM lineitem),
 b AS (SELECT job, min(CASE WHEN vid % 3 = 0 THEN -vid ELSE vid END) AS vid, pos, min(vid * 10) AS score FROM a GROUP BY job, pos), bi AS (SELECT job, vid, min(score) AS score FROM b GROUP BY 1, 2)
 SELECT a.job, a.vid, a.pos, coalesce(bi.score, b.score) AS score FROM a LEFT JOIN bi ON bi.job = a.job AND bi.vid = a.vid LEFT JOIN b ON b.job = a.job AND b.pos = a.pos""")
def j13(spark, d):
    from cadenza.core.layout import with_ordinal

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    a = with_ordinal(li, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_linenumber"], F.floor(F.col("l_partkey") / 64), "p", "c")
    a = a.select(F.col("l_orderkey").alias("job"), F.col("l_partkey").alias("vid"), (F.col("p") + 1).alias("pos"))
    b = a.select("job", F.when(F.col("vid") % 3 == 0, -F.col("vid")).otherwise(F.col("vid")).alias("vid"), "pos", (F.col("vid") * 10).alias("score"))
    return joins.join_or_position(a, b, ["job"], "vid", "pos", ["score"]).select("job", "vid", "pos", "score")


# ---- evaluation --------------------------------------------------------------------

CASES = IV + """, ex AS (SELECT user_id AS case_id, start_ms, end_ms FROM iv WHERE user_id % 2 = 0), pd AS (SELECT user_id - 1 AS case_id, start_ms + 100 AS start_ms, end_ms + 150 AS end_ms FROM iv WHERE user_id % 2 = 1),
 ig AS (SELECT user_id AS case_id, start_ms, end_ms FROM iv WHERE user_id % 2 = 0 AND event_id % 11 = 0), fm AS (SELECT user_id AS case_id, time_ms, quality < .1 AS unknown FROM sig WHERE user_id % 2 = 0),
 fl AS (SELECT *, EXISTS (SELECT 1 FROM ex WHERE ex.case_id = f.case_id AND start_ms <= time_ms AND time_ms < end_ms) AS actual, EXISTS (SELECT 1 FROM pd WHERE pd.case_id = f.case_id AND start_ms <= time_ms AND time_ms < end_ms) AS predicted,
  EXISTS (SELECT 1 FROM ig WHERE ig.case_id = f.case_id AND start_ms <= time_ms AND time_ms < end_ms) AS ignored FROM fm f)"""
RATES = """round_even(round(tp / nullif(tp + fp, 0), 10), 4) AS precision, round_even(round(tp / nullif(tp + fn, 0), 10), 4) AS recall, round_even(round(tn / nullif(tn + fp, 0), 10), 4) AS specificity,
 round_even(round(fp / nullif(fp + tn, 0), 10), 4) AS false_positive_rate, round_even(round((tp + tn) / nullif(tp + fp + tn + fn, 0), 10), 4) AS accuracy"""


def cases(spark, d):
    iv = intervals(spark, d)
    c = ["case_id", "start_ms", "end_ms"]
    ex = iv.where("user_id % 2 = 0").select(F.col("user_id").alias("case_id"), "start_ms", "end_ms")
    ig = iv.where("user_id % 2 = 0 AND event_id % 11 = 0").select(F.col("user_id").alias("case_id"), "start_ms", "end_ms")
    pd = iv.where("user_id % 2 = 1").select((F.col("user_id") - 1).alias("case_id"), (F.col("start_ms") + 100).alias("start_ms"), (F.col("end_ms") + 150).alias("end_ms"))
    fm = sig(spark, d).where("user_id % 2 = 0").select(F.col("user_id").alias("case_id"), "time_ms", (F.col("quality") < 0.1).alias("unknown"))
    for name, table in (("actual", ex), ("predicted", pd), ("ignored", ig)):
        fm = evaluation.flag_ranges(fm, table.select(*c), ["case_id"], name)
    return fm, ex, pd


@query("p15_time_in_ranges", SIG + CASES + " SELECT case_id, time_ms, actual, predicted, ignored FROM fl")
def p15(spark, d):
    return cases(spark, d)[0].select("case_id", "time_ms", "actual", "predicted", "ignored")


CONF = """, cf AS (SELECT case_id, count(*) FILTER (WHERE u AND actual AND predicted) AS tp, count(*) FILTER (WHERE u AND NOT actual AND predicted) AS fp, count(*) FILTER (WHERE u AND NOT actual AND NOT predicted) AS tn,
 count(*) FILTER (WHERE u AND actual AND NOT predicted) AS fn, count(*) FILTER (WHERE u) AS evaluated, count(*) FILTER (WHERE NOT u) AS ignored FROM (SELECT *, NOT unknown AND NOT ignored AS u FROM fl) GROUP BY 1)"""


def confusion(spark, d):
    fm = cases(spark, d)[0]
    return evaluation.confusion(fm, ["case_id"], F.col("actual"), F.col("predicted"), ~F.col("unknown") & ~F.col("ignored"))


@query("a10_confusion", SIG + CASES + CONF + f" SELECT *, {RATES} FROM cf")
def a10(spark, d):
    return confusion(spark, d)


@query("a10_confusion_labels", f"""WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn,
 count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) AS evaluated, 0::BIGINT AS ignored FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT *, {RATES} FROM c""")
def a10b(spark, d):
    j = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    return evaluation.confusion(j, ["lang"], F.col("quality") == 1, F.col("toxic") == 1, F.lit(True))


def q_kappa(src, key, a, b):
    return f"""k0 AS (SELECT {key}, avg(({a} = {b})::INT) AS o, avg({a}::INT) AS l, avg({b}::INT) AS r FROM {src} GROUP BY 1),
 kp AS (SELECT {key}, CASE WHEN abs(l * r + (1 - l) * (1 - r) - 1) <= 1e-9 THEN CASE WHEN abs(o - 1) <= 1e-9 THEN 1.0::DOUBLE END ELSE round_even(round((o - (l * r + (1 - l) * (1 - r))) / (1 - (l * r + (1 - l) * (1 - r))), 10), 4) END AS kappa FROM k0)"""


@query("a11_cohens_kappa", "WITH j AS (SELECT lang, quality = 1 AS a, toxic = 1 AS b FROM labels JOIN documents USING (doc_id)), " + q_kappa("j", "lang", "a", "b") + " SELECT * FROM kp")
def a11(spark, d):
    j = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    return evaluation.cohens_kappa(j, ["lang"], F.col("quality") == 1, F.col("toxic") == 1)


# the walk over expected ranges, one at a time: every range also meets the stand-in -1, which is chosen when nothing is free
WALK = """, en AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY start_ms, end_ms) AS e FROM ex), pn AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY start_ms, end_ms) AS p FROM pd),
 eg AS (SELECT case_id, e, p, (least(en.end_ms, pn.end_ms) - greatest(en.start_ms, pn.start_ms)) / (greatest(en.end_ms, pn.end_ms) - least(en.start_ms, pn.start_ms)) AS iou, abs(pn.start_ms - en.start_ms) AS onset, abs(pn.end_ms - en.end_ms) AS off
  FROM en JOIN pn USING (case_id) WHERE least(en.end_ms, pn.end_ms) > greatest(en.start_ms, pn.start_ms) UNION ALL SELECT case_id, e, -1, 0, 0, 0 FROM en),
 wk AS (SELECT case_id, 0::BIGINT AS e, []::BIGINT[] AS used FROM en GROUP BY 1 UNION ALL
  SELECT case_id, e, list_append(used, arg_max(p, [iou, p])) FROM (SELECT eg.case_id, eg.e, wk.used, eg.p, eg.iou FROM wk JOIN eg ON eg.case_id = wk.case_id AND eg.e = wk.e + 1 WHERE eg.p = -1 OR NOT list_contains(wk.used, eg.p)) GROUP BY case_id, e, used),
 mt AS (SELECT case_id, eg.iou, onset, off FROM wk JOIN eg USING (case_id, e) WHERE eg.p = used[len(used)] AND eg.p > 0)"""


@query("j6_boundary_match", SIG.replace("WITH ", "WITH RECURSIVE ", 1) + CASES + WALK + """, s AS (SELECT case_id, count(*) AS matched, round_even(round(avg(round_even(round(iou * 1e4, 6), 0)), 6), 0) / 1e4 AS mean_iou, round_even(round(avg(onset) * 10, 6), 0) / 10 AS mean_onset_error_ms, round_even(round(avg(off) * 10, 6), 0) / 10 AS mean_offset_error_ms FROM mt GROUP BY 1)
 SELECT case_id, coalesce(x, 0) AS expected_segments, coalesce(y, 0) AS predicted_segments, coalesce(matched, 0) AS matched_segments, coalesce(x, 0) - coalesce(matched, 0) AS missed_segments, coalesce(y, 0) - coalesce(matched, 0) AS extra_segments, mean_iou, mean_onset_error_ms, mean_offset_error_ms
 FROM (SELECT case_id, count(*) AS x FROM ex GROUP BY 1) FULL JOIN (SELECT case_id, count(*) AS y FROM pd GROUP BY 1) USING (case_id) LEFT JOIN s USING (case_id)""")
def j6(spark, d):
    _, ex, pd = cases(spark, d)
    return evaluation.boundary_metrics(ex, pd, ["case_id"])


@query("a12_aggregate_reports", SIG + CASES + CONF + ", " + q_kappa("(SELECT * FROM fl WHERE NOT unknown AND NOT ignored)", "case_id", "actual", "predicted")
       + f""", cs AS (SELECT *, 'action' || (case_id % 6) AS action_type FROM cf LEFT JOIN kp USING (case_id)), gs AS (SELECT CASE WHEN grouping(action_type) = 1 THEN 'overall' ELSE action_type END AS action_type, count(*) AS videos,
 sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn, round_even(round(avg(kappa), 10), 4) AS mean_kappa FROM cs GROUP BY GROUPING SETS ((action_type), ())) SELECT *, {RATES} FROM gs""")
def a12(spark, d):
    fm, _, _ = cases(spark, d)
    usable = ~F.col("unknown") & ~F.col("ignored")
    conf = evaluation.confusion(fm, ["case_id"], F.col("actual"), F.col("predicted"), usable)
    kappa = evaluation.cohens_kappa(fm.where(usable), ["case_id"], F.col("actual"), F.col("predicted"))
    c = conf.select("case_id", "tp", "fp", "tn", "fn").join(kappa, "case_id", "left")
    c = c.withColumn("action_type", F.concat(F.lit("action"), (F.col("case_id") % 6).cast("string")))
    c = c.withColumn("mean_onset_error_ms", F.lit(None).cast("double")).withColumn("mean_offset_error_ms", F.lit(None).cast("double"))
    return evaluation.aggregate_reports(c).drop("mean_onset_error_ms", "mean_offset_error_ms")
