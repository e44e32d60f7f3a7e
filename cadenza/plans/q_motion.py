"""Queries of tracking, activity and stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.core.session import materialise
from cadenza.functions import dims, geometry as g
from cadenza.functions.dims import ACTION_NAMES, CAMERAS
from cadenza.functions.landmarks import ARM, LEG, LH, LS, RH, RS, TRUNK
from cadenza.operators import activity, stability, tracking
from cadenza.plans.q_measure import FR, V, rq
from cadenza.plans.q_pose import lm, q_box
from cadenza.plans.q_series import K, SIG, q_smooth, r6
from cadenza.plans.registry import query
from cadenza.plans.views import FPS, frames, frames_sql, q_min, sig, sig_sql

TRACK = f""", b AS (SELECT video_id, pose_idx, n, {', '.join(f'{e} AS {k}' for k, e in q_box((LS, RS, LH, RH)).items())} FROM fr),
 g AS (SELECT *, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS ar, greatest(0, x2 - x1) AS wd, greatest(0, y2 - y1) AS ht, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM b),
 m AS (SELECT video_id, greatest(.015, quantile_cont(ar, .5)) AS mar, greatest(.03, quantile_cont(wd, .5)) AS mwd, greatest(.05, quantile_cont(ht, .5)) AS mht, quantile_cont(x, .5) AS mx, quantile_cont(y, .5) AS my FROM g GROUP BY 1),
 p AS (SELECT *, CASE WHEN ar / mar <= 1.65 THEN 1 ELSE greatest(0, least(1, 1 - (ar / mar - 1.65) / 1.35)) END AS pa, CASE WHEN wd / mwd <= 1.75 THEN 1 ELSE greatest(0, least(1, 1 - (wd / mwd - 1.75) / 1.35)) END AS pw,
  CASE WHEN ht / mht <= 1.75 THEN 1 ELSE greatest(0, least(1, 1 - (ht / mht - 1.75) / 1.35)) END AS ph FROM g JOIN m USING (video_id)),
 tq AS (SELECT video_id, pose_idx, n, .65 * pa + .2 * least(pa, pw, ph) + .15 * greatest(0, least(1, 1 - sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) / .42)) AS tracking FROM p)"""


@query("w12_tracking_quality", FR + TRACK + " SELECT video_id, pose_idx, round(tracking, 6) AS tracking FROM tq")
def w12(spark, d):
    return activity.tracking_quality(frames(spark, d)).select("video_id", "pose_idx", r6("tracking"))


@query("w13_reliable_window", FR + TRACK + f""", t2 AS (SELECT video_id, pose_idx, n, tracking - .32 AS q FROM tq), sm AS ({q_smooth('t2', 'q', 5, 's', 'video_id')}),
 a AS (SELECT *, pose_idx - lag(pose_idx) OVER (PARTITION BY video_id ORDER BY pose_idx) AS gp FROM sm WHERE s >= .42), i AS (SELECT *, sum(CASE WHEN gp IS NULL OR gp > 11 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY pose_idx) AS isl FROM a),
 sg AS (SELECT video_id, n, min(pose_idx) AS s, max(pose_idx) AS e FROM i GROUP BY video_id, n, isl), bs AS (SELECT video_id, n, min(struct_pack(d := s - e, s := s, e := e)) AS b FROM sg GROUP BY 1, 2),
 w AS (SELECT u.video_id, u.n, greatest(0, b.s - 5) AS s, least(u.n - 1, b.e + 5) AS e FROM (SELECT DISTINCT video_id, n FROM fr) u LEFT JOIN bs USING (video_id)), z AS (SELECT *, coalesce(n >= 8 AND (s >= 4 OR n - 1 - e >= 4), false) AS trimmed FROM w)
 SELECT video_id, CASE WHEN trimmed THEN s ELSE 0 END AS start_idx, CASE WHEN trimmed THEN e ELSE n - 1 END AS end_idx, trimmed FROM z""")
def w13(spark, d):
    t = activity.tracking_quality(frames(spark, d)).withColumn("tracking", F.col("tracking") - 0.32)
    return activity.reliable_window(t, FPS).select("video_id", "start_idx", "end_idx", "trimmed")


def with_action(fr):
    a = F.element_at(F.array(*[F.lit(x) for x in ACTION_NAMES]), (F.col("video_id") * 5 % 37 + 1).cast("int"))
    f = F.element_at(F.array(*[F.lit(dims.ACTIONS[x][0]) for x in ACTION_NAMES]), (F.col("video_id") * 5 % 37 + 1).cast("int"))
    return fr.withColumn("action_type", a).withColumn("family", f)


@query("w14_active_window")
def w14(spark, d):
    f = with_action(materialise(frames(spark, d)))
    f = f.withColumn("quality", g.frame_quality(lm(), F.col("family"), F.col("action_type"))).withColumn("raw_signal", g.family_signal(lm(), F.col("family")))
    return activity.active_window(f, FPS).select("video_id", "action_type", "start_idx", "end_idx", "reason", "confidence")


@query("w16_event_confidence", FR + f""", c AS (SELECT video_id, pose_idx, avg({q_min(LEG[0])}) OVER w AS c0, avg({q_min(LEG[1])}) OVER w AS c1, vec_id FROM fr WINDOW w AS (PARTITION BY video_id ORDER BY pose_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
 SELECT video_id, pose_idx AS key_idx, {rq('c0', 3)} AS conf_0, {rq('c1', 3)} AS conf_1, CASE WHEN {rq('c0', 3)} >= {rq('c1', 3)} THEN 0 ELSE 1 END AS best_side FROM c""")
def w16(spark, d):
    f = frames(spark, d)
    reps = f.select("video_id", F.col("pose_idx").alias("key_idx"), F.col("vec_id").alias("rep_index"))
    out = activity.event_confidence(reps, f, V, [g.chain_min(lm(), LEG[0]), g.chain_min(lm(), LEG[1])])
    return out.select("video_id", "key_idx", "conf_0", "conf_1", "best_side")


@query("s8_hysteresis", SIG + """, st AS (SELECT user_id, pose_idx, n, CASE WHEN quality < .06 THEN 'unknown' WHEN v >= 90 THEN 'unstable' WHEN v >= 58 THEN 'watch' ELSE 'stable' END AS state, v / 90 AS score FROM sig),
 l AS (SELECT user_id, list(struct_pack(i := pose_idx, s := state, x := score) ORDER BY pose_idx) AS a FROM st GROUP BY 1),
 f AS (SELECT user_id, need, list_reduce(list_prepend(struct_pack(act := false, rec := 0, st := 'none', nxt := NULL::STRUCT(i BIGINT, s VARCHAR, x DOUBLE), o := []::STRUCT(i BIGINT, s VARCHAR)[]),
  list_transform(a, lambda q: struct_pack(act := false, rec := 0, st := 'none', nxt := q, o := []::STRUCT(i BIGINT, s VARCHAR)[]))), lambda z, q:
  CASE WHEN q.nxt.s = 'unknown' THEN struct_pack(act := false, rec := 0, st := 'x', nxt := q.nxt, o := list_append(z.o, struct_pack(i := q.nxt.i, s := 'unknown')))
   WHEN q.nxt.s = 'unstable' THEN struct_pack(act := true, rec := 0, st := 'x', nxt := q.nxt, o := list_append(z.o, struct_pack(i := q.nxt.i, s := 'unstable')))
   WHEN NOT z.act THEN struct_pack(act := false, rec := z.rec, st := 'x', nxt := q.nxt, o := list_append(z.o, struct_pack(i := q.nxt.i, s := q.nxt.s)))
   WHEN q.nxt.x <= .55 THEN struct_pack(act := z.rec + 1 < need, rec := CASE WHEN z.rec + 1 < need THEN z.rec + 1 ELSE 0 END, st := 'x', nxt := q.nxt, o := list_append(z.o, struct_pack(i := q.nxt.i, s := 'recovering')))
   ELSE struct_pack(act := true, rec := 0, st := 'x', nxt := q.nxt, o := list_append(z.o, struct_pack(i := q.nxt.i, s := 'unstable'))) END).o AS o FROM l, (VALUES (3), (12)) AS t(need))
 SELECT user_id, need, r.i AS pose_idx, r.s AS state FROM (SELECT user_id, need, unnest(o) AS r FROM f)""")
def s8(spark, d):
    s = sig(spark, d)
    st = F.when(F.col("quality") < 0.06, "unknown").when(F.col("v") >= 90, "unstable").when(F.col("v") >= 58, "watch").otherwise("stable")
    rows = s.select("user_id", "pose_idx", "n", st.alias("state"), (F.col("v") / 90).alias("score"))
    both = rows.withColumn("need", F.explode(F.array(F.lit(3), F.lit(12))))
    return stability.hysteresis(both, [*K, "need"], recovery=F.col("need")).select("user_id", "need", "pose_idx", "state")


def stability_input(spark, d):
    modes = F.array(*[F.lit(m) for m in ("absolute_fixed", "relative_coupled", "absolute_supported", "primary_trunk_motion")])
    k = F.col("video_id")
    return materialise(frames(spark, d)).select(
        "*", F.element_at(modes, (k % 4 + 1).cast("int")).alias("mode"), F.when(k % 3 == 0, "rear").when(k == 7, "front").otherwise("side").alias("camera_angle"),
        F.lit(4.5).alias("angle_threshold"), F.lit(4.0).alias("tilt_threshold"), F.lit(320).alias("minimum_ms"), F.lit(240).alias("recovery_ms"),
        F.when(k % 4 == 1, 9.0).otherwise(0.0).alias("max_coupled_angle"), g.family_signal(lm(), "squat").alias("move"))


@query("w17_stability")
def w17(spark, d):
    out = stability.stability_judgments(stability_input(spark, d), FPS, movement="move")
    return out.select("video_id", "pose_idx", "state", "reason_code", "direction", "duration_ms", "confidence", "score", "angle_delta", "residual")


PEOPLE = """WITH {fr}"""


def people(spark, d):
    f = frames(spark, d)
    shifted = lambda dx, k: F.transform(lm(), lambda p: p.withField("x", p["x"] * k + dx).withField("y", p["y"] * k + dx))
    crowd = F.filter(F.array(lm(), F.when(F.col("vec_id") % 3 == 0, shifted(F.lit(0.2), F.lit(0.6))), F.when(F.col("vec_id") % 5 == 0, shifted(F.lit(-0.1), F.lit(1.4)))), lambda p: p.isNotNull())
    return tracking.candidate_rows(f, V, crowd, "squat", [*TRUNK, 25, 26, 27, 28])


@query("s7_track_target")
def s7(spark, d):
    t = tracking.track_target(people(spark, d), V)
    return t.select("video_id", "frame_index", "selected", "candidates", "rejected", "switched", r6("lock_confidence"), r6("score"))
