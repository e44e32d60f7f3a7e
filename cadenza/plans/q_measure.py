"""Queries of the measurement operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import dims
from cadenza.functions.dims import LOWER_BODY, MATCH_FAMILIES, UPPER_BODY
from cadenza.functions.landmarks import (
    ARM, HINGE, JOINTS, LA, LE, LEG, LH, LK, LS, LW, METRIC_CHAINS, RA, RE, RH, RK, RS, RW,
)
from cadenza.operators import measure, signals
from cadenza.plans.q_pose import q_metric, q_signals
from cadenza.plans.q_series import K, SIG, SIGG, r6
from cadenza.plans.registry import query
from cadenza.plans.views import FPS, Q_LEAN, Q_TORSO, frames, frames_sql, q_angle, q_dist, q_min, sig, table

FR = "WITH " + frames_sql()
V = ["video_id"]


@query("a1_numeric_summary", SIGG + """ SELECT user_id, count(v) AS count, round(min(v), 9) AS min, round(max(v), 9) AS max, round(avg(v), 9) AS mean,
 round(quantile_cont(v, .05), 9) AS p05, round(quantile_cont(v, .5), 9) AS median, round(quantile_cont(v, .95), 9) AS p95,
 round(quantile_cont(v, .95) - quantile_cont(v, .05), 9) AS range FROM sig GROUP BY 1""")
def a1(spark, d):
    return measure.numeric_summary(sig(spark, d, gaps=True), K, "v", 9)


@query("a1_summary_by_type", """SELECT event_type, count(value) AS count, round(min(value), 9) AS min, round(max(value), 9) AS max, round(avg(value), 9) AS mean,
 round(quantile_cont(value, .05), 9) AS p05, round(quantile_cont(value, .5), 9) AS median, round(quantile_cont(value, .95), 9) AS p95,
 round(quantile_cont(value, .95) - quantile_cont(value, .05), 9) AS range FROM events GROUP BY 1""")
def a1b(spark, d):
    return measure.numeric_summary(spark.read.parquet(f"{d}/events.parquet").select("event_type", "value"), ["event_type"], "value", 9)


@query("a2_robust_range", SIGG + """ SELECT user_id, round(coalesce(quantile_cont(v, .95) - quantile_cont(v, .05), 0), 6) AS range, round(coalesce(avg(v), 0), 9) AS mean FROM sig GROUP BY 1""")
def a2(spark, d):
    return measure.robust_range(sig(spark, d, gaps=True), K, "v").select("user_id", r6("range"), F.round("mean", 9).alias("mean"))


def q_series_cols():
    width = f"greatest(.03, {q_dist(LS, RS)})"
    tx = f"((x{LS}+x{RS})/2 + (x{LH}+x{RH})/2) / 2"
    out = {}
    for name, sides in {"Knee": LEG, "Elbow": ARM, "Shoulder": ((LH, LS, LE), (RH, RS, RE)), "Hip": HINGE}.items():
        for label, s in zip(("left", "right"), sides):
            out[f"{label}{name}Angle"] = q_angle(*s)
    out |= {"trunkLean": Q_LEAN, "torsoX": tx, "torsoSupportOffsetX": f"CASE WHEN least(v{LA}, v{RA}) >= .55 THEN {tx} - (x{LA}+x{RA})/2 END"}
    for label, (s, e, w, a) in {"left": (LS, LE, LW, LA), "right": (RS, RE, RW, RA)}.items():
        out |= {f"{label}AnkleX": f"x{a}", f"{label}WristStack": f"abs(x{w} - x{e}) / {width}", f"{label}ElbowHeight": f"y{e} - y{s}",
                f"{label}WristAboveShoulder": f"y{s} - y{w}"}
    out |= {"hipDepth": f"(y{LH}+y{RH})/2 - (y{LK}+y{RK})/2", "shoulderWidth": width}
    return out


def rq(e, digits):
    return f"round_even(round({e}, {digits + 6}), {digits})"


def q_measurements():
    q = lambda c, p, fb: f"coalesce(quantile_cont(\"{c}\", {p}), {fb})"
    lo, hi = lambda s, j: q(f"{s}{j}Angle", .05, 180), lambda s, j: q(f"{s}{j}Angle", .95, 0)
    rng = lambda c: f"({q(c, .95, 0)} - {q(c, .05, 0)})"
    w = f"greatest(.03, {q('shoulderWidth', .5, .2)})"
    mean = lambda a, b: f"(sum(\"{a}\") + sum(\"{b}\")) / (count(\"{a}\") + count(\"{b}\"))"
    out = {"leftKneeAngleMin": (lo("left", "Knee"), 1), "rightKneeAngleMin": (lo("right", "Knee"), 1),
           "kneeAngleAsymmetry": (f"abs({lo('left', 'Knee')} - {lo('right', 'Knee')})", 1),
           "elbowAngleRange": (f"greatest(0, {hi('left', 'Elbow')} - {lo('left', 'Elbow')}, {hi('right', 'Elbow')} - {lo('right', 'Elbow')})", 1),
           "shoulderAngleMax": (f"greatest({hi('left', 'Shoulder')}, {hi('right', 'Shoulder')})", 1),
           "hipAngleMax": (f"greatest({hi('left', 'Hip')}, {hi('right', 'Hip')})", 1),
           "trunkLeanMedian": (q("trunkLean", .5, 0), 1), "trunkLeanMax": (q("trunkLean", .95, 0), 1), "trunkLeanRange": (rng("trunkLean"), 1),
           "torsoSwayRatio": (f"{rng('torsoX')} / {w}", 3), "torsoSupportSwayRatio": (f"{rng('torsoSupportOffsetX')} / {w}", 3),
           "footMovementRatio": (f"greatest({rng('leftAnkleX')}, {rng('rightAnkleX')}) / {w}", 3),
           "wristStackOffset": (mean("leftWristStack", "rightWristStack"), 3), "elbowHeightMedian": (mean("leftElbowHeight", "rightElbowHeight"), 3),
           "wristAboveShoulderMax": (f"greatest({q('leftWristAboveShoulder', .95, 0)}, {q('rightWristAboveShoulder', .95, 0)})", 3),
           "hipDepthMax": (q("hipDepth", .95, 0), 3)}
    return out


MEAS = q_measurements()
SER = f""", ser AS (SELECT video_id, n, pose_idx, {', '.join(f'{e} AS "{k}"' for k, e in q_series_cols().items())} FROM fr),
 keys AS (SELECT video_id, pose_idx * 100 AS key_ms, lead(pose_idx * 100) OVER (PARTITION BY video_id ORDER BY pose_idx) AS nx FROM fr WHERE vec_id % 3 = 0),
 tempo AS (SELECT video_id, {rq('avg((nx - key_ms) / 1000)', 2)} AS "averageRepSeconds", CASE WHEN count(nx) > 1 THEN {rq('stddev_pop((nx - key_ms) / 1000)', 2)} END AS "repTempoVariation" FROM keys GROUP BY 1)"""


def key_times(fr):
    from cadenza.operators.segment import number_in_order

    k = fr.where(F.col("vec_id") % 3 == 0).select("video_id", F.col("time_ms").alias("key_ms"), "pose_idx")
    return number_in_order(k, V, "pose_idx").drop("pose_idx")


@query("a3_measurements", FR + SER + f""" SELECT video_id, {', '.join(f'{rq(e, dg)} AS "{k}"' for k, (e, dg) in MEAS.items())}, "averageRepSeconds", "repTempoVariation"
 FROM ser LEFT JOIN tempo USING (video_id) GROUP BY video_id, "averageRepSeconds", "repTempoVariation" """)
def a3(spark, d):
    fr = frames(spark, d)
    return measure.measurements(fr, key_times(fr)).select("video_id", *MEAS, "averageRepSeconds", "repTempoVariation")


@query("a4_metric_confidence", FR + f" SELECT video_id, {', '.join(f'{rq(f'quantile_cont({q_metric(m)}, .25)', 3)} AS {chr(34)}{m}{chr(34)}' for m in METRIC_CHAINS)} FROM fr GROUP BY 1")
def a4(spark, d):
    return measure.metric_confidence_summary(frames(spark, d))


def q_side(conf, angle, flex, extra, low_p, score, raw_conf=False):
    mirror = measure._MIRROR
    parts = []
    for left in (True, False):
        m = lambda c: tuple(c) if left else tuple(mirror[i] for i in c)
        c, a = q_min(m(conf)), q_angle(*m(angle)) if angle else "0::DOUBLE"
        e = f"{extra[1]}{m((extra[0],))[0]}" if extra else "0::DOUBLE"
        ok = f"{c} >= .12 AND {a} IS NOT NULL"
        s, w = m((LS, LW))
        parts.append(f"""SELECT video_id, n, '{'left' if left else 'right'}' AS side, CASE WHEN {ok if not raw_conf else 'true'} THEN {c} END AS c, CASE WHEN {ok} THEN {flex.format(a=a)} END AS f,
 CASE WHEN {ok} THEN {e} END AS e, CASE WHEN {q_min(m((LH, LS, LE, LW)))} >= .35 THEN y{s} - y{w} END AS rise FROM fr""")
    return FR + f""", s AS ({' UNION ALL '.join(parts)}), q AS (SELECT video_id, n, side, coalesce(quantile_cont(c, .25), 0) AS conf, coalesce(quantile_cont(f, .95), 0) AS hi,
 coalesce(quantile_cont(f, {low_p}), 0) AS lo, quantile_cont(f, .05) AS lo5, coalesce(quantile_cont(e, .95), 0) - coalesce(quantile_cont(e, .05), 0) AS er, count(f) / greatest(1, n) AS ratio,
 coalesce(quantile_cont(rise, .8), 0) AS above FROM s GROUP BY 1, 2, 3), sc AS (SELECT *, {score} AS score FROM q),
 r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, side) AS rn, min(score) OVER (PARTITION BY video_id) AS other FROM sc)"""


@query("a5_working_side_pulldown", q_side((LS, LE, LW), (LS, LE, LW), "180 - {a}", (LE, "y"), .05, rq("conf * (hi - lo + er * 120)", 3))
       + f" SELECT video_id, side, score, {rq('conf', 3)} AS confidence, {rq('hi - lo', 3)} AS range, {rq('er', 3)} AS extra_range FROM r WHERE rn = 1")
def a5a(spark, d):
    return measure.working_side(frames(spark, d), "pulldown").select("video_id", "side", "score", "confidence", "range", "extra_range")


@query("a5_working_side_row", q_side((LS, LE, LW), (LS, LE, LW), "180 - {a}", (LW, "x"), .05, rq("conf * (hi - lo + er * 160)", 3))
       + f" SELECT video_id, side, score, {rq('hi', 3)} AS peak, {rq('er', 3)} AS extra_range FROM r WHERE rn = 1")
def a5b(spark, d):
    return measure.working_side(frames(spark, d), "row").select("video_id", "side", "score", "peak", "extra_range")


@query("a5_working_side_rear_leg", q_side((LS, LH, LK), (LS, LH, LK), "{a}", None, .05, rq("conf * (greatest(0, hi - coalesce(lo5, 180)) + greatest(0, hi - 118) * .25)", 3))
       + f" SELECT video_id, side, score, {rq('greatest(0, hi - coalesce(lo5, 180))', 3)} AS range FROM r WHERE rn = 1")
def a5c(spark, d):
    return measure.working_side(frames(spark, d), "rear_leg").select("video_id", "side", "score", "range")


@query("a5_working_side_press", q_side((LS, LE, LW), None, "0::DOUBLE", None, .05, "conf", True) + " SELECT video_id, side, round(score, 6) AS score FROM r WHERE rn = 1")
def a5d(spark, d):
    return measure.working_side(frames(spark, d), "press").select("video_id", "side", r6("score"))


@query("a5_working_side_y_raise", q_side((LH, LS, LE), (LH, LS, LE), "{a}", None, .1,
       rq("greatest(0, hi - lo) * least(1, ratio / .55) * greatest(.2, conf) + greatest(0, hi - 80) * .15 + greatest(0, above) * 20", 3))
       + f""" SELECT video_id, side, score, {rq(f"least(1, {rq('conf', 3)} * .45 + {rq('ratio', 3)} * .35 + greatest(0, score - other) / greatest(30, score) * .2)", 3)} AS confidence FROM r WHERE rn = 1""")
def a5e(spark, d):
    return measure.working_side(frames(spark, d), "y_raise").select("video_id", "side", "score", "confidence")


# ---- action signals ---------------------------------------------------------------

VIEWS = ["front", "front_oblique", "side", "side_front", "side_rear", "rear", "unknown"]


def q_chosen(name: str, *args) -> str:
    return f"{name} AS (WITH {q_side(*args).removeprefix(FR + ', ')} SELECT video_id, side FROM r WHERE rn = 1)"


def q_action_signals() -> str:
    fam, reach = q_signals()
    two = lambda f: tuple(f(left) for left in (True, False))
    mirror = lambda chain, left: tuple(chain) if left else tuple(measure._MIRROR[i] for i in chain)
    conf = lambda chain: two(lambda left: q_min(mirror(chain, left)))
    ang = lambda chain: two(lambda left: q_angle(*mirror(chain, left)))
    own = lambda t, pair: f"(CASE WHEN {t} = 'left' THEN {pair[0]} ELSE {pair[1]} END)"
    arm_c, arm, leg_c, leg, up_c, up = conf((LS, LE, LW)), ang((LS, LE, LW)), conf((LS, LH, LK)), ang((LS, LH, LK)), conf((LH, LS, LE)), ang((LH, LS, LE))
    high = two(lambda left: "(.68 * y{0} + .32 * y{1}) * 100".format(*mirror((LW, LE), left)))
    flexed = lambda t: f"CASE WHEN {own(t, arm_c)} >= .12 AND {own(t, arm)} IS NOT NULL THEN 180 - {own(t, arm)} ELSE {fam['pull']} END"
    swap = f"{own('ps', arm_c)} < .35 AND {own('ps', arm_c[::-1])} > {own('ps', arm_c)}"
    press = f"CASE WHEN cam IN ('side', 'side_front', 'side_rear') THEN CASE WHEN {swap} THEN {own('ps', high[::-1])} ELSE {own('ps', high)} END ELSE {fam['press']} END"
    w = [f"(CASE WHEN {c} >= .12 AND {a} IS NOT NULL THEN {c} ELSE 0 END)" for c, a in zip(arm_c, arm)]
    lat = f"CASE WHEN {w[0]} + {w[1]} > 0 THEN (coalesce((180 - {arm[0]}) * {w[0]}, 0) + coalesce((180 - {arm[1]}) * {w[1]}, 0)) / ({w[0]} + {w[1]}) ELSE {fam['pull']} END"
    sit = [q_min((LH, LK)), q_min((RH, RK))]
    hack = f"CASE WHEN greatest({sit[0]}, {sit[1]}) >= .35 THEN CASE WHEN {sit[0]} >= {sit[1]} THEN (y{LH} - y{LK}) * 100 ELSE (y{RH} - y{RK}) * 100 END END"
    raised = f"CASE WHEN {own('ys', up_c)} >= .12 AND {own('ys', up)} IS NOT NULL THEN {own('ys', up)} END"
    aside = [f"CASE WHEN {q_min((h, a))} >= .12 THEN abs(x{a} - x{h}) / {Q_TORSO} * 100 END" for h, a in ((LH, LA), (RH, RA))]
    a = lambda *names: f"act IN ({', '.join(repr(x) for x in names)})"
    family = f"CASE {' '.join(f'WHEN family = {chr(39)}{f}{chr(39)} THEN {e}' for f, e in fam.items())} ELSE {reach} END"
    direct = f"""CASE WHEN act = 'machine_chest_press' AND cam IN ('front', 'front_oblique') THEN abs(x{LW} - x{RW}) / {Q_TORSO} * 100 WHEN {a('machine_chest_press', 'bench_press')} THEN {press}
 WHEN act = 'lat_pulldown' THEN {lat} WHEN {a('single_arm_pulldown', 'chest_supported_row', 'plate_loaded_pulldown')} THEN {flexed('ds')} WHEN act = 'single_arm_hammer_row' THEN {flexed('rs')}
 WHEN act = 'hip_thrust' THEN 180 - {fam['hinge']} WHEN act = 'plate_loaded_rear_leg_raise' THEN CASE WHEN {own('ls', leg_c)} >= .12 AND {own('ls', leg)} IS NOT NULL THEN {own('ls', leg)} ELSE 180 - {fam['hinge']} END
 WHEN act = 'back_extension' THEN {fam['hinge']} WHEN act = 'preacher_curl' THEN {fam['isolation_elbow']} WHEN {a('plate_loaded_romanian_deadlift', 'machine_crunch')} THEN {fam['core_flexion']} WHEN act = 'seated_hip_abduction' THEN {fam['isolation_hip']}
 WHEN {a('hack_squat', 'y_raise', 'standing_hip_abduction')} THEN NULL ELSE {family} END"""
    fill = lambda col, empty: f"""coalesce({col}, CASE WHEN {col}p IS NOT NULL AND {col}n IS NOT NULL THEN {col}p.v + ({col}n.v - {col}p.v) * (pose_idx - {col}p.i) / ({col}n.i - {col}p.i) END, {col}p.v, {col}n.v, {empty})"""
    near = lambda col: f"""last_value(CASE WHEN {col} IS NOT NULL THEN struct_pack(i := pose_idx, v := {col}) END IGNORE NULLS) OVER (PARTITION BY act, video_id ORDER BY pose_idx ROWS UNBOUNDED PRECEDING) AS {col}p,
 first_value(CASE WHEN {col} IS NOT NULL THEN struct_pack(i := pose_idx, v := {col}) END IGNORE NULLS) OVER (PARTITION BY act, video_id ORDER BY pose_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {col}n"""
    labels = " ".join(f"WHEN act = '{k}' THEN '{v}'" for k, v in signals.SOURCES.items())
    sides = ", ".join([
        q_chosen("sd", (LS, LE, LW), (LS, LE, LW), "180 - {a}", (LE, "y"), .05, rq("conf * (hi - lo + er * 120)", 3)),
        q_chosen("sr", (LS, LE, LW), (LS, LE, LW), "180 - {a}", (LW, "x"), .05, rq("conf * (hi - lo + er * 160)", 3)),
        q_chosen("sl", (LS, LH, LK), (LS, LH, LK), "{a}", None, .05, rq("conf * (greatest(0, hi - coalesce(lo5, 180)) + greatest(0, hi - 118) * .25)", 3)),
        q_chosen("sp", (LS, LE, LW), None, "0::DOUBLE", None, .05, "conf", True),
        q_chosen("sy", (LH, LS, LE), (LH, LS, LE), "{a}", None, .1, rq("greatest(0, hi - lo) * least(1, ratio / .55) * greatest(.2, conf) + greatest(0, hi - 80) * .15 + greatest(0, above) * 20", 3))])
    acts = ", ".join(f"({k}, '{name}', '{f}')" for k, (name, (f, _)) in enumerate(dims.ACTIONS.items()))
    return FR + f""", {sides}, ac AS (SELECT * FROM (VALUES {acts}) AS t(no, act, family)),
 b AS (SELECT fr.*, act, family, [{', '.join(repr(v) for v in VIEWS)}][(video_id + no) % 7 + 1] AS cam, sd.side AS ds, sr.side AS rs, sl.side AS ls, sp.side AS ps, sy.side AS ys FROM fr CROSS JOIN ac
  JOIN sd USING (video_id) JOIN sr USING (video_id) JOIN sl USING (video_id) JOIN sp USING (video_id) JOIN sy USING (video_id)),
 e AS (SELECT video_id, pose_idx, n, act, CASE WHEN act = 'machine_chest_press' AND cam IN ('front', 'front_oblique') THEN '{signals.FRONT_PRESS_SOURCE}' {labels} ELSE family || '_joint_angle' END AS source, {direct} AS v,
  CASE WHEN act = 'hack_squat' THEN {hack} END AS h, CASE WHEN act = 'y_raise' THEN {raised} END AS y, {fam['isolation_shoulder']} AS sh, {fam['isolation_hip']} AS ap,
  CASE WHEN act = 'standing_hip_abduction' THEN {aside[0]} END AS l, CASE WHEN act = 'standing_hip_abduction' THEN {aside[1]} END AS r, {q_min((LH, LA))} AS lc, {q_min((RH, RA))} AS rc FROM b),
 k AS (SELECT *, {near('y')}, {near('l')}, {near('r')} FROM e),
 f AS (SELECT *, {fill('y', 'sh')} AS yf, {fill('l', 'ap')} AS lf, {fill('r', 'ap')} AS rf FROM k),
 t AS (SELECT video_id, act, (quantile_cont(rf, .95) - quantile_cont(rf, .05)) * quantile_cont(rc, .25) > (quantile_cont(lf, .95) - quantile_cont(lf, .05)) * quantile_cont(lc, .25) AS better FROM f GROUP BY 1, 2)
 SELECT video_id, act AS action_type, pose_idx, source, round(CASE act WHEN 'hack_squat' THEN coalesce(h, avg(h) OVER (PARTITION BY video_id, act), 0) WHEN 'y_raise' THEN yf WHEN 'standing_hip_abduction' THEN CASE WHEN better THEN rf ELSE lf END ELSE v END, 6) AS signal
 FROM f JOIN t USING (video_id, act)"""


@query("x3_action_signals", q_action_signals())
def x3_actions(spark, d):
    """Every video under every action, the view changing from action to action."""
    acts = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(name).alias("action_type"), F.lit(f).alias("family")) for k, (name, (f, _)) in enumerate(dims.ACTIONS.items())])
    view = F.element_at(F.array(*[F.lit(v) for v in VIEWS]), ((F.col("video_id") + F.col("no")) % 7 + 1).cast("int"))
    videos = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("video_id")).distinct()
    actions = videos.select("video_id", F.explode(acts).alias("a")).select("video_id", "a.*").withColumn("camera_angle", view)
    out = signals.action_signals(frames(spark, d), actions, V)
    return out.select("video_id", "action_type", "pose_idx", "source", r6("signal"))


AXES = {"elbow_y_left": (LE, "y"), "elbow_x_right": (RE, "x")}


@query("a6_axis_range", FR + f", w AS (SELECT video_id, quantile_cont(r, .8) AS wa FROM (SELECT video_id, unnest([CASE WHEN least(v{LS}, v{LW}) >= .45 THEN y{LS} - y{LW} END, CASE WHEN least(v{RS}, v{RW}) >= .45 THEN y{RS} - y{RW} END]) AS r FROM fr) GROUP BY 1) SELECT video_id, "
       + ", ".join(f"round(CASE WHEN count(*) FILTER (WHERE v{s} >= .45) >= 3 THEN quantile_cont({ax}{s}, .95) FILTER (WHERE v{s} >= .45) - quantile_cont({ax}{s}, .05) FILTER (WHERE v{s} >= .45) ELSE 0 END, 6) AS {k}" for k, (s, ax) in AXES.items())
       + ", round(coalesce(wa, 0), 6) AS wrist_above FROM fr JOIN w USING (video_id) GROUP BY video_id, wa")
def a6(spark, d):
    fr = frames(spark, d)
    out = measure.axis_range(fr, AXES).join(measure.wrist_above_score(fr), V)
    return out.select("video_id", *[r6(k) for k in AXES], r6("wrist_above"))


def q_profile():
    s, _ = q_signals()
    lists = ", ".join(f"struct_pack(family := '{f}', v := {s[f]})" for f in MATCH_FAMILIES)
    return f""", u AS (SELECT video_id, n, pose_idx, unnest([{lists}]) AS p FROM fr WHERE n >= 8), u2 AS (SELECT video_id, n, pose_idx, p.family AS family, p.v AS v FROM u),
 sm AS (SELECT *, (sum(v) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + CASE WHEN pose_idx = 0 THEN v ELSE 0 END + CASE WHEN pose_idx = n - 1 THEN v ELSE 0 END) / 3 AS s FROM u2
  WINDOW w AS (PARTITION BY video_id, family ORDER BY pose_idx)),
 rng AS (SELECT video_id, family, n, quantile_cont(s, .95) - quantile_cont(s, .05) AS rg FROM sm GROUP BY 1, 2, 3),
 w AS (SELECT video_id, family, pose_idx, s, rg, lag(s) OVER p AS pv, lead(s) OVER p AS nv, min(s) OVER (p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS lm, min(s) OVER (p ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS rm
  FROM sm JOIN rng USING (video_id, family) WHERE rg >= 4 AND sm.n >= 20 WINDOW p AS (PARTITION BY video_id, family ORDER BY pose_idx)),
 l AS (SELECT video_id, family, list(pose_idx ORDER BY s DESC, pose_idx) AS c FROM w WHERE s > pv AND s >= nv AND s - greatest(lm, rm) >= greatest(3, rg * .18) GROUP BY 1, 2),
 k AS (SELECT video_id, family, len(list_reduce(list_prepend([]::BIGINT[], list_transform(c, lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k - x[1]) < 10)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS reps FROM l),
 prof AS (SELECT video_id, family, n, CASE WHEN n >= 20 THEN {rq('rg', 1)} ELSE 0 END AS range, coalesce(reps, 0) AS reps FROM rng LEFT JOIN k USING (video_id, family))"""


def q_in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SIGN = q_profile() + f""", pf AS (SELECT *, CASE WHEN video_id % 2 = 0 THEN 'hinge' ELSE 'squat' END AS pref FROM prof),
 t AS (SELECT video_id, n, arg_min(family, struct_pack(r := -range, f := family)) AS bf, max(range) AS br, max(range) FILTER (WHERE family = pref) AS pr, any_value(pref) AS pref,
 max(range) FILTER (WHERE family IN {q_in(LOWER_BODY)}) AS lower_range, max(range) FILTER (WHERE family IN {q_in(UPPER_BODY)}) AS upper_range, max(reps) FILTER (WHERE family = 'hinge') AS hinge_reps FROM pf GROUP BY 1, 2),
 t2 AS (SELECT *, CASE WHEN abs(pr - br) <= greatest(1, br * .03) THEN pref ELSE bf END AS family, CASE WHEN abs(pr - br) <= greatest(1, br * .03) THEN pr ELSE br END AS peak FROM t),
 sgn AS (SELECT t2.*, {rq("least(.98, greatest(0, (peak - (SELECT max(range) FROM prof p WHERE p.video_id = t2.video_id AND p.family <> t2.family)) / greatest(8, peak)))", 3)} AS confidence,
 CASE WHEN family IN {q_in(LOWER_BODY)} THEN 'lower_body' ELSE 'upper_body' END AS body_group FROM t2)"""


def preferred():
    return F.when(F.col("video_id") % 2 == 0, "hinge").otherwise("squat")


@query("a7_movement_signature", FR + SIGN + " SELECT video_id, family, body_group, peak, confidence, lower_range, upper_range, hinge_reps FROM sgn")
def a7(spark, d):
    prof = measure.family_profile(frames(spark, d), FPS)
    return measure.movement_signature(prof, preferred()).select("video_id", "family", "body_group", "peak", "confidence", "lower_range", "upper_range", "hinge_reps")


def q_foot():
    parts = []
    for label, (h, k, a) in {"left": (LH, LK, LA), "right": (RH, RK, RA)}.items():
        odd = f"(v{h} >= .35 AND {q_dist(h, k)} >= .035 AND ({q_dist(k, a)} < {q_dist(h, k)} * .28 OR {q_dist(k, a)} > {q_dist(h, k)} * 2.25))"
        parts.append(f"SELECT video_id, n, '{label}' AS side, x{a} AS x, y{a} AS y, v{a} AS v, v{a} >= .32 AND v{k} >= .35 AND y{a} + .04 >= y{k} AND NOT {odd} AS ok FROM fr")
    return f""", c AS ({' UNION ALL '.join(parts)}), bs AS (SELECT video_id, greatest(.06, coalesce(quantile_cont({q_dist(LS, RS)}, .5) FILTER (WHERE least(v{LS}, v{RS}) >= .35), .18)) AS body_scale FROM fr GROUP BY 1),
 q AS (SELECT video_id, n, side, count(*) FILTER (WHERE ok) AS candidates, greatest(quantile_cont(x, .9) FILTER (WHERE ok) - quantile_cont(x, .1) FILTER (WHERE ok), quantile_cont(y, .9) FILTER (WHERE ok) - quantile_cont(y, .1) FILTER (WHERE ok)) / body_scale AS spread,
 quantile_cont(x, .5) FILTER (WHERE ok) AS ax, quantile_cont(y, .5) FILTER (WHERE ok) AS ay, quantile_cont(v, .5) FILTER (WHERE ok) AS av FROM c JOIN bs USING (video_id) GROUP BY 1, 2, 3, body_scale),
 z AS (SELECT *, candidates >= greatest(3, least(8, n // 4)) AS enough, coalesce(candidates >= greatest(3, least(8, n // 4)) AND spread <= .68, false) AS accepted FROM q)
 SELECT video_id, side, candidates, accepted, CASE WHEN enough THEN {rq('spread', 3)} END AS spread_ratio, CASE WHEN accepted THEN round(ax, 6) END AS anchor_x, CASE WHEN accepted THEN round(ay, 6) END AS anchor_y,
 CASE WHEN accepted THEN round(greatest(.68, least(.94, av)), 6) END AS anchor_conf FROM z"""


@query("a8_foot_anchors", FR + q_foot())
def a8(spark, d):
    a = measure.foot_anchors(frames(spark, d), "hack_squat")
    return a.select("video_id", "side", "candidates", "accepted", "spread_ratio", r6("anchor_x"), r6("anchor_y"), r6("anchor_conf"))


def q_deltas():
    lists = lambda: ", ".join(f"struct_pack(joint := '{j}', angle := CASE WHEN {q_min(c)} >= .2 THEN {q_angle(*c)} END)" for j, c in JOINTS.items())
    return f"""WITH {frames_sql()}, {frames_sql('b', 'fb')}, la AS (SELECT video_id, frame_index, unnest([{lists()}]) AS p FROM fr), lb AS (SELECT video_id, frame_index, unnest([{lists()}]) AS p FROM fb),
 dl AS (SELECT a.video_id, a.p.joint AS joint, a.frame_index, abs(a.p.angle - b.p.angle) AS delta FROM la a JOIN lb b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND a.p.joint = b.p.joint
 WHERE a.p.angle IS NOT NULL AND b.p.angle IS NOT NULL), sm AS (SELECT video_id, joint, count(*) AS count, {rq('avg(delta)', 2)} AS mean_abs, {rq('quantile_cont(delta, .5)', 2)} AS median_abs, {rq('quantile_cont(delta, .95)', 2)} AS p95_abs FROM dl GROUP BY 1, 2)"""


def deltas(spark, d):
    # a rigid shift leaves angles alone, so the second engine also swaps two points
    return measure.engine_deltas(frames(spark, d), swapped(frames(spark, d, "b")))


def swapped(fr):
    lm = F.col("landmarks")
    bent = F.transform(lm, lambda p, i: F.when(i == LK, p.withField("x", p["x"] + 0.05)).when(i == RE, p.withField("y", p["y"] - 0.08)).otherwise(p))
    return fr.withColumn("landmarks", bent)


def q_bent(sql: str) -> str:
    head, tail = sql.split("fb AS (", 1)
    tail = tail.replace(f"embedding[1]::DOUBLE / 10.0 AS x{LK}", f"embedding[1]::DOUBLE / 10.0 + 0.05 AS x{LK}", 1).replace(
        f"embedding[1]::DOUBLE / 10.0 AS y{RE}", f"embedding[1]::DOUBLE / 10.0 - 0.08 AS y{RE}", 1)
    return head + "fb AS (" + tail


DELTAS = q_bent(q_deltas())


@query("j5_engine_deltas", DELTAS + " SELECT video_id, joint, frame_index, round(delta, 4) AS delta FROM dl")
def j5(spark, d):
    return deltas(spark, d).select("video_id", "joint", "frame_index", F.round("delta", 4).alias("delta"))


@query("a9_joint_delta_summary", DELTAS + " SELECT * FROM sm")
def a9(spark, d):
    return measure.joint_delta_summary(deltas(spark, d))


@query("t1_top_divergent", DELTAS + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY median_abs DESC, mean_abs DESC, p95_abs DESC, joint) AS rank FROM sm) WHERE rank <= 5")
def t1(spark, d):
    return measure.top_divergent(measure.joint_delta_summary(deltas(spark, d)))


@query("a16_coupling_fit", SIG + """, st AS (SELECT user_id, quantile_cont(v, .95) - quantile_cont(v, .05) AS span, quantile_cont(v, .5) AS mid FROM sig GROUP BY 1)
 SELECT user_id, round(span, 6) AS motion_span, CASE WHEN count(*) FILTER (WHERE quality >= .55) >= 5 THEN round(regr_slope(event_id % 50, (v - mid) / span) FILTER (WHERE quality >= .55), 6) END AS slope,
 CASE WHEN count(*) FILTER (WHERE quality >= .55) >= 5 THEN round(regr_intercept(event_id % 50, (v - mid) / span) FILTER (WHERE quality >= .55), 6) END AS intercept
 FROM sig JOIN st USING (user_id) GROUP BY user_id, span""")
def a16(spark, d):
    s = sig(spark, d).withColumn("angle", (F.col("event_id") % 50).cast("double"))
    return measure.coupling_fit(s, K, "angle", "v", "quality").select("user_id", r6("motion_span"), r6("slope"), r6("intercept"))


@query("a17_noise_threshold", SIG + """, s AS (SELECT user_id, abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY pose_idx)) AS st FROM sig)
 SELECT user_id, round(coalesce(quantile_cont(st, .5), 0) / .6745, 6) AS noise, round(greatest(200, coalesce(quantile_cont(st, .5), 0) / .6745 * 3.5), 6) AS threshold FROM s GROUP BY 1""")
def a17(spark, d):
    t = measure.noise_threshold(sig(spark, d), K, {"t": ("v", 200.0)})
    return t.select("user_id", r6("t_noise", "noise"), r6("t", "threshold"))
