"""Queries of the rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.core.quantiles import quantiles
from cadenza.core.session import materialise
from cadenza.functions import dims, geometry as g
from cadenza.functions.dims import ACTION_NAMES, ACTIONS, CAMERAS
from cadenza.functions.landmarks import ARM, HINGE, LE, LEG, LH, LK, LS, LW, METRIC_CHAINS, RE, RH, RK, RS, RW, TRUNK
from cadenza.operators import measure, rules, scoring
from cadenza.plans.q_measure import FR, SER, SIGN, V, key_times, preferred, q_in, rq
from cadenza.plans.q_pose import action_of, family_of, lm, q_list, Q_ACTION, Q_FAMILY
from cadenza.plans.q_results import CODES, read
from cadenza.plans.registry import query
from cadenza.plans.views import FPS, Q_LEAN, frames, frames_sql, q_angle, q_bilateral, q_dist, q_min

# One measurement row per order line: every action meets every camera.
M = {"trunkLeanRange": ("l_quantity", 1), "trunkLeanMax": ("l_quantity + 30", 1), "torsoSupportSwayRatio": ("l_discount * 5", 3), "averageRepSeconds": ("l_tax * 20", 2),
     "motionRange": ("l_quantity * 2", 1), "hipDepthMax": ("l_discount - .06", 3), "leftKneeAngleMin": ("l_quantity + 90", 1), "rightKneeAngleMin": ("l_quantity + 92", 1),
     "leftHipAngleMin": ("l_quantity + 100", 1), "rightHipAngleMin": ("l_quantity + 103", 1), "hipAngleMax": ("l_quantity + 125", 1), "footMovementRatio": ("l_tax * 4", 3),
     "kneeAngleAsymmetry": ("l_quantity / 2", 1), "wristStackOffset": ("l_discount * 6", 3), "elbowAngleAsymmetry": ("l_quantity / 2", 1), "elbowHeightMedian": ("l_tax * 2", 3),
     "elbowAngleRange": ("l_quantity + 10", 1), "leftElbowAngleMin": ("l_quantity + 80", 1), "rightElbowAngleMin": ("l_quantity + 82", 1), "leftElbowAngleMax": ("l_quantity + 100", 1),
     "rightElbowAngleMax": ("l_quantity + 98", 1), "shoulderAngleMax": ("l_quantity + 85", 1), "torsoSwayRatio": ("l_discount * 4", 3),
     "rear_confidence": ("l_discount * 9", 3), "rear_peak": ("l_quantity + 120", 1), "rear_range": ("l_quantity", 1), "row_confidence": ("l_discount * 9", 3), "row_range": ("l_quantity", 1),
     "row_peak": ("l_quantity + 40", 1), "y_confidence": ("l_discount * 9", 3), "y_peak": ("l_quantity + 80", 1)}
CONF = {m: f"({i} * 13 + l_suppkey) % 10 / 10 + .05" for i, m in enumerate(METRIC_CHAINS)}
MROWS = f"""mr AS (SELECT l_orderkey AS job, l_partkey AS video, l_linenumber AS no, l_suppkey, l_shipdate, l_extendedprice, {q_list(ACTION_NAMES)}[l_partkey % 37 + 1] AS action_type, {q_list([f for f, _ in ACTIONS.values()])}[l_partkey % 37 + 1] AS family,
 {q_list(CAMERAS)}[l_suppkey % 7 + 1] AS camera_angle, CASE WHEN l_partkey % 41 = 0 THEN 'insufficient' ELSE 'good' END AS capture_quality, l_partkey % 43 = 0 AS mismatch,
 {', '.join(f'round({e}, {p}) AS "{k}"' for k, (e, p) in M.items())}, {', '.join(f'{e} AS "conf_{m}"' for m, e in CONF.items())} FROM lineitem)"""


def measure_rows(spark, d):
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), c.cast("int"))
    k = F.col("l_partkey")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job"), k.alias("video"), F.col("l_linenumber").alias("no"), "l_suppkey", "l_shipdate", "l_extendedprice",
        pick(ACTION_NAMES, k % 37 + 1).alias("action_type"), pick([f for f, _ in ACTIONS.values()], k % 37 + 1).alias("family"), pick(CAMERAS, F.col("l_suppkey") % 7 + 1).alias("camera_angle"),
        F.when(k % 41 == 0, "insufficient").otherwise("good").alias("capture_quality"), (k % 43 == 0).alias("mismatch"),
        *[F.expr(f"round({e}, {p})").cast("double").alias(n) for n, (e, p) in M.items()], *[F.expr(e).cast("double").alias(f"conf_{m}") for m, e in CONF.items()])


def q_set_rules():
    sees = lambda m: f'"conf_{m}" >= .55'
    lean = lambda x: f'{sees("trunkLean")} AND "trunkLeanRange" > {x}'
    a, cam = lambda *n: f"action_type IN {q_in(n)}", lambda *n: f"camera_angle IN {q_in(n)}"
    side, front = cam("side", "side_front", "side_rear"), cam("front", "front_oblique")
    fam = lambda f: f"family = '{f}'"
    sq = f"{fam('squat')} AND NOT {a('hack_squat')}"
    hi = f"{fam('hinge')} AND NOT {a('plate_loaded_rear_leg_raise', 'hip_thrust', 'back_extension')}"
    rdl = a("romanian_deadlift", "plate_loaded_romanian_deadlift")
    pr = f"{fam('press')} AND NOT {a('machine_chest_press')}"
    knee, hip = 'least("leftKneeAngleMin", "rightKneeAngleMin")', 'least("leftHipAngleMin", "rightHipAngleMin")'
    t = {
        "Y_RAISE_CAMERA_LIMITED": f"{a('y_raise')} AND NOT {front}",
        "SINGLE_ARM_PULLDOWN_CAMERA_LIMITED": f"{a('single_arm_pulldown')} AND NOT {cam('front', 'front_oblique', 'side_front')}",
        "HAMMER_ROW_CAMERA_LIMITED": f"{a('single_arm_hammer_row')} AND NOT {cam('side', 'side_front', 'front_oblique')}",
        "PREACHER_CURL_CAMERA_LIMITED": f"{a('preacher_curl')} AND NOT {cam('side', 'side_front', 'front_oblique')}",
        "SIDE_VIEW_RECOMMENDED": f"{a('hack_squat', 'hip_thrust', 'back_extension', 'romanian_deadlift', 'plate_loaded_rear_leg_raise')} AND NOT {side}",
        "TORSO_SWAY": f"family IN ('squat', 'hinge') AND {cam('front', 'front_oblique', 'rear')} AND NOT {a('hack_squat', 'hip_thrust')} AND {sees('ankleSupport')} AND \"torsoSupportSwayRatio\" > .32",
        "TEMPO_TOO_FAST": '"averageRepSeconds" < .9',
        "HACK_SQUAT_DEPTH_LIMITED": f"{a('hack_squat')} AND \"motionRange\" > 10 AND CASE WHEN \"hipDepthMax\" = 0 THEN -1 ELSE \"hipDepthMax\" END < -.035",
        "HACK_SQUAT_SUPPORT_SHIFT": f"{a('hack_squat')} AND {lean(28)}",
        "SQUAT_DEPTH_LIMITED": f"{sq} AND {sees('kneeAngle')} AND {knee} > 118 AND \"motionRange\" > 10",
        "SQUAT_TRUNK_LEAN": f"{sq} AND {sees('trunkLean')} AND \"trunkLeanMax\" > 62",
        "FOOT_PRESSURE_UNSTABLE": f"{sq} AND {sees('ankleSupport')} AND \"footMovementRatio\" > .28",
        "KNEE_ASYMMETRY": f"{sq} AND {sees('kneeAngle')} AND {cam('front', 'front_oblique', 'rear')} AND \"kneeAngleAsymmetry\" > 16",
        "REAR_LEG_RAISE_EVIDENCE_LIMITED": f"{a('plate_loaded_rear_leg_raise')} AND rear_confidence < .55",
        "REAR_LEG_RAISE_EXTENSION_LIMITED": f"{a('plate_loaded_rear_leg_raise')} AND rear_confidence >= .55 AND (rear_peak < 145 OR rear_range < 22)",
        "REAR_LEG_RAISE_SUPPORT_SHIFT": f"{a('plate_loaded_rear_leg_raise')} AND {lean(24)}",
        "HIP_THRUST_LOCKOUT_INCOMPLETE": f"{a('hip_thrust')} AND {sees('hipAngle')} AND \"hipAngleMax\" < 150",
        "HIP_THRUST_TORSO_SHIFT": f"{a('hip_thrust')} AND {lean(30)}", "BACK_EXTENSION_RANGE_LIMITED": f"{a('back_extension')} AND \"motionRange\" < 20",
        "HINGE_RANGE_LIMITED": f"{hi} AND {sees('hipAngle')} AND {hip} > 130", "HINGE_KNEE_DRIFT": f"{hi} AND NOT {rdl} AND {sees('kneeAngle')} AND {knee} < 112",
        "HINGE_TRUNK_CONTROL": f"{hi} AND NOT {rdl} AND {lean(28)}", "MACHINE_CHEST_PRESS_SUPPORT_SHIFT": f"{a('machine_chest_press')} AND {lean(28)}",
        "WRIST_STACK": f"{pr} AND {sees('wristStack')} AND \"wristStackOffset\" > .48",
        "PRESS_ASYMMETRY": f"{pr} AND NOT ({a('bench_press')} AND {cam('side')}) AND {sees('elbowAngle')} AND \"elbowAngleAsymmetry\" > 18",
        "BENCH_SAFETY_VIEW": f"{a('bench_press')} AND NOT {side}", "HAMMER_ROW_EVIDENCE_LIMITED": f"{a('single_arm_hammer_row')} AND row_confidence < .55",
        "HAMMER_ROW_RANGE_LIMITED": f"{a('single_arm_hammer_row')} AND row_confidence >= .55 AND (row_range < 28 OR row_peak < 62)",
        "HAMMER_ROW_TORSO_COMPENSATION": f"{a('single_arm_hammer_row')} AND {lean(24)}", "CHEST_SUPPORTED_ROW_SUPPORT_SHIFT": f"{a('chest_supported_row')} AND {lean(32)}",
        "PULL_TORSO_COMPENSATION": f"{fam('pull')} AND NOT {a('single_arm_hammer_row', 'chest_supported_row')} AND {lean(20)}",
        "ELBOW_PATH_LOW": f"{a('open_elbow_row')} AND \"elbowHeightMedian\" > .13",
        "PREACHER_CURL_RANGE_LIMITED": f"{a('preacher_curl')} AND {sees('elbowAngle')} AND (\"elbowAngleRange\" < 35 OR least(\"leftElbowAngleMin\", \"rightElbowAngleMin\") > 115 OR greatest(\"leftElbowAngleMax\", \"rightElbowAngleMax\") < 125)",
        "PREACHER_CURL_BODY_SWING": f"{a('preacher_curl')} AND {lean(16)}", "ISOLATION_ELBOW_BODY_SWING": f"{fam('isolation_elbow')} AND NOT {a('preacher_curl')} AND {lean(18)}",
        "Y_RAISE_TOP_RANGE_INCOMPLETE": f"{a('y_raise')} AND CASE WHEN y_confidence = 0 THEN \"conf_shoulderAngle\" ELSE y_confidence END >= .55 AND y_peak < 108",
        "ISOLATION_BODY_SWING": f"{fam('isolation_shoulder')} AND {sees('trunkLean')} AND (\"trunkLeanRange\" > 18 OR \"torsoSwayRatio\" > .3)",
        "MACHINE_CRUNCH_CAMERA_LIMITED": f"{a('machine_crunch')} AND NOT {side}", "HIP_ABDUCTION_CAMERA_LIMITED": f"{a('seated_hip_abduction')} AND {cam('side', 'side_rear')}",
        "HIP_ABDUCTION_TORSO_SWAY": f"{a('standing_hip_abduction', 'seated_hip_abduction')} AND {lean(20)}",
    }
    parts = ["SELECT job, video, 'INSUFFICIENT_EVIDENCE' AS code, 'red' AS severity FROM mr WHERE capture_quality = 'insufficient'",
             "SELECT job, video, 'ACTION_MISMATCH', 'red' FROM mr WHERE capture_quality <> 'insufficient' AND mismatch"]
    parts += [f"SELECT job, video, '{code}', 'yellow' FROM mr WHERE capture_quality <> 'insufficient' AND NOT mismatch AND {cond}" for code, cond in t.items()]
    return f"WITH {MROWS}, x AS ({' UNION ALL '.join(parts)}) SELECT job, video, code, severity, count(*) AS issues FROM x GROUP BY ALL"


@query("r1_set_rules", q_set_rules())
def r1(spark, d):
    out = rules.set_rules(measure_rows(spark, d), ["job", "video"])
    return out.groupBy("job", "video", "code", "severity").agg(F.count(F.lit(1)).alias("issues"))


def rep_input(spark, d):
    """Every frame is the key of one repetition that spans its neighbours."""
    f = materialise(frames(spark, d))
    n = F.col("n")
    reps = f.select(
        "video_id", F.col("pose_idx").alias("rep_index"), F.greatest(F.lit(0), F.col("pose_idx") - 3).alias("start_idx"), F.col("pose_idx").alias("key_idx"),
        F.least(n - 1, F.col("pose_idx") + 4).alias("end_idx"), (F.col("vec_id") % 25).cast("double").alias("amplitude"), action_of(F.col("vec_id")).alias("action_type"),
        family_of(F.col("vec_id")).alias("family"), F.element_at(F.array(*[F.lit(c) for c in CAMERAS]), (F.col("vec_id") % 7 + 1).cast("int")).alias("camera_angle"))
    clear = F.transform("landmarks", lambda p: p.withField("vis", F.least(F.lit(1.0), p["vis"] + 0.2)))
    return reps, f.withColumn("landmarks", clear)


@query("r2_rep_rules")
def r2(spark, d):
    reps, f = rep_input(spark, d)
    name = lambda v, out: measure.working_side(f, v).select("video_id", F.col("side").alias(out))
    sides = name("pulldown", "pulldown_side").join(name("row", "row_side"), V).join(name("rear_leg", "rear_side"), V).join(name("y_raise", "y_side"), V)
    return rules.rep_rules(reps, f, V, sides).select("video_id", "rep_index", "code", "severity", "metric")


def _c(i):
    return f"avg(c{i}) OVER w"


SQ = FR + f""", z AS (SELECT video_id, pose_idx, n, vec_id, {Q_ACTION} AS act, {Q_FAMILY} AS fam, {q_list(CAMERAS)}[vec_id % 7 + 1] AS cam, (vec_id % 25)::DOUBLE AS amplitude,
 {', '.join(f'least(1, v{i} + .2) AS v{i}' for i in (LS, RS, LE, RE, LW, RW, LH, RH, LK, RK, 27, 28))}, {', '.join(f'x{i}, y{i}' for i in (LS, RS, LE, RE, LW, RW, LH, RH, LK, RK, 27, 28))} FROM fr),
 cf AS (SELECT *, round_even(round(avg({q_min(LEG[0])}) OVER w, 9), 3) AS kl, round_even(round(avg({q_min(LEG[1])}) OVER w, 9), 3) AS kr, round_even(round(avg(least({q_min(LEG[0])}, {q_min(LEG[1])})) OVER w, 9), 3) AS kb, round_even(round(avg({q_min(TRUNK)}) OVER w, 9), 3) AS tc,
  round_even(round(avg(least({q_min(ARM[0])}, {q_min(ARM[1])})) OVER w, 9), 3) AS eb FROM z WINDOW w AS (PARTITION BY video_id ORDER BY pose_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 a AS (SELECT *, {q_angle(*LEG[0])} AS al, {q_angle(*LEG[1])} AS ar, {Q_LEAN} AS lean, cam IN ('side', 'side_front', 'side_rear') AS sv FROM cf),
 b AS (SELECT *, CASE WHEN sv THEN greatest(kl, kr) ELSE kb END AS kc, CASE WHEN sv THEN CASE WHEN kl >= kr THEN al ELSE ar END ELSE least(al, ar) END AS ka FROM a)"""


@query("r2_squat_rep_rules", SQ + """ SELECT video_id, pose_idx AS rep_index, code FROM (SELECT video_id, pose_idx, 'LOW_CONFIDENCE_EVIDENCE' AS code FROM b WHERE fam = 'squat' AND act <> 'hack_squat' AND kc < .55
 UNION ALL SELECT video_id, pose_idx, 'SQUAT_DEPTH_LIMITED' FROM b WHERE fam = 'squat' AND act <> 'hack_squat' AND kc >= .55 AND ka > 118 UNION ALL SELECT video_id, pose_idx, 'SQUAT_TRUNK_LEAN' FROM b WHERE fam = 'squat' AND act <> 'hack_squat' AND kc >= .55 AND tc >= .55 AND lean > 62
 UNION ALL SELECT video_id, pose_idx, CASE WHEN tc < .55 THEN 'LOW_CONFIDENCE_EVIDENCE' ELSE 'MACHINE_CRUNCH_RANGE_LIMITED' END FROM b WHERE act = 'machine_crunch' AND (tc < .55 OR amplitude < 12)
 UNION ALL SELECT video_id, pose_idx, CASE WHEN greatest(kl, kr) < .55 THEN 'LOW_CONFIDENCE_EVIDENCE' ELSE 'HIP_ABDUCTION_RANGE_LIMITED' END FROM b WHERE act IN ('standing_hip_abduction', 'seated_hip_abduction')
  AND (greatest(kl, kr) < .55 OR NOT (act = 'seated_hip_abduction' AND cam IN ('side', 'side_rear')) AND amplitude < CASE WHEN act = 'seated_hip_abduction' THEN 12 ELSE 10 END))""")
def r2b(spark, d):
    reps, f = rep_input(spark, d)
    some = reps.where("(family = 'squat' AND action_type <> 'hack_squat') OR action_type IN ('machine_crunch', 'standing_hip_abduction', 'seated_hip_abduction')")
    return rules.rep_rules(some, f, V).select("video_id", "rep_index", "code")


@query("r4_movement_match", FR + SIGN + f""", e AS (SELECT *, CASE WHEN video_id % 2 = 0 THEN 'press' ELSE 'squat' END AS ef FROM sgn), r AS (SELECT *, CASE WHEN ef = 'squat' THEN lower_range ELSE upper_range END AS own, CASE WHEN ef = 'squat' THEN upper_range ELSE lower_range END AS oth,
 CASE WHEN ef = 'squat' THEN 'lower_body' ELSE 'upper_body' END AS eg FROM e), m AS (SELECT *, body_group <> eg AND oth >= 14 AND (own < 8 OR oth / greatest(1, own) >= 1.6) AS mismatch FROM r)
 SELECT video_id, eg AS expected_group, body_group AS detected_group, mismatch, CASE WHEN mismatch THEN {rq('least(.98, greatest(0, (oth / greatest(1, own) - 1) / 1.8))', 3)} ELSE 0 END AS confidence, {rq('oth / greatest(1, own)', 2)} AS dominance_ratio FROM m""")
def r4(spark, d):
    sign = measure.movement_signature(measure.family_profile(frames(spark, d), FPS), preferred())
    return rules.movement_match(sign, F.when(F.col("video_id") % 2 == 0, "press").otherwise("squat"), V)


@query("r5_infer_action")
def r5(spark, d):
    f = materialise(frames(spark, d))
    sign = measure.movement_signature(measure.family_profile(f, FPS))
    slots = {"yl": (LE, "y"), "yr": (RE, "y"), "xl": (LE, "x"), "xr": (RE, "x")}
    ax = measure.axis_range(f, slots).join(measure.wrist_above_score(f), V)
    pull = ax.select("video_id", ((F.col("yl") + F.col("yr")) / 2).alias("elbow_y"), ((F.col("xl") + F.col("xr")) / 2).alias("elbow_x"), "wrist_above")
    side = measure.working_side(f, "y_raise")
    from cadenza.core.layout import spread_join
    from cadenza.operators.smoothing import interpolate

    s = spread_join(f, side.select("video_id", "n", "side", F.col("wrist_above").alias("above")), V)
    left = F.col("side") == "left"
    pick = lambda a, b: F.when(left, a).otherwise(b)
    conf = pick(g.chain_min(lm(), (LH, LS, LE)), g.chain_min(lm(), (RH, RS, RE)))
    angle = pick(g.joint_angle(lm(), LH, LS, LE), g.joint_angle(lm(), RH, RS, RE))
    rows = s.select("video_id", "n", "pose_idx", "above", F.when(conf >= 0.12, angle).alias("raw"), g.bilateral(lm(), g.SHOULDER_SIDES).alias("fallback"),
                    F.coalesce(pick(g.wrist_outward_ratio(lm(), True), g.wrist_outward_ratio(lm(), False)), F.lit(0.0)).alias("outward"),
                    F.coalesce(pick(g.vertical_outward_ratio(lm(), True), g.vertical_outward_ratio(lm(), False)), F.lit(0.0)).alias("vertical"))
    rows = interpolate(rows, V, "raw", "v", empty="fallback")
    q = quantiles(rows, ["video_id", "n"], {"top": ("v", 0.95), "low": ("v", 0.10)})
    at_top = rows.groupBy("video_id").agg(F.min(F.struct((-F.col("v")).alias("o"), "pose_idx", "outward", "vertical", "above")).alias("t"))
    shoulder = q.join(at_top, "video_id").select("video_id", "top", "low", F.col("t.above").alias("wrist_above"), F.col("t.outward").alias("outward"), F.col("t.vertical").alias("vertical"))
    return rules.infer_action(sign, pull, shoulder, V)


EXP = """ex AS (SELECT l_orderkey AS job, l_partkey AS video, ['lat_pulldown', 'row', 'deadlift', 'romanian_deadlift', 'squat'][l_partkey % 5 + 1] AS action_type, .6 + l_tax * 4 AS coverage, .4 + l_discount * 4 AS confidence, l_linenumber % 3 AS reps,
 l_quantity + 70 AS elbow_p05, l_discount - .03 AS lowest_elbow, l_quantity AS torso_range, l_quantity / 2 AS hip_range, l_quantity + 20 AS knee_range, CASE WHEN l_suppkey % 3 <> 0 THEN l_quantity END AS spine_p95 FROM lineitem)"""


def q_exp():
    lat, row, hinge = "action_type = 'lat_pulldown'", "action_type IN ('row', 'open_elbow_row')", "action_type IN ('deadlift', 'romanian_deadlift')"
    t = {"MT_LOW_POSE_COVERAGE": "coverage < .72", "MT_LOW_CONFIDENCE": "confidence < .55", "MT_LAT_NO_FULL_REP": f"{lat} AND reps = 0", "MT_LAT_RANGE_INCOMPLETE": f"{lat} AND elbow_p05 > 90", "MT_LAT_ELBOW_PATH_LIMITED": f"{lat} AND lowest_elbow < .02",
         "MT_LAT_TORSO_SWING": f"{lat} AND torso_range > 18", "MT_ROW_NO_FULL_REP": f"{row} AND reps = 0", "MT_ROW_PULL_SHORT": f"{row} AND elbow_p05 > 105", "MT_ROW_TORSO_SWING": f"{row} AND torso_range > 18", "MT_HINGE_NO_FULL_REP": f"{hinge} AND reps = 0",
         "MT_HINGE_RANGE_SMALL": f"{hinge} AND greatest(hip_range, torso_range) < 30", "MT_RDL_TOO_KNEE_DOMINANT": "action_type = 'romanian_deadlift' AND knee_range > 45", "MT_HINGE_BACK_LINE_REVIEW": f"{hinge} AND spine_p95 > 28", "MT_ACTION_UNSUPPORTED": "action_type = 'squat'"}
    return f"WITH {EXP}, x AS (" + " UNION ALL ".join(f"SELECT job, video, '{k}' AS code FROM ex WHERE {v}" for k, v in t.items()) + ") SELECT job, video, code, count(*) AS issues FROM x GROUP BY ALL"


@query("r10_experiment_rules", q_exp())
def r10(spark, d):
    c = F.col
    a = F.element_at(F.array(*[F.lit(x) for x in ("lat_pulldown", "row", "deadlift", "romanian_deadlift", "squat")]), (c("l_partkey") % 5 + 1).cast("int"))
    m = read(spark, d, "lineitem").select(
        c("l_orderkey").alias("job"), c("l_partkey").alias("video"), a.alias("action_type"), F.expr(".6 + l_tax * 4").alias("coverage"), F.expr(".4 + l_discount * 4").alias("confidence"), (c("l_linenumber") % 3).alias("reps"),
        (c("l_quantity") + 70).alias("elbow_p05"), F.expr("l_discount - .03").alias("lowest_elbow"), c("l_quantity").alias("torso_range"), (c("l_quantity") / 2).alias("hip_range"), (c("l_quantity") + 20).alias("knee_range"),
        F.when(c("l_suppkey") % 3 != 0, c("l_quantity")).alias("spine_p95"))
    return rules.experiment_rules(m, ["job", "video"]).groupBy("job", "video", "code").agg(F.count(F.lit(1)).alias("issues"))
