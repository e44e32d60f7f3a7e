"""Queries of the per-frame geometry and the keypoint repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import geometry as g
from cadenza.functions.dims import ACTION_NAMES, ACTIONS
from cadenza.functions.landmarks import (
    ARM, HINGE, JOINTS, LA, LE, LEG, LH, LK, LS, LW, METRIC_CHAINS, RA, RE, RH, RK, RS, RW, TRUNK,
)
from cadenza.operators import repair
from cadenza.plans.q_series import r6
from cadenza.plans.registry import query
from cadenza.plans.views import (
    Q_LEAN, Q_TORSO, SLOT_POINT, TRUNK_DX, TRUNK_DY, frames, frames_sql, q_angle, q_best, q_bilateral, q_both, q_dist, q_mean, q_min,
)

FR = "WITH " + frames_sql()
ID = ["video_id", "pose_idx"]
lm = lambda: F.col("landmarks")
USED = sorted(SLOT_POINT)
FAMILY_LIST = [f for f, _ in ACTIONS.values()]


def action_of(col):
    return F.element_at(F.array(*[F.lit(a) for a in ACTION_NAMES]), (col % 37 + 1).cast("int"))


def family_of(col):
    return F.element_at(F.array(*[F.lit(f) for f in FAMILY_LIST]), (col % 37 + 1).cast("int"))


def q_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


Q_ACTION = f"{q_list(ACTION_NAMES)}[vec_id % 37 + 1]"
Q_FAMILY = f"{q_list(FAMILY_LIST)}[vec_id % 37 + 1]"


def select6(spark, d, cols):
    return frames(spark, d).select(*ID, *[r6(c, name) for name, c in cols.items()])


def q_select6(cols) -> str:
    return FR + f" SELECT video_id, pose_idx, {', '.join(f'round({e}, 6) AS {n}' for n, e in cols.items())} FROM fr"


@query("p1_chain_confidence", q_select6({
    "arm_left": q_min(ARM[0]), "arm_right": q_min(ARM[1]), "leg_left": q_min(LEG[0]), "trunk": q_mean(TRUNK), "best_leg": q_best(LEG)}))
def p1(spark, d):
    return select6(spark, d, {
        "arm_left": g.chain_min(lm(), ARM[0]), "arm_right": g.chain_min(lm(), ARM[1]), "leg_left": g.chain_min(lm(), LEG[0]),
        "trunk": g.chain_mean(lm(), TRUNK), "best_leg": g.best_side(lm(), LEG)})


def q_metric(m):
    parts = [q_min(c) for c in METRIC_CHAINS[m]]
    return parts[0] if len(parts) == 1 else f"least({', '.join(parts)})"


@query("p2_metric_confidence", q_select6({m: q_metric(m) for m in METRIC_CHAINS} | {"knee_left": q_min(LEG[0]), "knee_right": q_min(LEG[1])}))
def p2(spark, d):
    cols = {m: g.metric_conf(lm(), m) for m in METRIC_CHAINS}
    sides = g.side_confs(lm(), "kneeAngle")
    return select6(spark, d, cols | {"knee_left": sides[0], "knee_right": sides[1]})


def q_quality() -> str:
    trunk, both = q_mean(TRUNK), lambda w, x, s, c: f"{w} * {s} + {x} * {c}"
    case = [f"WHEN {Q_ACTION} = 'machine_crunch' THEN {trunk}",
            f"WHEN {Q_ACTION} = 'preacher_curl' THEN {both(.18, .82, q_best(((LS, LE), (RS, RE))), q_best(ARM))}"]
    for a, (w, x, s, c) in g.ACTION_QUALITY.items():
        case.append(f"WHEN {Q_ACTION} = '{a}' THEN {both(w, x, q_mean(s), q_best(c))}")
    for f, (w, x, c) in g.FAMILY_QUALITY.items():
        case.append(f"WHEN {Q_FAMILY} = '{f}' THEN {both(w, x, trunk, q_best(c))}")
    return f"CASE {' '.join(case)} ELSE {trunk} END"


@query("p3_frame_quality", FR + f" SELECT video_id, pose_idx, {Q_ACTION} AS action_type, round({q_quality()}, 6) AS quality FROM fr")
def p3(spark, d):
    a, f = action_of(F.col("vec_id")), family_of(F.col("vec_id"))
    return frames(spark, d).select(*ID, a.alias("action_type"), r6(g.frame_quality(lm(), f, a), "quality"))


@query("p4_remap_keypoints", """WITH e AS (SELECT vec_id, embedding AS e FROM embeddings)
 SELECT vec_id, round((320 + 320 * e[5]::DOUBLE) / 640, 6) AS nose_x, round((240 + 240 * e[7 * 2 + 2]::DOUBLE) / 480, 6) AS le_y,
 round(abs(e[40 + 16 - 1]::DOUBLE), 6) AS ra_vis, 0.5::DOUBLE AS eye_x, 2::BIGINT AS instances FROM e""")
def p4(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = lambda i: F.col("embedding")[i].cast("double")
    pts = F.array(*[F.array(F.lit(320.0) + 320.0 * v(4 if k == 0 else (2 * k + 1) % 34), F.lit(240.0) + 240.0 * v(2 * k + 1 if k else 5)) for k in range(17)])
    scores = F.array(*[F.abs(v(38 + k)) for k in range(17)])
    many = repair.lift_instances(F.array(pts, pts, pts), F.array(scores, scores))
    out = e.select("vec_id", many.alias("inst"))
    one = repair.remap_keypoints(F.col("inst")[0]["points"], F.col("inst")[0]["scores"], F.lit(640.0), F.lit(480.0))
    return out.withColumn("lm", one).select(
        "vec_id", r6(F.col("lm")[0]["x"], "nose_x"), r6(F.col("lm")[LE]["y"], "le_y"), r6(F.col("lm")[RA]["vis"], "ra_vis"),
        r6(F.col("lm")[2]["x"], "eye_x"), F.size("inst").cast("long").alias("instances"))


BOX = (LS, RS, LH, RH)


def q_box(idx):
    pick = lambda ax: f"[{', '.join(f'CASE WHEN v{i} >= .05 THEN {ax}{i} END' for i in idx)}]"
    cl = lambda e, dflt: f"coalesce(greatest(0::DOUBLE, least(1::DOUBLE, {e})), {dflt})"
    return {"x1": cl(f"list_min({pick('x')})", 0), "y1": cl(f"list_min({pick('y')})", 0),
            "x2": cl(f"list_max({pick('x')})", 1), "y2": cl(f"list_max({pick('y')})", 1)}


@query("p5_bbox_iou", FR + f""", b AS (SELECT video_id, pose_idx, {', '.join(f'{e} AS {n}' for n, e in q_box(BOX).items())} FROM fr),
 i AS (SELECT *, greatest(0, least(x2, .7) - greatest(x1, .3)) * greatest(0, least(y2, .8) - greatest(y1, .2)) AS inter, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area FROM b)
 SELECT video_id, pose_idx, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(area, 6) AS area,
 round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(inter / (area + .24 - inter), 6) AS iou,
 round(CASE WHEN (x1 + x2) / 2 BETWEEN .3 AND .7 AND (y1 + y2) / 2 BETWEEN .2 AND .8 THEN .35 ELSE -.25 END + .25 * (inter / (area + .24 - inter)), 6) AS bonus FROM i""")
def p5(spark, d):
    roi = F.struct(F.lit(0.3).alias("x1"), F.lit(0.2).alias("y1"), F.lit(0.7).alias("x2"), F.lit(0.8).alias("y2"))
    b = frames(spark, d).select(*ID, g.bbox(lm(), BOX).alias("b"), roi.alias("roi"))
    cx, cy = g.box_center(F.col("b"))
    return b.select(*ID, *[r6(F.col(f"b.{k}"), k) for k in ("x1", "y1", "x2", "y2")], r6(g.box_area(F.col("b")), "area"), r6(cx, "cx"), r6(cy, "cy"),
                    r6(g.box_iou(F.col("b"), F.col("roi")), "iou"), r6(g.roi_bonus(F.col("b"), F.col("roi")), "bonus"))


@query("p6_normalize_roi", """WITH r AS (SELECT vec_id, embedding[1]::DOUBLE * 4 AS x, embedding[2]::DOUBLE * 4 AS y, embedding[3]::DOUBLE * 8 AS w, embedding[4]::DOUBLE * 8 AS h FROM embeddings),
 c AS (SELECT *, greatest(0, least(1, x)) AS x1, greatest(0, least(1, y)) AS y1, greatest(0, least(1, x + w)) AS x2, greatest(0, least(1, y + h)) AS y2 FROM r),
 k AS (SELECT *, w > 0 AND h > 0 AND greatest(abs(x), abs(y), abs(w), abs(h)) <= 1.5 AND x2 > x1 AND y2 > y1 AS ok FROM c)
 SELECT vec_id, CASE WHEN ok THEN round(x1, 6) END AS x1, CASE WHEN ok THEN round(y1, 6) END AS y1, CASE WHEN ok THEN round(x2, 6) END AS x2, CASE WHEN ok THEN round(y2, 6) END AS y2 FROM k""")
def p6(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = lambda i, k: F.col("embedding")[i].cast("double") * float(k)
    b = e.select("vec_id", g.normalize_roi(v(0, 4), v(1, 4), v(2, 8), v(3, 8)).alias("b"))
    return b.select("vec_id", *[r6(F.col(f"b.{k}"), k) for k in ("x1", "y1", "x2", "y2")])


def q_outlier(c, lim):
    a, b = q_dist(c[0], c[1]), q_dist(c[1], c[2])
    return f"({q_min(c)} >= .35 AND ({a} < .015 OR {b} < .015 OR {b} / greatest(1e-6, {a}) < {lim[0]} OR {b} / greatest(1e-6, {a}) > {lim[1]}))"


Q_LEGS, Q_ARMS = f"{Q_FAMILY} IN ('squat', 'hinge', 'isolation_knee')", f"{Q_FAMILY} IN ('press', 'pull', 'isolation_shoulder', 'isolation_elbow')"
_OUT = {LA: (Q_LEGS, (LH, LK, LA), repair.LEG_RATIO), RA: (Q_LEGS, (RH, RK, RA), repair.LEG_RATIO),
        LW: (Q_ARMS, (LS, LE, LW), repair.ARM_RATIO), RW: (Q_ARMS, (RS, RE, RW), repair.ARM_RATIO)}


@query("p7_downweight_outliers", FR + f""", o AS (SELECT *, {', '.join(f'{c} AND {q_outlier(ch, li)} AS o{s}' for s, (c, ch, li) in _OUT.items())} FROM fr)
 SELECT video_id, pose_idx, o{LA}::BIGINT + o{RA}::BIGINT + o{LW}::BIGINT + o{RW}::BIGINT AS changed,
 {', '.join(f'round(CASE WHEN o{s} THEN least(v{s}, .18) ELSE v{s} END, 6) AS vis_{s}' for s in _OUT)} FROM o""")
def p7(spark, d):
    f = repair.downweight_outliers(frames(spark, d), family_of(F.col("vec_id")), action_of(F.col("vec_id")))
    return f.select(*ID, "changed", *[r6(lm()[s]["vis"], f"vis_{s}") for s in _OUT])


@query("p8_mask_gate", FR + f""", s AS (SELECT *, abs(x{LK} - .5) AS s1, abs(y{LK}) AS s2 FROM fr)
 SELECT video_id, pose_idx, round(CASE WHEN least(s1, s2) < .35 THEN least(v{LK}, greatest(.02, least(s1, s2) * .25)) ELSE v{LK} END, 6) AS seg_vis,
 round(CASE WHEN least(s1, s2) < .55 THEN least(v{LK}, greatest(.01, least(s1, s2) * .18)) ELSE v{LK} END, 6) AS person_vis, round(v{LS}, 6) AS shoulder_vis FROM s""")
def p8(spark, d):
    f = frames(spark, d)
    s1 = F.transform(lm(), lambda p: F.abs(p["x"] - 0.5))
    s2 = F.transform(lm(), lambda p: F.abs(p["y"]))
    f = f.withColumn("s", repair.combine_mask_scores(s1, s2))
    seg, person = repair.mask_gate(lm(), F.col("s"), "segmentation"), repair.mask_gate(lm(), F.col("s"), "person")
    return f.select(*ID, r6(seg[LK]["vis"], "seg_vis"), r6(person[LK]["vis"], "person_vis"), r6(seg[LS]["vis"], "shoulder_vis"))


@query("p9_compensate", FR + f""" SELECT video_id, pose_idx, round(CASE WHEN vec_id % 4 <> 0 THEN x{LS} + z{LK} / 100 ELSE x{LS} END, 6) AS x,
 round(CASE WHEN vec_id % 4 <> 0 THEN y{LS} - z{LK} / 50 ELSE y{LS} END, 6) AS y FROM fr""")
def p9(spark, d):
    f = frames(spark, d).withColumn("s", lm()[LK]["z"])
    one, zero, w, h = F.lit(1.0), F.lit(0.0), F.lit(640.0), F.lit(480.0)
    m = F.array(one, zero, F.col("s") / 100.0 * w, zero, one, -F.col("s") / 50.0 * h)
    moved = repair.compensate(lm(), F.col("vec_id") % 4 != 0, m, w, h)
    return f.withColumn("m", moved).select(*ID, r6(F.col("m")[LS]["x"], "x"), r6(F.col("m")[LS]["y"], "y"))


@query("p10_display_frames", FR + f""", k AS (SELECT *, {Q_ACTION} AS act, {Q_FAMILY} AS fam FROM fr)
 SELECT video_id, pose_idx, round(least(v0, 0), 6) AS nose_vis, round(CASE WHEN act IN ('hack_squat', 'hip_thrust') THEN least(v{LW}, 0) ELSE v{LW} END, 6) AS wrist_vis,
 round(CASE WHEN act = 'hip_thrust' THEN least(v{LK}, 0) ELSE v{LK} END, 6) AS knee_vis,
 round(CASE WHEN act IN ('hack_squat', 'hip_thrust') THEN .4 ELSE x{LA} END, 6) AS left_ankle_x,
 round(CASE WHEN act IN ('hack_squat', 'hip_thrust') THEN least(v{RA}, .05) ELSE v{RA} END, 6) AS right_ankle_vis,
 round(CASE WHEN act IN ('hack_squat', 'hip_thrust') THEN x{RA} ELSE .5 END, 6) AS right_heel_x FROM k""")
def p10(spark, d):
    f = frames(spark, d).withColumn("a", action_of(F.col("vec_id"))).withColumn("f", family_of(F.col("vec_id")))
    anchor = F.struct(F.lit(0.4).alias("x"), F.lit(0.9).alias("y"), F.lit(0.8).alias("conf"))
    missing = F.lit(None).cast("struct<x:double,y:double,conf:double>")
    shown = repair.suppress(lm(), repair.suppressed_slots(F.col("f"), F.col("a")))
    locked = repair.lock_feet(lm(), F.col("a"), anchor, missing)
    f = f.withColumn("s", shown).withColumn("l", locked)
    return f.select(*ID, r6(F.col("s")[0]["vis"], "nose_vis"), r6(F.col("s")[LW]["vis"], "wrist_vis"), r6(F.col("s")[LK]["vis"], "knee_vis"),
                    r6(F.col("l")[LA]["x"], "left_ankle_x"), r6(F.col("l")[RA]["vis"], "right_ankle_vis"), r6(F.col("l")[30]["x"], "right_heel_x"))


@query("x1_joint_angles", q_select6({f"{j}": f"CASE WHEN {q_min(c)} >= .2 THEN {q_angle(*c)} END" for j, c in JOINTS.items()} | {"knee_mean": q_bilateral(LEG)}))
def x1(spark, d):
    return select6(spark, d, {j: g.tracked_joint(lm(), j) for j in JOINTS} | {"knee_mean": g.bilateral(lm(), LEG)})


@query("x2_trunk_geometry", q_select6({
    "lean": Q_LEAN, "line": f"abs(degrees(atan2({TRUNK_DY}, {TRUNK_DX})))", "signed": f"degrees(atan2({TRUNK_DX}, greatest(1e-6::DOUBLE, -{TRUNK_DY})))",
    "horizontal": f"greatest(0, least(1, (abs({TRUNK_DX}) - .65 * abs({TRUNK_DY})) / .32))", "knee_score": f"greatest(0, least(1, (170 - {q_bilateral(LEG)}) / 70))",
    "wrapped": f"(degrees(atan2({TRUNK_DY}, {TRUNK_DX})) * 3 - 100 + 180) - 360 * floor((degrees(atan2({TRUNK_DY}, {TRUNK_DX})) * 3 - 100 + 180) / 360) - 180"}))
def x2(spark, d):
    dx, dy = g.trunk_vector(lm())
    raw = F.degrees(F.atan2(dy, dx)) * 3
    return select6(spark, d, {
        "lean": g.trunk_lean(lm()), "line": g.shoulder_hip_line(lm()), "signed": g.signed_trunk_angle(lm()), "horizontal": g.torso_horizontal(lm()),
        "knee_score": g.knee_flexion_score(lm()), "wrapped": g.wrapped_delta(raw, F.lit(100.0))})


def q_signals():
    knee, elbow = f"(180 - {q_bilateral(LEG)})", f"(180 - {q_bilateral(ARM)})"
    reach = f"""((sqrt(pow((x{LW}+x{RW})/2 - (x{LS}+x{RS})/2, 2) + pow((y{LW}+y{RW})/2 - (y{LS}+y{RS})/2, 2)) + sqrt({TRUNK_DX}*{TRUNK_DX} + {TRUNK_DY}*{TRUNK_DY})) * 100)"""
    s = {"squat": knee, "isolation_knee": knee, "hinge": f"(180 - {q_bilateral(HINGE)})", "press": elbow, "pull": elbow, "isolation_elbow": elbow,
         "isolation_shoulder": q_bilateral(((LH, LS, LE), (RH, RS, RE))), "isolation_hip": f"(abs(x{LK} - x{RK}) / {Q_TORSO} * 100)", "core_flexion": Q_LEAN}
    return s, reach


def q_family_signal() -> str:
    s, reach = q_signals()
    return f"CASE {' '.join(f'WHEN {Q_FAMILY} = {chr(39)}{f}{chr(39)} THEN {e}' for f, e in s.items())} ELSE {reach} END"


@query("x3_family_signals", FR + f" SELECT video_id, pose_idx, {Q_FAMILY} AS family, round({q_family_signal()}, 6) AS signal FROM fr")
def x3(spark, d):
    f = family_of(F.col("vec_id"))
    return frames(spark, d).select(*ID, f.alias("family"), r6(g.family_signal(lm(), f), "signal"))


def q_limbs():
    sh = lambda e, ids, f=.35: f"(CASE WHEN {q_min(ids)} >= {f} THEN {e} END)"
    out = {}
    for label, (s, e, w) in {"left": (LS, LE, LW), "right": (RS, RE, RW)}.items():
        out[f"above_{label}"] = sh(f"y{s} - y{w}", (s, w))
        out[f"outward_{label}"] = sh(f"abs(x{w} - x{s}) / greatest(.03, {q_dist(LS, RS)})", (s, w))
        out[f"vertical_{label}"] = sh(f"CASE WHEN y{s} - y{w} > 0 THEN (y{s} - y{w}) / greatest(.03, abs(x{w} - x{s})) ELSE 0 END", (s, w))
        out[f"tilt_{label}"] = sh(f"abs(x{w} - x{e}) / greatest(.015, abs(y{w} - y{e}))", (e, w))
        out[f"drop_{label}"] = sh(f"y{e} - y{s}", (s, e), .45)
    out["tilt"] = f"coalesce(({out['tilt_left']} + {out['tilt_right']}) / 2, {out['tilt_left']}, {out['tilt_right']}, 0)"
    return out


@query("x4_limb_ratios", q_select6(q_limbs()))
def x4(spark, d):
    out = {}
    for label, left in (("left", True), ("right", False)):
        out |= {f"above_{label}": g.wrist_above_shoulder(lm(), left), f"outward_{label}": g.wrist_outward_ratio(lm(), left),
                f"vertical_{label}": g.vertical_outward_ratio(lm(), left), f"tilt_{label}": g.forearm_tilt(lm(), left), f"drop_{label}": g.elbow_drop(lm(), left)}
    return select6(spark, d, out | {"tilt": g.of_sides(g.forearm_tilt(lm(), True), g.forearm_tilt(lm(), False))})


CHECKED = [LE, RW, LK]


def q_repair(s):
    w = "PARTITION BY video_id ORDER BY pose_idx"
    good = lambda e: f"CASE WHEN v{s} >= .55 THEN {e} END"
    a = lambda e: f"last_value({good(e)} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    b = lambda e: f"first_value({good(e)} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    r = f"(pose_idx - {a('pose_idx')})::DOUBLE / ({b('pose_idx')} - {a('pose_idx')})"
    cond = f"v{s} < .55 AND pose_idx > 0 AND pose_idx < n - 1 AND {a('pose_idx')} IS NOT NULL AND {b('pose_idx')} IS NOT NULL"
    return ", ".join(f"round(CASE WHEN {cond} THEN {a(f'{ax}{s}')} + ({b(f'{ax}{s}')} - {a(f'{ax}{s}')}) * {r} ELSE {ax}{s} END, 6) AS {ax}_{s}" for ax in "xy")


@query("w5_repair_landmarks", FR + f" SELECT video_id, pose_idx, {', '.join(q_repair(s) for s in CHECKED)} FROM fr")
def w5(spark, d):
    f = repair.repair_landmarks(frames(spark, d), ["video_id"], USED)
    return f.select(*ID, *[r6(lm()[s][ax], f"{ax}_{s}") for s in CHECKED for ax in "xy"])


def q_gap(s):
    w = "PARTITION BY video_id ORDER BY pose_idx"
    good = lambda e: f"CASE WHEN v{s} >= .55 THEN {e} END"
    a = lambda e: f"last_value({good(e)} IGNORE NULLS) OVER ({w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    b = lambda e: f"first_value({good(e)} IGNORE NULLS) OVER ({w} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
    cond = f"v{s} < .55 AND {b('pose_idx')} - {a('pose_idx')} - 1 <= 3"
    r = f"(pose_idx - {a('pose_idx')})::DOUBLE / ({b('pose_idx')} - {a('pose_idx')})"
    return (f"round(CASE WHEN {cond} THEN {a(f'x{s}')} + ({b(f'x{s}')} - {a(f'x{s}')}) * {r} ELSE x{s} END, 6) AS x_{s}, "
            f"round(CASE WHEN {cond} THEN least(.58, {a(f'v{s}')}, {b(f'v{s}')}) ELSE v{s} END, 6) AS vis_{s}")


@query("w6_recover_gaps", FR + f" SELECT video_id, pose_idx, {', '.join(q_gap(s) for s in CHECKED)} FROM fr")
def w6(spark, d):
    f = repair.recover_gaps(frames(spark, d), ["video_id"], USED)
    return f.select(*ID, *[c for s in CHECKED for c in (r6(lm()[s]["x"], f"x_{s}"), r6(lm()[s]["vis"], f"vis_{s}"))])
