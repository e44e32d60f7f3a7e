"""Rule tables: measurements and repetitions to issues.

A rule is a code and a condition; every row evaluates all rules to one array of
the numbers that fired, and only those become rows with code and severity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.num import rnd
from cadenza.core.quantiles import quantiles
from cadenza.core.rangejoin import first_per
from cadenza.functions import geometry as g
from cadenza.functions.dims import ACTION_OF_FAMILY, LOWER_BODY, UPPER_BODY, family_group
from cadenza.functions.landmarks import ARM, HINGE, LA, LE, LEG, LH, LK, LS, LW, POSE_FLOOR, RA, RE, RH, RK, RS, RW, TRUNK
from cadenza.operators.activity import event_confidence
from cadenza.operators.joins import rep_keyframes

SIDE_VIEWS = ["side", "side_front", "side_rear"]
FRONT_VIEWS = ["front", "front_oblique"]


BITS = 62  # conditions per mask


def fire(rules: Sequence[tuple], df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Explode the rules that hold: ``(code, condition[, severity[, metric]])``.

    The conditions of a row become the bits of a few numbers, which generated
    code computes once per row; the rules are then read bit by bit.  The bits
    are not tested before the spread: that filter would be pushed below the
    projection and the conditions computed twice."""
    measured = any(len(rule) > 3 for rule in rules)
    masks = [F.lit(0).cast("long")] * -(-len(rules) // BITS)
    for no, rule in enumerate(rules):
        masks[no // BITS] = masks[no // BITS] + F.when(rule[1], F.lit(1 << no % BITS).cast("long")).otherwise(F.lit(0).cast("long"))
    names = [f"_mask{k}" for k in range(len(masks))]
    metrics = [F.array(*[r[3] if len(r) > 3 else F.lit(None).cast("string") for r in rules]).alias("_metrics")] if measured else []
    rows = df.select(*keys, *metrics, *[m.alias(name) for m, name in zip(masks, names)])
    out = None
    for k, name in enumerate(names):
        says = F.array(*[
            F.struct(F.lit(k * BITS + j).alias("no"), F.lit(1 << j).cast("long").alias("bit"), F.lit(r[0]).alias("code"), F.lit(r[2] if len(r) > 2 else "yellow").alias("severity"))
            for j, r in enumerate(rules[k * BITS : (k + 1) * BITS])
        ])
        spread = rows.withColumn("_r", F.explode(says)).where(F.col(name).bitwiseAND(F.col("_r.bit")) != 0)
        metric = F.element_at("_metrics", F.col("_r.no") + 1) if measured else F.lit(None).cast("string")
        one = spread.select(*keys, F.col("_r.no").alias("rule_no"), "_r.code", "_r.severity", metric.alias("metric"))
        out = one if out is None else out.unionByName(one)
    return out


def set_rules(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set-level issues from one measurement row per video.

    Rows carry the measurement columns, metric confidences ``conf_<metric>``,
    working-side columns, ``action_type``, ``family``, ``camera_angle``,
    ``capture_quality``, ``mismatch`` and ``motionRange``.
    """
    c, act, fam, cam = F.col, F.col("action_type"), F.col("family"), F.col("camera_angle")
    sees = lambda metric: F.coalesce(c(f"conf_{metric}"), F.lit(1.0)) >= POSE_FLOOR
    is_ = lambda *names: act.isin(*names)
    lean_over = lambda limit: sees("trunkLean") & (c("trunkLeanRange") > limit)
    fixed = is_("hack_squat", "hip_thrust")
    squat = (fam == "squat") & ~is_("hack_squat")
    hinge = (fam == "hinge") & ~is_("plate_loaded_rear_leg_raise", "hip_thrust", "back_extension")
    rdl = is_("romanian_deadlift", "plate_loaded_romanian_deadlift")
    press = (fam == "press") & ~is_("machine_chest_press")
    pull = (fam == "pull") & ~is_("single_arm_hammer_row", "chest_supported_row")
    rear, row, curl, y = is_("plate_loaded_rear_leg_raise"), is_("single_arm_hammer_row"), is_("preacher_curl"), is_("y_raise")
    zero = lambda name: F.coalesce(c(name), F.lit(0.0))
    or_ = lambda name, fb: F.when(zero(name) == 0, F.lit(fb)).otherwise(c(name))
    knee, hip = F.least("leftKneeAngleMin", "rightKneeAngleMin"), F.least("leftHipAngleMin", "rightHipAngleMin")
    top_elbow = F.least(or_("leftElbowAngleMin", 180.0), or_("rightElbowAngleMin", 180.0))
    ext_elbow = F.greatest(zero("leftElbowAngleMax"), zero("rightElbowAngleMax"))
    bad = c("capture_quality") == "insufficient"
    wrong = ~bad & c("mismatch")
    ok = ~bad & ~c("mismatch")
    lateral = fam.isin("squat", "hinge") & cam.isin("front", "front_oblique", "rear") & ~fixed & sees("ankleSupport")
    rules = [
        ("INSUFFICIENT_EVIDENCE", bad, "red"),
        ("ACTION_MISMATCH", wrong, "red"),
        ("Y_RAISE_CAMERA_LIMITED", y & ~cam.isin(FRONT_VIEWS)),
        ("SINGLE_ARM_PULLDOWN_CAMERA_LIMITED", is_("single_arm_pulldown") & ~cam.isin("front", "front_oblique", "side_front")),
        ("HAMMER_ROW_CAMERA_LIMITED", row & ~cam.isin("side", "side_front", "front_oblique")),
        ("PREACHER_CURL_CAMERA_LIMITED", curl & ~cam.isin("side", "side_front", "front_oblique")),
        ("SIDE_VIEW_RECOMMENDED", is_("hack_squat", "hip_thrust", "back_extension", "romanian_deadlift", "plate_loaded_rear_leg_raise") & ~cam.isin(SIDE_VIEWS)),
        ("TORSO_SWAY", lateral & (c("torsoSupportSwayRatio") > 0.32)),
        ("TEMPO_TOO_FAST", c("averageRepSeconds") < 0.9),
        ("HACK_SQUAT_DEPTH_LIMITED", is_("hack_squat") & (c("motionRange") > 10) & (or_("hipDepthMax", -1.0) < -0.035)),
        ("HACK_SQUAT_SUPPORT_SHIFT", is_("hack_squat") & lean_over(28)),
        ("SQUAT_DEPTH_LIMITED", squat & sees("kneeAngle") & (knee > 118) & (c("motionRange") > 10)),
        ("SQUAT_TRUNK_LEAN", squat & sees("trunkLean") & (c("trunkLeanMax") > 62)),
        ("FOOT_PRESSURE_UNSTABLE", squat & sees("ankleSupport") & (c("footMovementRatio") > 0.28)),
        ("KNEE_ASYMMETRY", squat & sees("kneeAngle") & cam.isin("front", "front_oblique", "rear") & (c("kneeAngleAsymmetry") > 16)),
        ("REAR_LEG_RAISE_EVIDENCE_LIMITED", rear & (zero("rear_confidence") < POSE_FLOOR)),
        ("REAR_LEG_RAISE_EXTENSION_LIMITED", rear & (zero("rear_confidence") >= POSE_FLOOR) & ((zero("rear_peak") < 145) | (zero("rear_range") < 22))),
        ("REAR_LEG_RAISE_SUPPORT_SHIFT", rear & lean_over(24)),
        ("HIP_THRUST_LOCKOUT_INCOMPLETE", is_("hip_thrust") & sees("hipAngle") & (zero("hipAngleMax") < 150)),
        ("HIP_THRUST_TORSO_SHIFT", is_("hip_thrust") & lean_over(30)),
        ("BACK_EXTENSION_RANGE_LIMITED", is_("back_extension") & (c("motionRange") < 20)),
        ("HINGE_RANGE_LIMITED", hinge & sees("hipAngle") & (hip > 130)),
        ("HINGE_KNEE_DRIFT", hinge & ~rdl & sees("kneeAngle") & (knee < 112)),
        ("HINGE_TRUNK_CONTROL", hinge & ~rdl & lean_over(28)),
        ("MACHINE_CHEST_PRESS_SUPPORT_SHIFT", is_("machine_chest_press") & lean_over(28)),
        ("WRIST_STACK", press & sees("wristStack") & (c("wristStackOffset") > 0.48)),
        ("PRESS_ASYMMETRY", press & ~(is_("bench_press") & (cam == "side")) & sees("elbowAngle") & (c("elbowAngleAsymmetry") > 18)),
        ("BENCH_SAFETY_VIEW", is_("bench_press") & ~cam.isin(SIDE_VIEWS)),
        ("HAMMER_ROW_EVIDENCE_LIMITED", row & (zero("row_confidence") < POSE_FLOOR)),
        ("HAMMER_ROW_RANGE_LIMITED", row & (zero("row_confidence") >= POSE_FLOOR) & ((zero("row_range") < 28) | (zero("row_peak") < 62))),
        ("HAMMER_ROW_TORSO_COMPENSATION", row & lean_over(24)),
        ("CHEST_SUPPORTED_ROW_SUPPORT_SHIFT", is_("chest_supported_row") & lean_over(32)),
        ("PULL_TORSO_COMPENSATION", pull & lean_over(20)),
        ("ELBOW_PATH_LOW", is_("open_elbow_row") & (c("elbowHeightMedian") > 0.13)),
        ("PREACHER_CURL_RANGE_LIMITED", curl & sees("elbowAngle") & ((zero("elbowAngleRange") < 35) | (top_elbow > 115) | (ext_elbow < 125))),
        ("PREACHER_CURL_BODY_SWING", curl & lean_over(16)),
        ("ISOLATION_ELBOW_BODY_SWING", (fam == "isolation_elbow") & ~curl & lean_over(18)),
        ("Y_RAISE_TOP_RANGE_INCOMPLETE", y & (F.when(zero("y_confidence") == 0, F.coalesce("conf_shoulderAngle", F.lit(1.0))).otherwise(c("y_confidence")) >= POSE_FLOOR)
         & (F.when(zero("y_peak") == 0, c("shoulderAngleMax")).otherwise(c("y_peak")) < 108)),
        ("ISOLATION_BODY_SWING", (fam == "isolation_shoulder") & sees("trunkLean") & ((c("trunkLeanRange") > 18) | (c("torsoSwayRatio") > 0.3))),
        ("MACHINE_CRUNCH_CAMERA_LIMITED", is_("machine_crunch") & ~cam.isin(SIDE_VIEWS)),
        ("HIP_ABDUCTION_CAMERA_LIMITED", is_("seated_hip_abduction") & cam.isin("side", "side_rear")),
        ("HIP_ABDUCTION_TORSO_SWAY", is_("standing_hip_abduction", "seated_hip_abduction") & lean_over(20)),
    ]
    gated = rules[:2] + [(code, ok & F.coalesce(cond, F.lit(False))) for code, cond in rules[2:]]
    return fire(gated, m, keys).drop("metric")


def _shot(lm: Column) -> dict[str, Column]:
    """Angles and ratios of one frame that repetition rules look at."""
    out = {"lean": g.trunk_lean(lm)}
    for x, no in (("l", 0), ("r", 1)):
        left = no == 0
        out |= {
            f"a_knee_{x}": g.joint_angle(lm, *LEG[no]), f"a_hip_{x}": g.joint_angle(lm, *HINGE[no]), f"a_elbow_{x}": g.joint_angle(lm, *ARM[no]),
            f"a_shoulder_{x}": g.joint_angle(lm, *g.SHOULDER_SIDES[no]),
            f"depth_{x}": g.at(lm, LH if left else RH, "y") - g.at(lm, LK if left else RK, "y"),
            f"outward_{x}": g.wrist_outward_ratio(lm, left), f"vertical_{x}": g.vertical_outward_ratio(lm, left),
            f"above_{x}": g.wrist_above_shoulder(lm, left), f"tilt_{x}": g.forearm_tilt(lm, left),
        }
    return out


def rep_rules(reps: DataFrame, frames: DataFrame, keys: Sequence[str], sides: DataFrame | None = None) -> DataFrame:
    """Repetition-level issues.

    ``reps``: rep_index, start/key/end_idx, amplitude, quality, ``action_type``,
    ``family``, ``camera_angle``.  ``sides``: working side per key for the
    one-sided actions (``pulldown_side``, ``row_side``, ``rear_side``,
    ``y_side``).  Below the confidence floor a repetition only yields
    LOW_CONFIDENCE_EVIDENCE with the metric that could not be judged.
    """
    keys = list(keys)
    lm = F.col("landmarks")
    pairs = {
        "knee": LEG, "hip": HINGE, "elbow": ARM, "thigh": ((LH, LK), (RH, RK)), "upper": ((LS, LE), (RS, RE)), "wrist": ((LW,), (RW,)),
        "shoulder": ((LH, LS, LE), (RH, RS, RE)), "reach": ((LH, LS, LE, LW), (RH, RS, RE, RW)),
    }
    cols, names = [], []
    for name, chains in pairs.items():
        cols += [g.chain_min(lm, chains[0]), g.chain_min(lm, chains[1]), F.least(g.chain_min(lm, chains[0]), g.chain_min(lm, chains[1]))]
        names += [f"{name}_l", f"{name}_r", f"{name}_both"]
    cols.append(g.chain_min(lm, TRUNK))
    names.append("trunk_conf")
    r = event_confidence(reps, frames, keys, cols).withColumnsRenamed({f"conf_{i}": n for i, n in enumerate(names)}).drop("best_side", "best_confidence")
    # every angle and ratio becomes a column once; the rules only compare columns
    shots = frames.select(*keys, "pose_idx", *[col.alias(n) for n, col in _shot(lm).items()], F.struct(*[lm[i].alias(f"p{i}") for i in (LE, RE)]).alias("elbows"),
                          *[g.chain_min(lm, ch).alias(f"arm_{x}") for x, ch in zip("lr", ARM)])
    shot_cols = [n for n in shots.columns if n not in (*keys, "pose_idx")]
    r = rep_keyframes(r, shots, keys, shot_cols).where(F.col("key_frame").isNotNull())
    drop = {
        x: F.when((F.col(f"start_frame.arm_{x}") >= 0.35) & (F.col(f"key_frame.arm_{x}") >= 0.35), F.col(f"key_frame.elbows.p{i}.y") - F.col(f"start_frame.elbows.p{i}.y"))
        for x, i in (("l", LE), ("r", RE))
    }
    r = r.withColumns({"drop_l": drop["l"], "drop_r": drop["r"]})
    if sides is not None:
        r = r.join(sides, keys, "left")
    c, act, fam, cam = F.col, F.col("action_type"), F.col("family"), F.col("camera_angle")
    s, k, e = "start", "key", "end"
    col = lambda m, n: F.col(f"{m}_frame.{n}")
    left_best = lambda n: c(f"{n}_l") >= c(f"{n}_r")
    best = lambda n: F.greatest(f"{n}_l", f"{n}_r")
    side_view = cam.isin(SIDE_VIEWS)
    seen = lambda n: F.when(side_view, best(n)).otherwise(c(f"{n}_both"))
    pick = lambda left, m, n: F.when(left, col(m, f"{n}_l")).otherwise(col(m, f"{n}_r"))
    # outside a side view both sides have to be measurable
    lower = lambda m, n: F.when(col(m, f"{n}_l").isNotNull(), F.least(col(m, f"{n}_l"), col(m, f"{n}_r")))
    view_angle = lambda m, n, conf: F.when(side_view, pick(left_best(conf), m, n)).otherwise(lower(m, n))
    is_ = lambda *a: act.isin(*a)
    low = lambda conf: conf < POSE_FLOOR
    side_of = lambda name: (F.coalesce(c(name), F.lit("left")) == "left") if sides is not None else F.lit(True)
    work = lambda n, left: F.when(left, c(f"{n}_l")).otherwise(c(f"{n}_r"))
    rules: list[tuple] = []

    def judge(scope: Column, conf: Column, metric: str, *found: tuple, extra_low: Column | None = None) -> None:
        weak = low(conf) | extra_low if extra_low is not None else low(conf)
        rules.append(("LOW_CONFIDENCE_EVIDENCE", scope & weak, "yellow", F.lit(metric)))
        for code, cond in found:
            rules.append((code, scope & ~weak & cond))

    hack = is_("hack_squat")
    squat = (fam == "squat") & ~hack
    depth = pick(left_best("thigh"), k, "depth")
    judge((fam == "squat") & hack, best("thigh"), "hipKneeDepth", ("HACK_SQUAT_DEPTH_LIMITED", depth < -0.075))
    judge(squat, seen("knee"), "kneeAngle", ("SQUAT_DEPTH_LIMITED", view_angle(k, "a_knee", "knee") > 118),
          ("SQUAT_TRUNK_LEAN", (c("trunk_conf") >= POSE_FLOOR) & (col(k, "lean") > 62)))
    rear, left = (fam == "hinge") & is_("plate_loaded_rear_leg_raise"), side_of("rear_side")
    hips = [pick(left, m, "a_hip") for m in (s, k, e)]
    judge(rear, work("hip", left), "hipAngle", ("REAR_LEG_RAISE_EXTENSION_LIMITED", (hips[1] < 142) | (hips[1] - F.least(*hips) < 18)))
    back = (fam == "hinge") & is_("back_extension")
    va = [view_angle(m, "a_hip", "hip") for m in (s, k, e)]
    span = F.coalesce(F.greatest(va[0], va[2]) - va[1], F.lit(0.0))
    judge(back, seen("hip"), "hipAngle", ("BACK_EXTENSION_RANGE_LIMITED", va[1].isNotNull() & ((va[1] > 130) | (span < 22))), ("BACK_EXTENSION_TOP_SHORT", va[2] < 145))
    hinge = (fam == "hinge") & ~is_("plate_loaded_rear_leg_raise", "back_extension")
    thrust, rdl = is_("hip_thrust"), is_("romanian_deadlift", "plate_loaded_romanian_deadlift")
    judge(hinge, seen("hip"), "hipAngle", ("HIP_THRUST_LOCKOUT_INCOMPLETE", thrust & (va[1] < 150)), ("HINGE_RANGE_LIMITED", ~thrust & (va[1] > 130)),
          ("RDL_EXCESSIVE_KNEE_BEND", rdl & (seen("knee") >= POSE_FLOOR) & (view_angle(k, "a_knee", "knee") < 105) & (va[1] > 115)))
    press = fam == "press"
    chest, shoulder = is_("machine_chest_press"), is_("shoulder_press")
    front = chest & cam.isin(FRONT_VIEWS)
    rules.append(("MACHINE_CHEST_PRESS_RANGE_LIMITED", press & front & (c("amplitude") < 10.0)))
    up = left_best("upper")
    wrist = F.when(up, c("wrist_l")).otherwise(c("wrist_r"))
    el = [pick(up, m, "a_elbow") for m in (s, k, e)]
    short = lambda bottom, top: el[1].isNotNull() & el[0].isNotNull() & el[2].isNotNull() & ((el[1] > bottom) | (F.greatest(el[0], el[2]) < top))
    judge(press & (chest | shoulder) & ~front, best("upper"), "visibleElbowAngle", ("MACHINE_CHEST_PRESS_RANGE_LIMITED", chest & short(112.0, 142.0)),
          ("SHOULDER_PRESS_RANGE_LIMITED", shoulder & short(115.0, 145.0)), extra_low=wrist < 0.08)
    bench = is_("bench_press")
    both = press & ~chest & ~shoulder & ~(bench & (cam == "side"))
    at_key = F.least(col(k, "arm_l"), col(k, "arm_r"))
    full_view = ~bench | cam.isin(FRONT_VIEWS)
    tilt = F.abs(col(k, "a_elbow_l") - col(k, "a_elbow_r"))
    judge(both, c("elbow_both"), "elbowAngle", ("PRESS_ASYMMETRY", full_view & (tilt > 18)), extra_low=full_view & (at_key < POSE_FLOOR))
    pull = fam == "pull"
    held = {"chest_supported_row": ("CHEST_SUPPORTED_ROW_RANGE_LIMITED", 115.0), "t_bar_row": ("T_BAR_ROW_RANGE_LIMITED", 115.0),
            "plate_loaded_pulldown": ("PLATE_LOADED_PULLDOWN_RANGE_LIMITED", 110.0)}
    pe = [pick(left_best("elbow"), m, "a_elbow") for m in (s, k)]
    judge(pull & is_(*held), best("elbow"), "visibleElbowAngle", *[(code, is_(name) & ((pe[0] < 132.0) | (pe[1] > limit)) & pe[0].isNotNull() & pe[1].isNotNull()) for name, (code, limit) in held.items()])
    left = side_of("row_side")
    we = [pick(left, m, "a_elbow") for m in (s, k)]
    both_known = lambda pair: pair[0].isNotNull() & pair[1].isNotNull()
    judge(pull & is_("single_arm_hammer_row"), work("elbow", left), "elbowAngle", ("HAMMER_ROW_RANGE_INCOMPLETE", both_known(we) & ((we[0] < 135) | (we[1] > 110))))
    left = side_of("pulldown_side")
    we = [pick(left, m, "a_elbow") for m in (s, k)]
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    judge(pull & is_("single_arm_pulldown"), work("elbow", left), "elbowAngle",
          ("SINGLE_ARM_PULLDOWN_RANGE_INCOMPLETE", both_known(we) & ((we[0] < 135) | (we[1] > 110))),
          ("SINGLE_ARM_PULLDOWN_ELBOW_PATH_LIMITED", zero(work("drop", left)) < 0.03),
          ("SINGLE_ARM_PULLDOWN_FOREARM_DRIFT", cam.isin(FRONT_VIEWS) & (zero(pick(left, k, "tilt")) > 2.8)))
    lat = [g.both_sides(col(m, "a_elbow_l"), col(m, "a_elbow_r")) for m in (s, k)]
    judge(pull & is_("lat_pulldown"), c("elbow_both"), "elbowAngle", ("LAT_PULLDOWN_RANGE_INCOMPLETE", (lat[0] < 135) | (lat[1] > 90)),
          ("LAT_PULLDOWN_ELBOW_PATH_LIMITED", g.of_sides(c("drop_l"), c("drop_r")) < 0.035),
          ("LAT_PULLDOWN_FOREARM_DRIFT", g.of_sides(col(k, "tilt_l"), col(k, "tilt_r")) > 1.35))
    ce = [pick(left_best("elbow"), m, "a_elbow") for m in (s, k, e)]
    ext = F.greatest(ce[0], ce[2])
    judge((fam == "isolation_elbow") & is_("preacher_curl"), best("elbow"), "elbowAngle",
          ("PREACHER_CURL_RANGE_INCOMPLETE", ce[1].isNotNull() & ((ce[1] > 115) | (zero(ext - ce[1]) < 28) | (F.coalesce(ext, F.lit(180.0)) < 128))))
    left = side_of("y_side")
    start_y, top_y = pick(left, s, "a_shoulder"), pick(left, k, "a_shoulder")
    out, vert = zero(pick(left, k, "outward")), zero(pick(left, k, "vertical"))
    above = zero(pick(left, k, "above"))
    path = cam.isin("front", "front_oblique", "rear")
    judge((fam == "isolation_shoulder") & is_("y_raise"), work("shoulder", left), "shoulderAngle", ("Y_RAISE_START_TOO_HIGH", start_y > 70),
          ("Y_RAISE_TOP_RANGE_INCOMPLETE", top_y.isNotNull() & ((top_y < 110) | (above < 0.045))), ("Y_RAISE_PATH_TOO_NARROW", path & (out < 0.35)),
          ("Y_RAISE_PATH_TOO_FLAT", path & (out >= 0.35) & (vert < 1.0)),
          ("Y_RAISE_ELBOW_BEND", (work("reach", left) >= POSE_FLOOR) & (pick(left, k, "a_elbow") < 135)))
    judge((fam == "core_flexion") & is_("machine_crunch"), c("trunk_conf"), "trunkFlexion", ("MACHINE_CRUNCH_RANGE_LIMITED", c("amplitude") < 12.0))
    seated = is_("seated_hip_abduction")
    judge((fam == "isolation_hip") & is_("standing_hip_abduction", "seated_hip_abduction"), best("knee"), "hipAbductionPath",
          ("HIP_ABDUCTION_RANGE_LIMITED", ~(seated & cam.isin("side", "side_rear")) & (c("amplitude") < F.when(seated, 12.0).otherwise(10.0))))
    fired = fire([(x[0], F.coalesce(x[1], F.lit(False)), *x[2:]) for x in rules], r, [*keys, "rep_index"])
    return first_per(fired, [*keys, "rep_index", "code"], [F.col("rule_no")])


def movement_match(signature: DataFrame, expected_family: Column, keys: Sequence[str]) -> DataFrame:
    """Does the movement belong to another body group than the chosen action?"""
    expected = family_group(expected_family)
    lower = expected == "lower_body"
    own, other = F.when(lower, c_("lower_range")).otherwise(c_("upper_range")), F.when(lower, c_("upper_range")).otherwise(c_("lower_range"))
    ratio = other / F.greatest(F.lit(1.0), own)
    wrong = (F.col("body_group") != expected) & (other >= 14.0) & ((own < 8.0) | (ratio >= 1.6))
    hinge_like = (expected_family == "hinge") & (F.col("lower_range") >= 20.0) & (F.col("hinge_reps") >= 1)
    mismatch = (expected != "general") & wrong & ~hinge_like
    conf = F.least(F.lit(0.98), F.greatest(F.lit(0.0), (ratio - 1.0) / 1.8))
    return signature.select(*keys, expected.alias("expected_group"), F.when(expected == "general", expected).otherwise(F.col("body_group")).alias("detected_group"),
                            mismatch.alias("mismatch"), F.when(mismatch, rnd(conf, 3)).otherwise(0.0).alias("confidence"), rnd(ratio, 2).alias("dominance_ratio"))


def c_(name: str) -> Column:
    return F.col(name)


def infer_action(signature: DataFrame, pull: DataFrame, shoulder: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Action type from the detected family and the pull / shoulder features.

    ``pull``: elbow_y, elbow_x, wrist_above.  ``shoulder``: top, low, wrist_above,
    outward, vertical of the working side at its top frame.
    """
    keys = list(keys)
    p = pull.select(*keys, *[F.col(x).alias(f"p_{x}") for x in ("elbow_y", "elbow_x", "wrist_above")])
    s = shoulder.select(*keys, *[F.col(x).alias(f"s_{x}") for x in ("top", "low", "wrist_above", "outward", "vertical")])
    d = signature.join(p, keys, "left").join(s, keys, "left")
    c = F.col
    vertical = (c("p_elbow_y") >= 0.14) & (c("p_elbow_y") >= c("p_elbow_x") * 1.25) & (c("p_wrist_above") > -0.08)
    lat = (c("p_wrist_above") >= 0.055) | vertical
    shape = (c("s_outward") >= 0.35) & (c("s_vertical") >= 1.0)
    y = ((c("s_top") >= 108.0) & (c("s_wrist_above") >= 0.035) & shape) | ((c("s_top") - c("s_low") >= 48.0) & (c("s_wrist_above") >= 0.015) & shape)
    default = F.lit("other")
    for family, action in ACTION_OF_FAMILY.items():
        default = F.when(c("family") == family, action).otherwise(default)
    upper = c("family").isin(UPPER_BODY)
    action = (
        F.when(c("family") == "isolation_shoulder", F.when(y, "y_raise").when(lat, "lat_pulldown").otherwise("lateral_raise"))
        .when(upper & (lat | (c("family") == "pull") | (c("p_elbow_x") >= 0.035)), F.when(lat, "lat_pulldown").otherwise("row"))
        .otherwise(default)
    )
    return d.select(*keys, "family", "confidence", action.alias("action_type"))


def experiment_rules(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rules of the second engine's experiment.

    Columns: action_type, coverage, confidence, reps, elbow_p05, lowest_elbow,
    torso_range, hip_range, knee_range, spine_p95 (NULL when not measured).
    """
    c = F.col
    is_ = lambda *a: c("action_type").isin(*a)
    lat, row, hinge = is_("lat_pulldown"), is_("row", "open_elbow_row"), is_("deadlift", "romanian_deadlift")
    z = lambda n: F.coalesce(c(n), F.lit(0.0))
    none = c("reps") == 0
    rules = [
        ("MT_LOW_POSE_COVERAGE", c("coverage") < 0.72), ("MT_LOW_CONFIDENCE", c("confidence") < 0.55),
        ("MT_LAT_NO_FULL_REP", lat & none), ("MT_LAT_RANGE_INCOMPLETE", lat & (c("elbow_p05") > 90)),
        ("MT_LAT_ELBOW_PATH_LIMITED", lat & (c("lowest_elbow") < 0.02)), ("MT_LAT_TORSO_SWING", lat & (z("torso_range") > 18)),
        ("MT_ROW_NO_FULL_REP", row & none), ("MT_ROW_PULL_SHORT", row & (c("elbow_p05") > 105)), ("MT_ROW_TORSO_SWING", row & (z("torso_range") > 18)),
        ("MT_HINGE_NO_FULL_REP", hinge & none), ("MT_HINGE_RANGE_SMALL", hinge & (F.greatest(z("hip_range"), z("torso_range")) < 30)),
        ("MT_RDL_TOO_KNEE_DOMINANT", is_("romanian_deadlift") & (z("knee_range") > 45)), ("MT_HINGE_BACK_LINE_REVIEW", hinge & (c("spine_p95") > 28)),
        ("MT_ACTION_UNSUPPORTED", ~lat & ~row & ~hinge),
    ]
    return fire([(code, F.coalesce(cond, F.lit(False))) for code, cond in rules], m, keys).drop("metric")
