"""Motion signal and source label of every action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.layout import spread_join
from cadenza.core.quantiles import quantiles
from cadenza.core.session import settings, stored
from cadenza.functions import geometry as g
from cadenza.functions.landmarks import HINGE, LA, LE, LH, LK, LS, LW, RA, RE, RH, RK, RS, RW
from cadenza.operators.measure import working_sides
from cadenza.operators.smoothing import fill_with_mean, interpolate

ARMS = ((LS, LE, LW), (RS, RE, RW))
RAISES = ((LH, LS, LE), (RH, RS, RE))
SLOTS = (LS, RS, LE, RE, LW, RW, LH, RH, LK, RK, LA, RA)

# Views in which the visible arm's height is the press signal, and frontal views.
PRESS_VIEWS = ["side", "side_front", "side_rear"]
FRONT_VIEWS = ["front", "front_oblique"]
# Source labels of the actions with a signal of their own.
SOURCES = {
    "machine_chest_press": "machine_chest_press_visible_arm_vertical_path",
    "bench_press": "bench_press_visible_arm_y",
    "lat_pulldown": "lat_pulldown_elbow_flexion_angle",
    "single_arm_pulldown": "single_arm_pulldown_working_side_elbow_flexion_angle",
    "single_arm_hammer_row": "single_arm_hammer_row_working_side_elbow_flexion_angle",
    "chest_supported_row": "chest_supported_row_best_visible_arm_elbow_flexion_angle",
    "plate_loaded_pulldown": "plate_loaded_pulldown_best_visible_arm_elbow_flexion_angle",
    "hack_squat": "hack_squat_hip_knee_visible_depth",
    "hip_thrust": "hip_thrust_hip_extension_angle",
    "plate_loaded_rear_leg_raise": "plate_loaded_rear_leg_raise_working_hip_extension_angle",
    "back_extension": "back_extension_hip_flexion_angle",
    "preacher_curl": "preacher_curl_elbow_flexion_angle",
    "plate_loaded_romanian_deadlift": "plate_loaded_rdl_trunk_hinge_angle",
    "machine_crunch": "machine_crunch_trunk_flexion_angle",
    "standing_hip_abduction": "standing_hip_abduction_working_leg_lateral_displacement",
    "seated_hip_abduction": "seated_hip_abduction_normalized_knee_separation",
    "y_raise": "y_raise_working_side_shoulder_angle",
}
FRONT_PRESS_SOURCE = "machine_chest_press_handle_separation"
# Family formula of actions that only rename it.
BORROWED = {"back_extension": "hip", "preacher_curl": "elbow", "plate_loaded_romanian_deadlift": "lean", "machine_crunch": "lean", "seated_hip_abduction": "apart"}
# Working-side rule per action.
SIDES = {
    "pulldown": ["single_arm_pulldown", "chest_supported_row", "plate_loaded_pulldown"], "row": ["single_arm_hammer_row"],
    "rear_leg": ["plate_loaded_rear_leg_raise"], "press": ["bench_press", "machine_chest_press"], "y_raise": ["y_raise"],
}
# Actions whose missing samples are filled from other frames.
GAPS = ["hack_squat", "y_raise", "standing_hip_abduction"]
SEEN = 0.12
# Formulas that actions name: complete ones, and those whose gaps are filled.
WHOLE = ["knee", "hip", "elbow", "shoulder", "apart", "lean", "reach", "grip", "extension", "bent", *[f"{f}_{s}" for f in ("flexion", "thigh", "press") for s in "lr"]]
GAPPED = ["depth", "shoulder", "apart", *[f"{f}_{s}" for f in ("raise", "out", "out_c") for s in "lr"]]
# A stage of formulas grows beyond the 8,000 bytes up to which the JVM compiles a
# method; Spark then has to evaluate it in smaller functions.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def source_label() -> Column:
    """Label of the row's action, view and family."""
    out = F.when((F.col("action_type") == "machine_chest_press") & F.col("camera_angle").isin(FRONT_VIEWS), F.lit(FRONT_PRESS_SOURCE))
    for action, label in SOURCES.items():
        out = out.when(F.col("action_type") == action, F.lit(label))
    return out.otherwise(F.concat("family", F.lit("_joint_angle")))


def side_rule() -> Column:
    """Variant of ``working_side`` that the row's action and view ask for, NULL without one."""
    out = F.when(F.lit(False), F.lit(""))
    for variant, actions in SIDES.items():
        asked = F.col("action_type").isin(actions)
        out = out.when(asked & F.col("camera_angle").isin(PRESS_VIEWS) if variant == "press" else asked, F.lit(variant))
    return out


def formulas() -> dict[str, Column]:
    """Every value that some action reads, from ``Points`` columns; ``_l`` and
    ``_r`` are one formula with the left or the right side at work."""
    lm = g.Points()
    base = g.base_signals(lm)
    out = {**base, "grip": g.wrist_separation(lm), "extension": 180.0 - base["hip"]}
    arm, arm_c = [g.joint_angle(lm, *x) for x in ARMS], [g.chain_min(lm, x) for x in ARMS]
    leg, leg_c = [g.joint_angle(lm, *x) for x in HINGE], [g.chain_min(lm, x) for x in HINGE]
    up, up_c = [g.joint_angle(lm, *x) for x in RAISES], [g.chain_min(lm, x) for x in RAISES]
    height = [(g.at(lm, wrist, "y") * 0.68 + g.at(lm, elbow, "y") * 0.32) * 100.0 for wrist, elbow in ((LW, LE), (RW, RE))]
    weight = [F.when((arm_c[s] >= SEEN) & arm[s].isNotNull(), arm_c[s]) for s in (0, 1)]
    total = F.coalesce(weight[0], F.lit(0.0)) + F.coalesce(weight[1], F.lit(0.0))
    bent = sum((F.coalesce((180.0 - arm[s]) * weight[s], F.lit(0.0)) for s in (0, 1)), F.lit(0.0))
    out["bent"] = F.when(total > 0, bent / total).otherwise(base["elbow"])
    for side, s, o in (("l", 0, 1), ("r", 1, 0)):
        known = lambda conf, angle: (conf[s] >= SEEN) & angle[s].isNotNull()
        out[f"flexion_{side}"] = F.when(known(arm_c, arm), 180.0 - arm[s]).otherwise(base["elbow"])
        out[f"thigh_{side}"] = F.when(known(leg_c, leg), leg[s]).otherwise(180.0 - base["hip"])
        out[f"press_{side}"] = F.when((arm_c[s] < 0.35) & (arm_c[o] > arm_c[s]), height[o]).otherwise(height[s])
        out[f"raise_{side}"] = F.when(known(up_c, up), up[s])
    sit = [(g.at(lm, hip, "y") - g.at(lm, knee, "y")) * 100.0 for hip, knee in ((LH, LK), (RH, RK))]
    sit_c = [g.chain_min(lm, x) for x in ((LH, LK), (RH, RK))]
    out["depth"] = F.when(F.greatest(*sit_c) >= 0.35, F.when(sit_c[0] >= sit_c[1], sit[0]).otherwise(sit[1]))
    for side, hip, ankle in (("l", LH, LA), ("r", RH, RA)):
        out[f"out_c_{side}"] = g.chain_min(lm, (hip, ankle))
        step = F.abs(g.at(lm, ankle, "x") - g.at(lm, hip, "x")) / g.torso_length(lm) * 100.0
        out[f"out_{side}"] = F.when(out[f"out_c_{side}"] >= SEEN, step)
    return out


def formula_rule() -> Column:
    """Name of the formula of the row's action, family, view and side."""
    action, view = F.col("action_type"), F.col("camera_angle")
    own = lambda name: F.concat(F.lit(f"{name}_"), F.when(F.col("side") == "left", F.lit("l")).otherwise(F.lit("r")))
    press = F.when(view.isin(PRESS_VIEWS), own("press")).otherwise(F.lit("elbow"))
    out = (
        F.when(action == "bench_press", press)
        .when(action == "machine_chest_press", F.when(view.isin(FRONT_VIEWS), F.lit("grip")).otherwise(press))
        .when(action == "lat_pulldown", F.lit("bent"))
        .when(action.isin(SIDES["pulldown"] + SIDES["row"]), own("flexion"))
        .when(action == "hip_thrust", F.lit("extension"))
        .when(action.isin(SIDES["rear_leg"]), own("thigh"))
        .when(action == "hack_squat", F.lit("depth"))
        .when(action == "y_raise", own("raise"))
    )
    for name, formula in BORROWED.items():
        out = out.when(action == name, F.lit(formula))
    for family, formula in g.SIGNAL_OF.items():
        out = out.when(F.col("family") == family, F.lit(formula))
    return out.otherwise(F.lit("reach"))


def action_signals(frames: DataFrame, actions: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """(keys, action_type, pose_idx, n, signal, source), a row per frame and action of its series.

    ``frames`` holds ``landmarks``, ``actions`` the ``action_type``, ``family``
    and ``camera_angle`` of each series, one row per action where a series has
    several.  All formulas are worked out once per frame and sides chosen once per
    series, however many actions it has.  An action is then the name of a formula;
    it meets the frames at chunk grain, so only finished signals are as many as
    frames times actions."""
    keys = list(keys)
    series = [*keys, "action_type"]
    c = F.col
    with settings(frames.sparkSession, COMPILED):
        points = stored(frames.select(*keys, "pose_idx", "n", *g.flat_points(c("landmarks"), SLOTS)))
        rows = stored(points.select(*keys, "pose_idx", "n", *[v.alias(f"_{name}") for name, v in formulas().items()]))
        asked = stored(actions.join(points.select(*keys, "n").distinct(), keys).withColumn("variant", side_rule()))
        wanted = asked.groupBy(*keys, "n").agg(F.collect_set("variant").alias("_wanted"))
        sides = working_sides(spread_join(points, wanted, keys, "inner"), list(SIDES), keys, "_wanted", g.Points())
        acts = asked.join(sides.select(*keys, "variant", "side"), [*keys, "variant"], "left")
        acts = stored(acts.select(*series, "n", source_label().alias("source"), formula_rule().alias("_formula")))
        gapped = c("action_type").isin(GAPS)
        filled = filled_signals(rows, acts.where(gapped), keys)
    whole = acts.where(~gapped).withColumn("_at", _position(WHOLE, c("_formula")))
    out = spread_join(rows, whole, keys, "inner").withColumn("signal", _value(WHOLE, c("_at")))
    shown = [*series, "pose_idx", "n", "signal", "source"]
    return out.select(*shown).unionByName(filled.select(*shown))


def _position(names: Sequence[str], name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in names]), name).cast("int") - 1


def _value(names: Sequence[str], position: Column) -> Column:
    return F.get(F.array(*[F.col(f"_{x}") for x in names]), position)


def filled_signals(rows: DataFrame, acts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signals with gaps.  A frame gives one sample per series of measures: depth,
    raise, or the left and the right leg, of which the better one is taken."""
    keys = list(keys)
    series = [*keys, "action_type"]
    c = F.col
    action = c("action_type")
    none = F.lit(None).cast("int")
    at = lambda name: _position(GAPPED, F.lit(name))
    sample = lambda name, raw, empty, conf: F.struct(F.lit(name).alias("_of"), raw.alias("_raw"), empty.alias("_empty"), conf.alias("_conf"))
    samples = (
        F.when(action == "hack_squat", F.array(sample("depth", at("depth"), none, none)))
        .when(action == "y_raise", F.array(sample("raise", _position(GAPPED, c("_formula")), at("shoulder"), none)))
        .otherwise(F.array(*[sample(s, at(f"out_{s}"), at("apart"), at(f"out_c_{s}")) for s in "lr"]))
    )
    asked = acts.select(*series, "n", F.explode(samples).alias("_s")).select(*series, "n", "_s.*")
    values = [_value(GAPPED, c(name)).alias(name) for name in ("_raw", "_empty", "_conf")]
    rows = stored(spread_join(rows, asked, keys, "inner").select(*series, "pose_idx", "n", "_of", *values))
    depth = fill_with_mean(rows.where(c("_of") == "depth"), [*series, "_of"], "_raw", "signal")
    filled = stored(interpolate(rows.where(c("_of") != "depth"), [*series, "_of"], "_raw", "signal", empty="_empty"))
    specs = {"hi": ("signal", 0.95), "lo": ("signal", 0.05), "c": ("_conf", 0.25)}
    q = quantiles(filled.where(c("_of").isin("l", "r")), [*series, "n", "_of"], specs)
    score = lambda s: F.max(F.when(c("_of") == s, (c("hi") - c("lo")) * c("c")))
    better = q.groupBy(*series).agg((score("r") > score("l")).alias("_right"))
    taken = F.when(action == "hack_squat", F.lit("depth")).when(action == "y_raise", F.lit("raise"))
    taken = taken.when(c("_right"), F.lit("r")).otherwise(F.lit("l"))
    picked = acts.join(better, series, "left").select(*series, "n", "source", taken.alias("_of"))
    shown = [*series, "_of", "pose_idx", "n", "signal"]
    return spread_join(depth.select(*shown).unionByName(filled.select(*shown)), picked, [*series, "_of"], "inner")
