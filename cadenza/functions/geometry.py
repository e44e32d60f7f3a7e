"""Column expressions over a landmark array ``ARRAY<STRUCT<x,y,z,vis>>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.core.num import clamp, rnd
from cadenza.functions.landmarks import (
    ARM, HINGE, JOINTS, LA, LE, LEG, LH, LK, LS, LW, METRIC_CHAINS, RA, RE, RH, RK, RS, RW, TRUNK,
)

LANDMARKS = "landmarks"
FIELDS = ("x", "y", "vis")


class Points:
    """Landmarks of flat rows: columns ``x11``, ``y11``, ``vis11``, ... stand for
    the array.  Formulas over many slots of an array take the optimizer, which
    compares all its extractions, longer than the rows."""

    def __getitem__(self, i: int) -> dict[str, Column]:
        return {field: F.col(f"{field}{i}") for field in FIELDS}


def flat_points(lm: Column, slots: Sequence[int]) -> list[Column]:
    """The columns that ``Points`` reads."""
    return [at(lm, i, field).alias(f"{field}{i}") for i in slots for field in FIELDS]


def at(lm: Column, i: int, field: str) -> Column:
    return lm[i][field]


def vis(lm: Column, i: int) -> Column:
    return lm[i]["vis"]


def _least(values: Sequence[Column]) -> Column:
    return values[0] if len(values) == 1 else F.least(*values)


def chain_min(lm: Column, idx: Sequence[int]) -> Column:
    """Chain confidence: the weakest landmark."""
    return _least([vis(lm, i) for i in idx])


def chain_mean(lm: Column, idx: Sequence[int]) -> Column:
    """Chain visibility: the mean over its landmarks."""
    total = vis(lm, idx[0])
    for i in idx[1:]:
        total = total + vis(lm, i)
    return total / F.lit(float(len(idx)))


def best_side(lm: Column, sides: Sequence[Sequence[int]]) -> Column:
    return F.greatest(*[chain_mean(lm, s) for s in sides])


def metric_conf(lm: Column, metric: str) -> Column:
    return _least([chain_min(lm, c) for c in METRIC_CHAINS[metric]])


def metric_conf_map(lm: Column) -> Column:
    names = F.array(*[F.lit(m) for m in METRIC_CHAINS])
    return F.map_from_arrays(names, F.array(*[rnd(metric_conf(lm, m), 3) for m in METRIC_CHAINS]))


def side_confs(lm: Column, metric: str) -> Column:
    return F.array(*[chain_min(lm, c) for c in METRIC_CHAINS[metric]])


def _norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance(lm: Column, a: int, b: int) -> Column:
    return _norm(at(lm, a, "x") - at(lm, b, "x"), at(lm, a, "y") - at(lm, b, "y"))


def mid(lm: Column, a: int, b: int, field: str) -> Column:
    return (at(lm, a, field) + at(lm, b, field)) / F.lit(2.0)


def joint_angle(lm: Column, a: int, b: int, c: int) -> Column:
    """Angle at ``b`` in degrees in the image plane; NULL if a segment vanishes."""
    ux, uy = at(lm, a, "x") - at(lm, b, "x"), at(lm, a, "y") - at(lm, b, "y")
    wx, wy = at(lm, c, "x") - at(lm, b, "x"), at(lm, c, "y") - at(lm, b, "y")
    scale = _norm(ux, uy) * _norm(wx, wy)
    cosine = clamp((ux * wx + uy * wy) / scale, -1.0, 1.0)
    return F.when(scale >= 1e-8, F.degrees(F.acos(cosine)))


def both_sides(left: Column, right: Column, fallback: float = 180.0) -> Column:
    """Mean of the measurable sides."""
    return F.coalesce((left + right) / F.lit(2.0), left, right, F.lit(float(fallback)))


def bilateral(lm: Column, sides: Sequence[tuple[int, int, int]]) -> Column:
    return both_sides(joint_angle(lm, *sides[0]), joint_angle(lm, *sides[1]))


def tracked_joint(lm: Column, joint: str, min_conf: float = 0.20) -> Column:
    """Angle of one of the eight joints, NULL below the confidence floor."""
    return F.when(chain_min(lm, JOINTS[joint]) >= min_conf, joint_angle(lm, *JOINTS[joint]))


SHOULDER_SIDES = ((LH, LS, LE), (RH, RS, RE))


def trunk_vector(lm: Column) -> tuple[Column, Column]:
    return (
        mid(lm, LS, RS, "x") - mid(lm, LH, RH, "x"),
        mid(lm, LS, RS, "y") - mid(lm, LH, RH, "y"),
    )


def trunk_lean(lm: Column) -> Column:
    dx, dy = trunk_vector(lm)
    return F.degrees(F.atan2(F.abs(dx), F.greatest(F.lit(1e-6), F.abs(dy))))


def shoulder_hip_line(lm: Column) -> Column:
    dx, dy = trunk_vector(lm)
    return F.abs(F.degrees(F.atan2(dy, dx)))


def signed_trunk_angle(lm: Column) -> Column:
    """Signed angle of hips -> shoulders from the vertical."""
    dx, dy = trunk_vector(lm)
    return F.degrees(F.atan2(dx, F.greatest(F.lit(1e-6), -dy)))


def pair_tilt(lm: Column, left: int, right: int) -> Column:
    rise = at(lm, right, "y") - at(lm, left, "y")
    run = F.abs(at(lm, right, "x") - at(lm, left, "x"))
    return F.degrees(F.atan2(rise, F.greatest(F.lit(1e-6), run)))


def wrapped_delta(value: Column, reference: Column) -> Column:
    return F.pmod(value - reference + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def torso_length(lm: Column, floor: float = 0.12) -> Column:
    return F.greatest(F.lit(floor), _norm(*trunk_vector(lm)))


def torso_horizontal(lm: Column) -> Column:
    dx, dy = trunk_vector(lm)
    return clamp((F.abs(dx) - F.lit(0.65) * F.abs(dy)) / F.lit(0.32))


def knee_flexion_score(lm: Column) -> Column:
    return clamp((F.lit(170.0) - bilateral(lm, LEG)) / F.lit(70.0))


# ---- frame quality -----------------------------------------------------------------

# Fixed values: (trunk weight, limb weight) per family.
FAMILY_QUALITY = {
    "squat": (0.28, 0.72, LEG), "isolation_knee": (0.28, 0.72, LEG), "isolation_hip": (0.28, 0.72, LEG),
    "hinge": (0.38, 0.62, HINGE),
    "press": (0.24, 0.76, ARM), "pull": (0.24, 0.76, ARM), "isolation_elbow": (0.24, 0.76, ARM),
    "isolation_shoulder": (0.0, 1.0, ARM),
}
_UPPER_ARM = ((LS, LE), (RS, RE))
_THIGH = ((LH, LK), (RH, RK))
# Per-action overrides (support weight, limb weight, support set, limb chains).
ACTION_QUALITY = {
    "machine_chest_press": (0.20, 0.80, TRUNK, ARM), "chest_supported_row": (0.20, 0.80, TRUNK, ARM),
    "t_bar_row": (0.20, 0.80, TRUNK, ARM), "plate_loaded_pulldown": (0.20, 0.80, TRUNK, ARM),
    "standing_hip_abduction": (0.28, 0.72, (LH, RH), LEG), "seated_hip_abduction": (0.28, 0.72, (LH, RH), LEG),
    "single_arm_pulldown": (0.18, 0.82, TRUNK, ARM), "single_arm_hammer_row": (0.24, 0.76, TRUNK, ARM),
    "plate_loaded_rear_leg_raise": (0.25, 0.75, TRUNK, HINGE), "hack_squat": (0.22, 0.78, TRUNK, _THIGH),
}


def family_quality(lm: Column, family: Column) -> Column:
    trunk = chain_mean(lm, TRUNK)
    out = F.when(F.lit(False), trunk)
    for name, (wt, wl, chains) in FAMILY_QUALITY.items():
        score = F.lit(wt) * trunk + F.lit(wl) * best_side(lm, chains) if wt else best_side(lm, chains)
        out = out.when(family == name, score)
    return out.otherwise(trunk)


def frame_quality(lm: Column, family: Column, action: Column | None = None) -> Column:
    base = family_quality(lm, family)
    if action is None:
        return base
    out = F.when(action == "machine_crunch", chain_mean(lm, TRUNK))
    for name, (ws, wl, support, chains) in ACTION_QUALITY.items():
        out = out.when(action == name, F.lit(ws) * chain_mean(lm, support) + F.lit(wl) * best_side(lm, chains))
    out = out.when(
        action == "preacher_curl", F.lit(0.18) * best_side(lm, _UPPER_ARM) + F.lit(0.82) * best_side(lm, ARM)
    )
    return out.otherwise(base)


# ---- motion signals ----------------------------------------------------------------


def knee_separation(lm: Column) -> Column:
    return F.abs(at(lm, LK, "x") - at(lm, RK, "x")) / torso_length(lm) * F.lit(100.0)


def wrist_separation(lm: Column) -> Column:
    return F.abs(at(lm, LW, "x") - at(lm, RW, "x")) / torso_length(lm) * F.lit(100.0)


def reach(lm: Column) -> Column:
    wx = mid(lm, LW, RW, "x") - mid(lm, LS, RS, "x")
    wy = mid(lm, LW, RW, "y") - mid(lm, LS, RS, "y")
    return (_norm(wx, wy) + _norm(*trunk_vector(lm))) * F.lit(100.0)


SIGNAL_OF = {
    "squat": "knee", "isolation_knee": "knee", "hinge": "hip", "press": "elbow", "pull": "elbow", "isolation_elbow": "elbow",
    "isolation_shoulder": "shoulder", "isolation_hip": "apart", "core_flexion": "lean",
}


def base_signals(lm: Column) -> dict[str, Column]:
    """The distinct formulas behind the family signals; select them as columns
    before using several, so that each is evaluated once."""
    return {
        "knee": F.lit(180.0) - bilateral(lm, LEG), "hip": F.lit(180.0) - bilateral(lm, HINGE), "elbow": F.lit(180.0) - bilateral(lm, ARM),
        "shoulder": bilateral(lm, SHOULDER_SIDES), "apart": knee_separation(lm), "lean": trunk_lean(lm), "reach": reach(lm),
    }


def family_signals(lm: Column) -> dict[str, Column]:
    """One motion signal per movement family."""
    base = base_signals(lm)
    return {family: base[name] for family, name in SIGNAL_OF.items()}


def family_signal(lm: Column, family: Column | str) -> Column:
    base = base_signals(lm)
    if isinstance(family, str):
        return base[SIGNAL_OF.get(family, "reach")]
    out = F.when(F.lit(False), F.lit(0.0))
    for name in dict.fromkeys(SIGNAL_OF.values()):
        out = out.when(family.isin([f for f, n in SIGNAL_OF.items() if n == name]), base[name])
    return out.otherwise(base["reach"])


# ---- boxes -------------------------------------------------------------------------


def bbox(lm: Column, idx: Sequence[int], threshold: float = 0.05) -> Column:
    """Corner box of the visible points, the full image when none is visible."""
    points = F.filter(F.array(*[lm[i] for i in idx]), lambda p: p["vis"] >= threshold)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(
        clamp(F.array_min(xs)).alias("x1"), clamp(F.array_min(ys)).alias("y1"),
        clamp(F.array_max(xs)).alias("x2"), clamp(F.array_max(ys)).alias("y2"),
    )
    whole = F.struct(*[F.lit(v).alias(k) for k, v in (("x1", 0.0), ("y1", 0.0), ("x2", 1.0), ("y2", 1.0))])
    return F.when(F.size(points) > 0, box).otherwise(whole)


def box_area(b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b["x2"] - b["x1"]) * F.greatest(zero, b["y2"] - b["y1"])


def box_center(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / F.lit(2.0), (b["y1"] + b["y2"]) / F.lit(2.0)


def box_iou(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = box_area(a) + box_area(b) - w * h
    return F.when(union > 1e-6, w * h / union).otherwise(zero)


def roi_bonus(b: Column, roi: Column) -> Column:
    cx, cy = box_center(b)
    inside = cx.between(roi["x1"], roi["x2"]) & cy.between(roi["y1"], roi["y2"])
    bonus = F.when(inside, 0.35).otherwise(-0.25) + F.lit(0.25) * box_iou(b, roi)
    return F.coalesce(F.when(roi.isNotNull(), bonus), F.lit(0.0))


def normalize_roi(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corner box of a fractional region; NULL when malformed or in pixels."""
    ok = (w > 0) & (h > 0) & (F.greatest(F.abs(x), F.abs(y), F.abs(w), F.abs(h)) <= 1.5)
    box = F.struct(
        clamp(x).alias("x1"), clamp(y).alias("y1"), clamp(x + w).alias("x2"), clamp(y + h).alias("y2")
    )
    return F.when(ok & (clamp(x + w) > clamp(x)) & (clamp(y + h) > clamp(y)), box)


# ---- limb ratios -------------------------------------------------------------------


def side(lm: Column, left: bool) -> tuple[int, int, int, int]:
    """Shoulder, elbow, wrist and hip slots of one side."""
    return (LS, LE, LW, LH) if left else (RS, RE, RW, RH)


def _shown(value: Column, lm: Column, slots: Sequence[int], floor: float = 0.35) -> Column:
    """NULL unless all landmarks of the ratio are visible enough."""
    return F.when(chain_min(lm, slots) >= floor, value)


def wrist_above_shoulder(lm: Column, left: bool) -> Column:
    s, _, w, _ = side(lm, left)
    return _shown(at(lm, s, "y") - at(lm, w, "y"), lm, (s, w))


def wrist_outward_ratio(lm: Column, left: bool) -> Column:
    s, _, w, _ = side(lm, left)
    width = F.greatest(F.lit(0.03), distance(lm, LS, RS))
    return _shown(F.abs(at(lm, w, "x") - at(lm, s, "x")) / width, lm, (s, w))


def vertical_outward_ratio(lm: Column, left: bool) -> Column:
    s, _, w, _ = side(lm, left)
    up, out = at(lm, s, "y") - at(lm, w, "y"), F.abs(at(lm, w, "x") - at(lm, s, "x"))
    return _shown(F.when(up > 0, up / F.greatest(F.lit(0.03), out)).otherwise(0.0), lm, (s, w))


def forearm_tilt(lm: Column, left: bool) -> Column:
    _, e, w, _ = side(lm, left)
    dx, dy = F.abs(at(lm, w, "x") - at(lm, e, "x")), F.abs(at(lm, w, "y") - at(lm, e, "y"))
    return _shown(dx / F.greatest(F.lit(0.015), dy), lm, (e, w))


def elbow_descent(start: Column, key: Column, left: bool) -> Column:
    """How far the elbow moves down from the start to the key frame."""
    s, e, w, _ = side(start, left)
    drop = at(key, e, "y") - at(start, e, "y")
    return F.when((chain_min(start, (s, e, w)) >= 0.35) & (chain_min(key, (s, e, w)) >= 0.35), drop)


def elbow_drop(lm: Column, left: bool) -> Column:
    s, e, _, _ = side(lm, left)
    return _shown(at(lm, e, "y") - at(lm, s, "y"), lm, (s, e), 0.45)


def of_sides(left: Column, right: Column) -> Column:
    """Mean of the measurable sides, 0 without any."""
    return both_sides(left, right, 0.0)
