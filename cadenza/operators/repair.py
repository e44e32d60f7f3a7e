"""Keypoint remapping, gating, compensation and repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.layout import CHUNK, over_neighbours, scan
from cadenza.core.num import clamp
from cadenza.functions import geometry as g
from cadenza.functions.landmarks import COCO_TO_SLOT, LA, LE, LH, LK, LS, LW, POSE_FLOOR, RA, RE, RH, RK, RS, RW

POINT = "struct<x:double,y:double,z:double,vis:double>"


def point(x: Column, y: Column, z: Column, vis: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), vis.alias("vis"))


def remap_keypoints(points: Column, scores: Column, width: Column, height: Column) -> Column:
    """COCO-17 points in pixels -> 33-slot skeleton in image fractions."""
    empty = point(F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(0.0))
    source = {slot: k for k, slot in COCO_TO_SLOT.items()}

    def slot(s: int) -> Column:
        if s not in source:
            return empty
        k = source[s]
        p = F.get(points, F.lit(k))
        one = F.lit(1.0)
        found = point(
            p[0] / F.greatest(one, width), p[1] / F.greatest(one, height), F.lit(0.0),
            F.coalesce(F.get(scores, F.lit(k)), F.lit(0.0)),
        )
        return F.when(p.isNotNull(), found).otherwise(empty)

    return F.array(*[slot(s) for s in range(33)])


def lift_instances(points: Column, scores: Column) -> Column:
    """Pair every instance with its scores, shortest list wins."""
    n = F.least(F.size(points), F.size(scores))
    return F.slice(F.arrays_zip(points.alias("points"), scores.alias("scores")), 1, n)


# Outlier limits of the distal / proximal length ratio.
LEG_RATIO, ARM_RATIO, MIN_SEGMENT = (0.22, 2.65), (0.20, 2.85), 0.015
LEG_FAMILIES = ["squat", "hinge", "isolation_knee"]
ARM_FAMILIES = ["press", "pull", "isolation_shoulder", "isolation_elbow"]


def limb_outlier(lm: Column, chain: Sequence[int], limits: tuple[float, float]) -> Column:
    near, far = g.distance(lm, chain[0], chain[1]), g.distance(lm, chain[1], chain[2])
    ratio = far / F.greatest(F.lit(1e-6), near)
    odd = (near < MIN_SEGMENT) | (far < MIN_SEGMENT) | (ratio < limits[0]) | (ratio > limits[1])
    return (g.chain_min(lm, chain) >= 0.35) & odd


def downweight_outliers(df: DataFrame, family: Column, action: Column) -> DataFrame:
    """Cap the visibility of a distal point whose limb length is implausible;
    ``changed`` counts the capped points of the frame."""
    lm = F.col("landmarks")
    legs = family.isin(LEG_FAMILIES)
    arms = family.isin(ARM_FAMILIES) | (action == "single_arm_pulldown")
    flags = {
        LA: legs & limb_outlier(lm, (LH, LK, LA), LEG_RATIO), RA: legs & limb_outlier(lm, (RH, RK, RA), LEG_RATIO),
        LW: arms & limb_outlier(lm, (LS, LE, LW), ARM_RATIO), RW: arms & limb_outlier(lm, (RS, RE, RW), ARM_RATIO),
    }
    capped = F.array(*[F.when(hit, F.lit(slot)) for slot, hit in flags.items()])
    out = F.transform(
        lm, lambda p, i: F.when(F.array_contains(F.array_compact(F.col("_cap")), i), p.withField("vis", F.least(p["vis"], F.lit(0.18)))).otherwise(p)
    )
    return (
        df.withColumn("_cap", capped).withColumn("changed", F.size(F.array_compact("_cap")).cast("long"))
        .withColumn("landmarks", out).drop("_cap")
    )


GATED = [LK, RK, LA, RA, 29, 30, 31, 32]
# Fixed values: (threshold, floor, factor) of the two mask presets.
MASK_PRESETS = {"segmentation": (0.35, 0.02, 0.25), "person": (0.55, 0.01, 0.18)}


def mask_gate(lm: Column, scores: Column, preset: str = "segmentation") -> Column:
    """Lower the visibility of lower-limb points that fall outside the mask."""
    threshold, floor, factor = MASK_PRESETS[preset]
    gated = F.array(*[F.lit(i) for i in GATED])
    return F.transform(
        lm,
        lambda p, i: F.when(
            F.array_contains(gated, i) & (F.get(scores, i) < threshold),
            p.withField("vis", F.least(p["vis"], F.greatest(F.lit(floor), F.get(scores, i) * factor))),
        ).otherwise(p),
    )


def combine_mask_scores(a: Column, b: Column) -> Column:
    """Element-wise minimum, the longer tail kept; one missing side is ignored."""
    both = F.zip_with(a, b, lambda x, y: F.coalesce(F.least(x, y), x, y))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def sample_mask(mask: Column, x: Column, y: Column, radius: int = 3) -> Column:
    """Largest mask value in the patch around a point; ``mask`` is rows of values."""
    h, w = F.size(mask), F.size(mask[0])
    px, py = F.bround(x * F.greatest(F.lit(1), w - 1)).cast("int"), F.bround(y * F.greatest(F.lit(1), h - 1)).cast("int")
    lo_x, hi_x = F.greatest(F.lit(0), px - radius), F.least(w, px + radius + 1)
    lo_y, hi_y = F.greatest(F.lit(0), py - radius), F.least(h, py + radius + 1)
    rows = F.slice(mask, lo_y + 1, hi_y - lo_y)
    peak = F.array_max(F.transform(rows, lambda r: F.array_max(F.slice(r, lo_x + 1, hi_x - lo_x))))
    inside = x.between(0.0, 1.0) & y.between(0.0, 1.0)
    return F.when(mask.isNull() | (h <= 0), F.lit(1.0)).when(inside, F.coalesce(peak, F.lit(0.0))).otherwise(0.0)


def compensate(lm: Column, available: Column, m: Column, width: Column, height: Column) -> Column:
    """Apply the inverse camera affine (six numbers, row by row, in pixels)."""
    finite = F.forall(m, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    ok = available & (F.size(m) == 6) & (width > 0) & (height > 0) & finite
    moved = F.transform(
        lm,
        lambda p: p.withField("x", (m[0] * p["x"] * width + m[1] * p["y"] * height + m[2]) / width)
        .withField("y", (m[3] * p["x"] * width + m[4] * p["y"] * height + m[5]) / height),
    )
    return F.when(ok, moved).otherwise(lm)


# Landmarks never rendered, and the extra ones per situation.
FACE, FEET, HANDS = list(range(11)), [29, 30, 31, 32], list(range(15, 23))
FIXED_FOOT = {"hack_squat": HANDS, "hip_thrust": [LK, RK, *HANDS]}


def suppressed_slots(family: Column, action: Column) -> Column:
    lists = [F.array(*[F.lit(i) for i in FACE])]
    none = F.array().cast("array<int>")
    lists.append(F.when(family == "hinge", F.array(*[F.lit(i) for i in FEET])).otherwise(none))
    for name, slots in FIXED_FOOT.items():
        lists.append(F.when(action == name, F.array(*[F.lit(i) for i in slots])).otherwise(none))
    return F.array_sort(F.array_distinct(F.concat(*lists)))


def suppress(lm: Column, slots: Column, cap: float = 0.0) -> Column:
    return F.transform(
        lm,
        lambda p, i: F.when(F.array_contains(slots, i), p.withField("vis", F.least(p["vis"], F.lit(cap)))).otherwise(p),
    )


def lock_feet(lm: Column, action: Column, left: Column, right: Column) -> Column:
    """Pin the ankles to their anchors (hide them without one) and hide the foot
    details of fixed-foot actions.  Anchors are structs x, y, conf."""
    hidden = F.array().cast("array<int>")
    for name, slots in FIXED_FOOT.items():
        hidden = F.when(action == name, F.array(*[F.lit(i) for i in slots])).otherwise(hidden)
    base = suppress(lm, hidden, 0.05)
    is_fixed = action.isin(list(FIXED_FOOT))

    def ankle(slot: int, anchor: Column) -> Column:
        pinned = point(clamp(anchor["x"]), clamp(anchor["y"]), F.lit(0.0), clamp(anchor["conf"], 0.68, 0.94))
        p = F.get(base, F.lit(slot))
        return F.when(anchor.isNotNull(), pinned).otherwise(p.withField("vis", F.least(p["vis"], F.lit(0.05))))

    la, ra = ankle(LA, left), ankle(RA, right)
    detail = lambda a: a.withField("vis", F.lit(0.0))
    replaced = F.transform(
        base,
        lambda p, i: F.when(i == LA, la).when(i == RA, ra).when((i == 29) | (i == 31), detail(la))
        .when((i == 30) | (i == 32), detail(ra)).otherwise(p),
    )
    return F.when(is_fixed, replaced).otherwise(lm)


def _lerp(p, a, b, i):
    ratio = (i - a["i"]) / (b["i"] - a["i"])
    return [a["p"][f] + (b["p"][f] - a["p"][f]) * ratio for f in ("x", "y", "z")]


def repair_landmarks(df: DataFrame, keys: Sequence[str], slots: Sequence[int] | None = None,
                     threshold: float = POSE_FLOOR, size: int = CHUNK) -> DataFrame:
    """Replace the coordinates of weak points by interpolation between the nearest
    confident frames on both sides; first and last frame stay.  Visibility is kept.

    One window per landmark over the same partitioning: no blow-up to one row
    per landmark.
    """
    slots = list(range(33)) if slots is None else list(slots)
    lm, i = F.col("landmarks"), F.col("pose_idx")
    seen = {s: F.when(lm[s]["vis"] >= threshold, F.struct(i.alias("i"), lm[s].alias("p"))) for s in slots}
    d = scan(df, keys, {f"_b{s}": c for s, c in seen.items()}, {f"_a{s}": c for s, c in seen.items()}, size=size)
    inner = (F.col("n") >= 3) & (i > 0) & (i < F.col("n") - 1)

    def fixed(s: int) -> Column:
        p, b, a = lm[s], F.col(f"_b{s}"), F.col(f"_a{s}")
        x, y, z = _lerp(p, b, a, i)
        weak = inner & (p["vis"] < threshold) & b.isNotNull() & a.isNotNull()
        return F.when(weak, point(x, y, z, p["vis"])).otherwise(p)

    fixed_slots = {s: fixed(s) for s in slots}
    out = F.array(*[fixed_slots.get(s, lm[s]) for s in range(33)])
    return d.withColumn("landmarks", out).drop(*[f"_b{s}" for s in slots], *[f"_a{s}" for s in slots])


def recover_gaps(df: DataFrame, keys: Sequence[str], slots: Sequence[int] | None = None, max_gap: int = 3,
                 threshold: float = POSE_FLOOR, size: int = CHUNK) -> DataFrame:
    """Fill runs of at most ``max_gap`` weak frames between confident ones, for
    display: coordinates interpolated, visibility at most .58."""
    slots = list(range(33)) if slots is None else list(slots)
    lm, i = F.col("landmarks"), F.col("pose_idx")

    def near(s: int, forward: bool):
        seen = F.when(lm[s]["vis"] >= threshold, F.struct(i.alias("i"), lm[s].alias("p")))
        if forward:
            return lambda w: F.first(seen, True).over(w.rowsBetween(1, max_gap))
        return lambda w: F.last(seen, True).over(w.rowsBetween(-max_gap, -1))

    cols = {f"_b{s}": near(s, False) for s in slots} | {f"_a{s}": near(s, True) for s in slots}
    d = over_neighbours(df, keys, cols, max_gap, max_gap, size)

    def fixed(s: int) -> Column:
        p, b, a = lm[s], F.col(f"_b{s}"), F.col(f"_a{s}")
        x, y, z = _lerp(p, b, a, i)
        short = (p["vis"] < threshold) & (a["i"] - b["i"] - 1 <= max_gap)
        shown = F.least(F.lit(0.58), b["p"]["vis"], a["p"]["vis"])
        return F.when(short & (F.col("n") >= 3), point(x, y, z, shown)).otherwise(p)

    fixed_slots = {s: fixed(s) for s in slots}
    out = F.array(*[fixed_slots.get(s, lm[s]) for s in range(33)])
    return d.withColumn("landmarks", out).drop(*cols)
