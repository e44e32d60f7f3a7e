"""Where in a recording the training happens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.layout import islands, spread_join
from cadenza.core.num import clamp, odd_window, rnd
from cadenza.core.quantiles import quantiles
from cadenza.core.session import materialise
from cadenza.functions import geometry as g
from cadenza.functions.landmarks import ARM, HINGE, TRUNK
from cadenza.operators.cycles import cycles_or_partial
from cadenza.operators.smoothing import motion_energy, smooth


def tracking_quality(frames: DataFrame, keys: Sequence[str] = ("video_id",), out: str = "tracking") -> DataFrame:
    """How consistent each frame's body box is with the medians of its video."""
    keys = list(keys)
    b = g.bbox(F.col("landmarks"), TRUNK)
    cx, cy = g.box_center(F.col("_b"))
    zero = F.lit(0.0)
    d = frames.withColumn("_b", b)
    d = d.select(
        *frames.columns, g.box_area(F.col("_b")).alias("_ar"), F.greatest(zero, F.col("_b.x2") - F.col("_b.x1")).alias("_wd"),
        F.greatest(zero, F.col("_b.y2") - F.col("_b.y1")).alias("_ht"), cx.alias("_x"), cy.alias("_y"),
    )
    m = quantiles(d.select(*keys, "n", "_ar", "_wd", "_ht", "_x", "_y"), [*keys, "n"], {f"m{c}": (c, 0.5) for c in ("_ar", "_wd", "_ht", "_x", "_y")})
    d = spread_join(d, m, keys)

    def part(c: str, floor: float, slack: float) -> Column:
        r = F.col(c) / F.greatest(F.lit(floor), F.col(f"m{c}"))
        return F.when(r <= slack, 1.0).otherwise(clamp(1.0 - (r - slack) / 1.35))

    area, width, height = part("_ar", 0.015, 1.65), part("_wd", 0.03, 1.75), part("_ht", 0.05, 1.75)
    away = F.sqrt(F.pow(F.col("_x") - F.col("m_x"), 2) + F.pow(F.col("_y") - F.col("m_y"), 2))
    score = 0.65 * area + 0.20 * F.least(area, width, height) + 0.15 * clamp(1.0 - away / 0.42)
    return d.select(*frames.columns, score.alias(out))


def reliable_window(rows: DataFrame, fps: float, keys: Sequence[str] = ("video_id",), tracking: str = "tracking") -> DataFrame:
    """Longest stretch with consistent tracking; ``trimmed`` is false when it is
    the whole recording or the cut would be negligible."""
    keys = list(keys)
    d = smooth(rows.select(*keys, "pose_idx", "n", tracking), keys, tracking, odd_window(fps * 0.45), "_q")
    seg = islands(d, keys, max(1, int(fps * 1.0)), F.col("_q") >= 0.42).groupBy(*keys, "n", "island").agg(
        F.min("pose_idx").alias("s"), F.max("pose_idx").alias("e"))
    best = seg.groupBy(*keys, "n").agg(F.min(F.struct((F.col("s") - F.col("e")).alias("d"), "s", "e")).alias("b"))
    pad, least = max(1, int(fps * 0.55)), max(2, int(fps * 0.4))
    everyone = rows.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("_c"))
    w = everyone.join(best, [*keys, "n"], "left")
    s, e = F.greatest(F.lit(0), F.col("b.s") - pad), F.least(F.col("n") - 1, F.col("b.e") + pad)
    cut = F.coalesce((F.col("n") >= 8) & ((s >= least) | (F.col("n") - 1 - e >= least)), F.lit(False))
    return w.select(*keys, "n", F.when(cut, s).otherwise(0).cast("long").alias("start_idx"), F.when(cut, e).otherwise(F.col("n") - 1).cast("long").alias("end_idx"), cut.alias("trimmed"))


# Elbow-phase actions and their flexed angle.
ELBOW_PHASE = {
    "lat_pulldown": 90.0, "single_arm_pulldown": 110.0, "single_arm_hammer_row": 110.0, "chest_supported_row": 112.0,
    "plate_loaded_pulldown": 110.0, "preacher_curl": 105.0,
}
# Fixed values: (posture weight, motion weight) per action, then per family.
ACTION_WEIGHTS = {
    "bench_press": (0.82, 0.18), "lat_pulldown": (0.44, 0.56), "single_arm_pulldown": (0.44, 0.56), "plate_loaded_pulldown": (0.44, 0.56),
    "single_arm_hammer_row": (0.34, 0.66), "chest_supported_row": (0.34, 0.66), "preacher_curl": (0.34, 0.66),
    "machine_crunch": (0.30, 0.70), "standing_hip_abduction": (0.30, 0.70), "seated_hip_abduction": (0.30, 0.70),
    "plate_loaded_romanian_deadlift": (0.30, 0.70), "hip_thrust": (0.42, 0.58),
}
FAMILY_WEIGHTS = {"hinge": (0.74, 0.26), "pull": (0.74, 0.26), "squat": (0.68, 0.32), "isolation_knee": (0.68, 0.32), "isolation_hip": (0.68, 0.32)}
# Signal range from which the whole clip of an action counts as active.
FULL_SIGNAL = {
    "single_arm_hammer_row": 35.0, "machine_chest_press": 20.0, "machine_crunch": 10.0, "standing_hip_abduction": 10.0,
    "seated_hip_abduction": 8.0, "chest_supported_row": 20.0, "plate_loaded_pulldown": 20.0, "plate_loaded_romanian_deadlift": 15.0,
}


def with_posture(frames: DataFrame) -> DataFrame:
    """Add ``posture``: how much a pose looks like the action is under way, scaled
    by quality.  The joint formulas are selected first, then compared."""
    lm = F.col("landmarks")
    hips = F.coalesce(F.greatest(g.joint_angle(lm, *HINGE[0]), g.joint_angle(lm, *HINGE[1])), F.lit(105.0))
    parts = g.base_signals(lm) | {"flat": g.torso_horizontal(lm), "open": hips, "bent": g.knee_flexion_score(lm)}
    d = frames.select(*frames.columns, *[c.alias(f"_g_{n}") for n, c in parts.items()])
    action, family, quality = F.col("action_type"), F.col("family"), F.col("quality")
    s = {n: F.col(f"_g_{n}") for n in parts}
    ramp = lambda v, lo, span: clamp((v - lo) / span)
    out = (
        F.when(action == "bench_press", s["flat"])
        .when(action.isin("lat_pulldown", "single_arm_pulldown", "single_arm_hammer_row", "chest_supported_row", "plate_loaded_pulldown"), ramp(s["elbow"], 8.0, 75.0))
        .when(action == "hip_thrust", ramp(180.0 - s["hip"], 105.0, 55.0))
        .when(action == "plate_loaded_rear_leg_raise", ramp(s["open"], 105.0, 55.0))
        .when(action == "preacher_curl", ramp(s["elbow"], 8.0, 85.0))
        .when(action == "y_raise", ramp(s["shoulder"], 35.0, 85.0))
        .when(action == "machine_crunch", ramp(s["lean"], 8.0, 55.0))
        .when(action.isin("standing_hip_abduction", "seated_hip_abduction"), ramp(s["apart"], 20.0, 90.0))
        .when(family.isin("hinge", "pull"), ramp(s["lean"], 18.0, 42.0))
        .when(family.isin("squat", "isolation_knee", "isolation_hip"), s["bent"])
        .when(family.isin("press", "isolation_elbow"), ramp(s["elbow"], 8.0, 55.0))
        .when(family == "isolation_shoulder", ramp(s["shoulder"], 8.0, 55.0))
        .otherwise(quality)
    )
    return d.select(*frames.columns, (out * clamp((quality - 0.18) / 0.52)).alias("posture"))


def active_window(frames: DataFrame, fps: float, signal: str = "raw_signal", keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Start and end pose index of the active training window with its reason.

    Frames carry ``landmarks``, ``quality``, ``action_type``, ``family``, the raw
    motion ``signal``, ``pose_idx``, ``n`` and ``time_ms``.
    """
    keys = list(keys)
    action, family = F.col("action_type"), F.col("family")
    d = materialise(with_posture(tracking_quality(frames, keys)).drop("landmarks"))
    d = motion_energy(d, keys, signal, fps, "motion")
    wp, wm = F.lit(0.58), F.lit(0.42)
    for weights, col in ((FAMILY_WEIGHTS, family), (ACTION_WEIGHTS, action)):
        for name, (p, m) in weights.items():
            wp, wm = F.when(col == name, p).otherwise(wp), F.when(col == name, m).otherwise(wm)
    gate = F.when((action == "bench_press") & (F.col("posture") < 0.16), 0.35).otherwise(1.0)
    raw = (wp * F.col("posture") * F.col("tracking") + wm * F.col("motion") * F.col("tracking")) * gate
    d = materialise(smooth(d.withColumn("_raw", raw), keys, "_raw", odd_window(fps * 0.45), "activity"))
    head = [*keys, "n", "action_type", "family"]
    q = quantiles(d, head, {"p60": ("activity", 0.6), "hi": (signal, 0.95), "lo": (signal, 0.05), "tmid": ("tracking", 0.5)})
    ends = d.groupBy(*head).agg(F.max("activity").alias("top"), F.min("time_ms").alias("t0"), F.max("time_ms").alias("t1"))
    stats = ends.join(q, head).withColumn("span", F.greatest(F.lit(1e-6), F.col("hi") - F.col("lo")))
    stats = materialise(stats.withColumn("cut", F.greatest(F.lit(0.20), F.least(F.col("top") * 0.58, F.col("p60") * 0.85))))
    rows = spread_join(d, stats.select(*keys, "n", "cut", "span"), keys)
    seg = islands(rows, keys, max(1, int(fps * 0.8)), F.col("activity") >= F.col("cut"))
    size = seg.groupBy(*keys, "n", "island", "span").agg(F.min("pose_idx").alias("s"), F.max("pose_idx").alias("e"), F.min("time_ms").alias("ts"))
    size = size.where(F.col("e") - F.col("s") + 1 >= max(6, int(fps * 1.2)))
    # means and ranges run over the whole stretch, gaps included
    from cadenza.core.rangejoin import range_join

    inside = range_join(rows.select(*keys, "n", "pose_idx", "activity", F.col(signal).alias("_sig")), size.drop("n"), keys, "pose_idx", "s", "e", 256, "inner")
    group = [*keys, "n", "island", "span", "s", "e"]
    mean = inside.groupBy(*group).agg(F.avg("activity").alias("mean"))
    rng = quantiles(inside, group, {"_h": ("_sig", 0.95), "_l": ("_sig", 0.05)})
    c = mean.join(rng, group)
    worth = (F.col("e") - F.col("s") + 1) * (0.72 * F.col("mean") + 0.28 * clamp((F.col("_h") - F.col("_l")) / F.col("span")))
    best = c.groupBy(*keys, "n").agg(F.min(F.struct((-worth).alias("o"), "s", "e", "mean")).alias("b"))
    best = materialise(best)
    calm = reliable_window(d, fps, keys).select(*keys, "n", F.struct(F.col("start_idx").alias("s"), F.col("end_idx").alias("e"), "trimmed").alias("r"))
    flexed = F.lit(None).cast("double")
    for name, limit in ELBOW_PHASE.items():
        flexed = F.when(action == name, limit).otherwise(flexed)
    arm = d.withColumn("_flexed_at", flexed).where(F.col("_flexed_at").isNotNull() & (F.col("n") >= 4))
    arm = smooth(arm, keys, signal, odd_window(fps * 0.25), "_phase")
    turns = cycles_or_partial(arm, keys, "_phase", fps, 135.0, "_flexed_at")
    turns = turns.groupBy(*keys, "n").agg(F.min_by("start_idx", "rep_index").alias("ps"), F.max_by("end_idx", "rep_index").alias("pe"))
    w = stats.join(best, [*keys, "n"], "left").join(calm, [*keys, "n"], "left").join(turns, [*keys, "n"], "left")
    last, zero = F.col("n") - 1, F.lit(0).cast("long")
    box = lambda s, e, why, conf: F.struct(s.cast("long").alias("start_idx"), e.cast("long").alias("end_idx"), why.alias("reason"), rnd(conf, 3).alias("confidence"))
    top = F.col("top")
    fall = lambda why: F.when(F.col("r.trimmed"), box(F.col("r.s"), F.col("r.e"), F.lit("target_tracking_quality_trim"), top)).otherwise(box(zero, last, F.lit(why), top))
    pad_arm, pad = max(1, int(fps * 0.45)), max(1, int(fps * 0.75))
    clip = lambda s, e, p: (F.greatest(F.lit(0), s - p), F.least(last, e + p))
    as_, ae = clip(F.col("ps"), F.when(F.col("pe") == 0, last).otherwise(F.col("pe")), pad_arm)
    bs, be = clip(F.col("b.s"), F.col("b.e"), pad)
    step = (F.col("t1") - F.col("t0")) / F.greatest(F.lit(1), last)
    share = (be - bs) * step / F.greatest(F.lit(1e-3), F.col("t1") - F.col("t0"))
    whole = (share > 0.92) | ((bs < int(fps)) & (last - be < int(fps)))
    full = F.lit(None).cast("double")
    for name, limit in FULL_SIGNAL.items():
        full = F.when(action == name, limit).otherwise(full)
    result = (
        F.when(F.col("n") < max(8, int(fps * 1.5)), box(zero, last, F.lit("too_few_pose_frames"), F.lit(0.0)))
        .when(F.col("ps").isNotNull() & (ae > as_), box(as_, ae, F.lit("elbow_turning_points"), F.col("tmid")))
        .when(top < 0.18, fall("insufficient_activity_contrast"))
        .when((F.col("span") >= full) & (F.col("tmid") >= 0.72), box(zero, last, F.lit("full_primary_signal"), top))
        .when(F.col("b").isNull(), fall("no_stable_active_segment"))
        .when(whole, box(zero, last, F.lit("full_video_active"), F.col("b.mean")))
        .otherwise(box(bs, be, F.lit("active_segment"), F.col("b.mean")))
    )
    return w.select(*head, result.alias("w")).select(*head, "w.*")


def event_confidence(reps: DataFrame, frames: DataFrame, keys: Sequence[str], sides: Sequence[Column]) -> DataFrame:
    """Mean confidence over the key frame and its neighbours per side and the best
    side (the first on ties); the neighbourhood clips at the ends by itself."""
    keys = list(keys)
    around = F.explode(F.array(*[F.struct((F.col("key_idx") + k).alias("pose_idx")) for k in (-1, 0, 1)])).alias("w")
    near = reps.select(*keys, "rep_index", around).select(*keys, "rep_index", "w.pose_idx")
    conf = frames.select(*keys, "pose_idx", *[c.alias(f"c{i}") for i, c in enumerate(sides)])
    m = near.join(conf, [*keys, "pose_idx"]).groupBy(*keys, "rep_index").agg(*[rnd(F.avg(f"c{i}"), 3).alias(f"conf_{i}") for i in range(len(sides))])
    top = F.greatest(*[F.col(f"conf_{i}") for i in range(len(sides))]) if len(sides) > 1 else F.col("conf_0")
    best = F.lit(len(sides) - 1)
    for i in range(len(sides) - 2, -1, -1):
        best = F.when(F.col(f"conf_{i}") == top, i).otherwise(best)
    return reps.join(m.withColumn("best_side", best).withColumn("best_confidence", top), [*keys, "rep_index"], "left")
