"""Summaries, measurement rows, working side, signatures and trend fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.layout import over_neighbours, spread_join
from cadenza.core.num import clamp, finite, odd_window, rnd
from cadenza.core.quantiles import quantiles
from cadenza.functions import geometry as g
from cadenza.functions.dims import LOWER_BODY, MATCH_FAMILIES, UPPER_BODY, family_group
from cadenza.functions.landmarks import (
    ARM, HINGE, JOINTS, LA, LE, LEG, LH, LK, LS, LW, METRIC_CHAINS, POSE_FLOOR, RA, RE, RH, RK, RS, RW,
)
from cadenza.operators.peaks import detect_repetitions
from cadenza.operators.smoothing import smooth


def numeric_summary(df: DataFrame, keys: Sequence[str], value: str, digits: int = 3) -> DataFrame:
    """Count, extremes, mean and percentiles of the finite values per key; a key
    without any keeps count 0 and NULLs."""
    keys = list(keys)
    v = finite(F.col(value))
    df = df.withColumn(value, v)
    base = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean")
    )
    q = quantiles(df, keys, {"p05": (value, 0.05), "median": (value, 0.5), "p95": (value, 0.95)})
    cols = ["min", "max", "mean", "p05", "median", "p95"]
    out = base.join(q, keys, "left")
    return out.select(
        *keys, "count", *[rnd(c, digits).alias(c) for c in cols], rnd(F.col("p95") - F.col("p05"), digits).alias("range")
    )


def robust_range(df: DataFrame, keys: Sequence[str], value: str, fallback: float = 0.0) -> DataFrame:
    q = quantiles(df, keys, {"_hi": (value, 0.95), "_lo": (value, 0.05)})
    mean = df.groupBy(*keys).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias("_mean"))
    fb = F.lit(float(fallback))
    return mean.join(q, list(keys), "left").select(
        *keys, F.coalesce(F.col("_hi") - F.col("_lo"), fb).alias("range"), F.coalesce("_mean", fb).alias("mean")
    )


# ---- measurement row ---------------------------------------------------------------


def measurement_series(lm: Column) -> dict[str, Column]:
    """Per-frame kinematic series of one skeleton."""
    width = F.greatest(F.lit(0.03), g.distance(lm, LS, RS))
    torso_x = (g.mid(lm, LS, RS, "x") + g.mid(lm, LH, RH, "x")) / 2.0
    out: dict[str, Column] = {}
    chains = {"Knee": LEG, "Elbow": ARM, "Shoulder": g.SHOULDER_SIDES, "Hip": HINGE}
    for name, sides in chains.items():
        for label, side in zip(("left", "right"), sides):
            out[f"{label}{name}Angle"] = g.joint_angle(lm, *side)
    out["trunkLean"] = g.trunk_lean(lm)
    out["torsoX"] = torso_x
    feet = (g.at(lm, LA, "x") + g.at(lm, RA, "x")) / 2.0
    out["torsoSupportOffsetX"] = F.when(g.chain_min(lm, (LA, RA)) >= POSE_FLOOR, torso_x - feet)
    for label, (s, e, w, a) in {"left": (LS, LE, LW, LA), "right": (RS, RE, RW, RA)}.items():
        out[f"{label}AnkleX"] = g.at(lm, a, "x")
        out[f"{label}WristStack"] = F.abs(g.at(lm, w, "x") - g.at(lm, e, "x")) / width
        out[f"{label}ElbowHeight"] = g.at(lm, e, "y") - g.at(lm, s, "y")
        out[f"{label}WristAboveShoulder"] = g.at(lm, s, "y") - g.at(lm, w, "y")
    out["hipDepth"] = g.mid(lm, LH, RH, "y") - g.mid(lm, LK, RK, "y")
    out["shoulderWidth"] = width
    return out


def measurements(frames: DataFrame, key_times: DataFrame | None = None, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """One wide row per video.  ``key_times`` holds the key time of each counted
    repetition (``key_ms`` with ``rep_index``) for the tempo columns."""
    keys = list(keys)
    series = measurement_series(F.col("landmarks"))
    rows = frames.select(*keys, "n", *[c.alias(k) for k, c in series.items()])
    sides = ("left", "right")
    specs: dict[str, tuple[str, float]] = {}
    for s in sides:
        for joint in ("Knee", "Elbow", "Hip"):
            specs[f"_{s}{joint}Min"] = (f"{s}{joint}Angle", 0.05)
        for joint in ("Elbow", "Shoulder", "Hip"):
            specs[f"_{s}{joint}Max"] = (f"{s}{joint}Angle", 0.95)
        specs[f"_{s}Above"] = (f"{s}WristAboveShoulder", 0.95)
    for c in ("trunkLean", "torsoX", "torsoSupportOffsetX", "leftAnkleX", "rightAnkleX"):
        specs[f"_{c}Hi"], specs[f"_{c}Lo"] = (c, 0.95), (c, 0.05)
    specs |= {"_leanMid": ("trunkLean", 0.5), "_depth": ("hipDepth", 0.95), "_width": ("shoulderWidth", 0.5)}
    q = quantiles(rows, [*keys, "n"], specs)
    means = rows.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in ("leftWristStack", "rightWristStack", "leftElbowHeight", "rightElbowHeight")],
        *[F.count(c).alias(f"_c_{c}") for c in ("leftWristStack", "rightWristStack", "leftElbowHeight", "rightElbowHeight")],
    )
    wide = q.join(means, keys)
    val = lambda c, fb: F.coalesce(F.col(c), F.lit(float(fb)))
    lo = lambda s, j: val(f"_{s}{j}Min", 180.0)
    hi = lambda s, j: val(f"_{s}{j}Max", 0.0)
    rng = lambda c: val(f"_{c}Hi", 0) - val(f"_{c}Lo", 0)
    width = F.greatest(F.lit(0.03), val("_width", 0.2))
    pair_mean = lambda a, b: F.coalesce((F.col(f"_s_{a}") + F.col(f"_s_{b}")) / (F.col(f"_c_{a}") + F.col(f"_c_{b}")), F.lit(0.0))
    out = {
        "leftKneeAngleMin": (lo("left", "Knee"), 1), "rightKneeAngleMin": (lo("right", "Knee"), 1),
        "kneeAngleAsymmetry": (F.abs(lo("left", "Knee") - lo("right", "Knee")), 1),
        "leftElbowAngleMin": (lo("left", "Elbow"), 1), "rightElbowAngleMin": (lo("right", "Elbow"), 1),
        "leftElbowAngleMax": (hi("left", "Elbow"), 1), "rightElbowAngleMax": (hi("right", "Elbow"), 1),
        "elbowAngleRange": (F.greatest(F.lit(0.0), hi("left", "Elbow") - lo("left", "Elbow"), hi("right", "Elbow") - lo("right", "Elbow")), 1),
        "elbowAngleAsymmetry": (F.abs(lo("left", "Elbow") - lo("right", "Elbow")), 1),
        "leftShoulderAngleMax": (hi("left", "Shoulder"), 1), "rightShoulderAngleMax": (hi("right", "Shoulder"), 1),
        "shoulderAngleMax": (F.greatest(hi("left", "Shoulder"), hi("right", "Shoulder")), 1),
        "shoulderAngleAsymmetry": (F.abs(hi("left", "Shoulder") - hi("right", "Shoulder")), 1),
        "leftHipAngleMin": (lo("left", "Hip"), 1), "rightHipAngleMin": (lo("right", "Hip"), 1),
        "leftHipAngleMax": (hi("left", "Hip"), 1), "rightHipAngleMax": (hi("right", "Hip"), 1),
        "hipAngleMax": (F.greatest(hi("left", "Hip"), hi("right", "Hip")), 1),
        "hipAngleAsymmetry": (F.abs(lo("left", "Hip") - lo("right", "Hip")), 1),
        "trunkLeanMedian": (val("_leanMid", 0), 1), "trunkLeanMax": (val("_trunkLeanHi", 0), 1), "trunkLeanRange": (rng("trunkLean"), 1),
        "torsoSwayRatio": (rng("torsoX") / width, 3), "torsoSupportSwayRatio": (rng("torsoSupportOffsetX") / width, 3),
        "footMovementRatio": (F.greatest(rng("leftAnkleX"), rng("rightAnkleX")) / width, 3),
        "wristStackOffset": (pair_mean("leftWristStack", "rightWristStack"), 3),
        "elbowHeightMedian": (pair_mean("leftElbowHeight", "rightElbowHeight"), 3),
        "wristAboveShoulderMax": (F.greatest(val("_leftAbove", 0), val("_rightAbove", 0)), 3),
        "hipDepthMax": (val("_depth", 0), 3),
    }
    row = wide.select(*keys, "n", *[rnd(c, digits).alias(k) for k, (c, digits) in out.items()])
    if key_times is None:
        return row
    return row.join(tempo(key_times, keys), keys, "left")


def tempo(key_times: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the time between key frames, in seconds."""
    nxt = key_times.select(*keys, (F.col("rep_index") - 1).alias("rep_index"), F.col("key_ms").alias("_next"))
    gaps = key_times.join(nxt, [*keys, "rep_index"]).withColumn("_gap", (F.col("_next") - F.col("key_ms")) / 1000.0)
    deviation = F.when(F.count("_gap") > 1, rnd(F.stddev_pop("_gap"), 2))
    return gaps.groupBy(*keys).agg(rnd(F.avg("_gap"), 2).alias("averageRepSeconds"), deviation.alias("repTempoVariation"))


def metric_confidence_summary(frames: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """25th percentile of each metric confidence per video."""
    lm = F.col("landmarks")
    rows = frames.select(*keys, "n", *[g.metric_conf(lm, m).alias(m) for m in METRIC_CHAINS])
    q = quantiles(rows, [*keys, "n"], {f"conf_{m}": (m, 0.25) for m in METRIC_CHAINS})
    return q.select(*keys, *[rnd(f"conf_{m}", 3).alias(m) for m in METRIC_CHAINS])


# ---- working side ------------------------------------------------------------------

# per variant: (confidence chain, angle chain, second series) for the left side; the
# right side uses the mirrored slots
_MIRROR = {LS: RS, LE: RE, LW: RW, LH: RH, LK: RK, LA: RA}


def _mirror(chain: Sequence[int], left: bool) -> tuple[int, ...]:
    return tuple(chain) if left else tuple(_MIRROR[i] for i in chain)


def _side_sample(lm: Column, left: bool, conf: Sequence[int], angle: Sequence[int] | None, extra: tuple[int, str] | None,
                 min_conf: float, rise_chain: Sequence[int], rise_conf: float) -> dict[str, Column]:
    """Confidence, angle and a coordinate of one side of a frame."""
    c = g.chain_min(lm, _mirror(conf, left))
    a = g.joint_angle(lm, *_mirror(angle, left)) if angle else F.lit(0.0)
    ok = (c >= min_conf) & a.isNotNull()
    e = g.at(lm, _mirror((extra[0],), left)[0], extra[1]) if extra else F.lit(0.0)
    shoulder, wrist = _mirror((LS,), left)[0], _mirror((LW,), left)[0]
    rise = g.at(lm, shoulder, "y") - g.at(lm, wrist, "y")
    shown = g.chain_min(lm, _mirror(rise_chain, left)) >= rise_conf
    return {"side": F.lit("left" if left else "right"), "c": F.when(ok, c), "a": F.when(ok, a), "e": F.when(ok, e),
            "rise": F.when(shown, rise), "raw_c": c}


def side_samples(frames: DataFrame, keys: Sequence[str], conf: Sequence[int], angle: Sequence[int] | None,
                 extra: tuple[int, str] | None, min_conf: float = 0.12,
                 rise_chain: Sequence[int] = (LS, LW), rise_conf: float = 0.45) -> DataFrame:
    """Two rows per frame (left, right) with confidence, angle and a coordinate;
    measurable samples only carry values."""
    def one(left: bool) -> Column:
        sample = _side_sample(F.col("landmarks"), left, conf, angle, extra, min_conf, rise_chain, rise_conf)
        return F.struct(*[c.alias(name) for name, c in sample.items()])

    return frames.select(*keys, "n", F.explode(F.array(one(True), one(False))).alias("s")).select(*keys, "n", "s.*")


# Confidence chain, angle chain and second series of each variant, for the left side.
SIDE_SHAPES = {
    "pulldown": ((LS, LE, LW), (LS, LE, LW), (LE, "y")),
    "row": ((LS, LE, LW), (LS, LE, LW), (LW, "x")),
    "rear_leg": ((LS, LH, LK), (LS, LH, LK), None),
    "press": ((LS, LE, LW), None, None),
    "y_raise": ((LH, LS, LE), (LH, LS, LE), None),
}


def working_side(frames: DataFrame, variant: str, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Score both sides and choose one.

    Variants: ``pulldown``, ``row``, ``rear_leg``, ``press``, ``y_raise``.  The
    right side has to be strictly better; for press and y_raise ties the same.
    """
    return working_sides(frames, [variant], keys).drop("variant")


def working_sides(frames: DataFrame, variants: Sequence[str], keys: Sequence[str] = ("video_id",),
                  wanted: str | None = None, lm: g.Points | None = None) -> DataFrame:
    """``working_side`` for several variants in one pass over the frames, a row
    per series and ``variant``; ``wanted`` names an array column with the
    variants of the row's series, without it every series gets all."""
    keys = list(keys)
    lm = F.col("landmarks") if lm is None else lm
    columns: list[Column] = []
    samples: list[Column] = []
    for variant in variants:
        rise = ((LH, LS, LE, LW), 0.35) if variant == "y_raise" else ((LS, LW), 0.45)
        for left in (True, False):
            s = _side_sample(lm, left, *SIDE_SHAPES[variant], 0.12, *rise)
            f = F.lit(180.0) - s["a"] if variant in ("pulldown", "row") else s["a"]
            values = {"c": s["raw_c" if variant == "press" else "c"], "f": f, "e": s["e"], "rise": s["rise"]}
            names = {name: f"_s{len(samples)}_{name}" for name in values}
            columns += [values[name].alias(column) for name, column in names.items()]
            samples.append(F.struct(
                F.lit(variant).alias("variant"), s["side"].alias("side"), *[F.col(column).alias(name) for name, column in names.items()]))
    asked = [wanted] if wanted else []
    s = frames.select(*keys, "n", *asked, *columns).select(*keys, "n", *asked, F.explode(F.array(*samples)).alias("s"))
    if wanted:
        s = s.where(F.array_contains(wanted, F.col("s.variant")))
    s = s.select(*keys, "n", "s.*")
    low_of = lambda v: (0.10, "lo10") if v == "y_raise" else (0.05, "lo")
    lows = {name: ("f", p) for p, name in sorted({low_of(v) for v in variants})}
    by = [*keys, "n", "variant", "side"]
    q = quantiles(s, by, {"conf": ("c", 0.25), "hi": ("f", 0.95), **lows, "ehi": ("e", 0.95), "elo": ("e", 0.05), "above": ("rise", 0.80)})
    counts = s.groupBy(*by).agg(F.count("f").alias("_valid"))
    q = counts.join(q, by, "left")
    z = lambda c, fb=0.0: F.coalesce(F.col(c), F.lit(fb))

    def of_variant(make) -> Column:
        """The column that ``make`` gives for the row's variant."""
        out = make(variants[-1])
        for v in variants[:-1]:
            out = F.when(F.col("variant") == v, make(v)).otherwise(out)
        return out

    conf, erng = z("conf"), z("ehi") - z("elo")
    ratio = F.col("_valid") / F.greatest(F.lit(1), F.col("n"))

    def spread(v: str) -> Column:
        low = low_of(v)[1]
        return F.greatest(F.lit(0.0), z("hi") - z(low, 180.0)) if v == "rear_leg" else z("hi") - z(low)

    def score(v: str) -> Column:
        rng = spread(v)
        if v == "press":
            return conf
        return rnd({
            "pulldown": conf * (rng + erng * 120.0),
            "row": conf * (rng + erng * 160.0),
            "rear_leg": conf * (rng + F.greatest(F.lit(0.0), z("hi") - 118.0) * 0.25),
            "y_raise": F.greatest(F.lit(0.0), rng) * clamp(ratio / 0.55) * F.greatest(F.lit(0.2), conf)
            + F.greatest(F.lit(0.0), z("hi") - 80.0) * 0.15 + F.greatest(F.lit(0.0), z("above")) * 20.0,
        }[v], 3)

    sides = q.select(
        *by, of_variant(score).alias("score"), rnd(conf, 3).alias("confidence"),
        of_variant(lambda v: rnd(spread(v), 3)).alias("range"), rnd(z("hi"), 3).alias("peak"), rnd(erng, 3).alias("extra_range"),
        rnd(ratio, 3).alias("valid_ratio"), rnd(z("above"), 3).alias("wrist_above"),
    )
    best = F.min(F.struct((-F.col("score")).alias("o"), "side", "confidence", "range", "peak", "extra_range", "valid_ratio", "wrist_above"))
    out = sides.groupBy(*keys, "n", "variant").agg(best.alias("b"), F.min("score").alias("_other"))
    chosen = out.select(*keys, "n", "variant", "b.side", (-F.col("b.o")).alias("score"), "b.confidence", "b.range", "b.peak", "b.extra_range",
                        "b.valid_ratio", "b.wrist_above", "_other")
    lead = F.greatest(F.lit(0.0), F.col("score") - F.col("_other")) / F.greatest(F.lit(30.0), F.col("score"))
    led = rnd(clamp(F.col("confidence") * 0.45 + F.col("valid_ratio") * 0.35 + lead * 0.20), 3)
    return chosen.withColumn("confidence", of_variant(lambda v: led if v == "y_raise" else F.col("confidence"))).drop("_other")


def axis_range(frames: DataFrame, slots: dict[str, tuple[int, str]], keys: Sequence[str] = ("video_id",),
               min_vis: float = 0.45) -> DataFrame:
    """p95 - p5 of a coordinate over the visible frames, 0 with fewer than three;
    plus the 80th percentile of the wrist height above the shoulder."""
    lm = F.col("landmarks")
    cols = {k: F.when(lm[s]["vis"] >= min_vis, lm[s][axis]) for k, (s, axis) in slots.items()}
    rows = frames.select(*keys, "n", *[c.alias(k) for k, c in cols.items()])
    specs = {f"{k}_{e}": (k, p) for k in slots for e, p in (("hi", 0.95), ("lo", 0.05))}
    q = quantiles(rows, [*keys, "n"], specs)
    seen = rows.groupBy(*keys).agg(*[F.count(k).alias(f"{k}_c") for k in slots])
    return seen.join(q, list(keys), "left").select(
        *keys, *[F.when(F.col(f"{k}_c") >= 3, F.col(f"{k}_hi") - F.col(f"{k}_lo")).otherwise(0.0).alias(k) for k in slots]
    )


def wrist_above_score(frames: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    s = side_samples(frames, keys, (LS, LE, LW), None, None)
    q = quantiles(s, [*keys, "n"], {"wrist_above": ("rise", 0.80)})
    return frames.select(*keys).distinct().join(q.drop("n"), list(keys), "left").select(
        *keys, F.coalesce("wrist_above", F.lit(0.0)).alias("wrist_above")
    )


# ---- movement signature ------------------------------------------------------------


def family_profile(frames: DataFrame, fps: float, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Range and repetition count of every candidate family per video."""
    keys = list(keys)
    lm = F.col("landmarks")
    base = g.base_signals(lm)
    rows = frames.where("n >= 8").select(*keys, "pose_idx", "n", *[base[b].alias(b) for b in set(g.SIGNAL_OF[f] for f in MATCH_FAMILIES)])
    pairs = [F.struct(F.lit(f).alias("family"), F.col(g.SIGNAL_OF[f]).alias("v")) for f in MATCH_FAMILIES]
    rows = rows.select(*keys, "pose_idx", "n", F.explode(F.array(*pairs)).alias("p"))
    rows = rows.select(*keys, "p.family", "pose_idx", "n", "p.v")
    series = [*keys, "family"]
    sm = smooth(rows, series, "v", odd_window(fps * 0.25), "s")
    q = quantiles(sm, [*series, "n"], {"hi": ("s", 0.95), "lo": ("s", 0.05)})
    tops = detect_repetitions(sm, series, "s", fps).groupBy(*series).agg(F.count(F.lit(1)).alias("reps"))
    known = F.when(F.col("n") >= max(6, int(fps * 2)), rnd(F.col("hi") - F.col("lo"), 1)).otherwise(0.0)
    return q.join(tops, series, "left").select(*keys, "family", "n", known.alias("range"), F.coalesce("reps", F.lit(0)).alias("reps"))


def movement_signature(profile: DataFrame, preferred: Column | None = None, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Detected family (largest range, first by name on ties; a preferred family
    within max(1, 3 %) wins) with a confidence from the gap to the second."""
    keys = list(keys)
    p = profile.withColumn("_pref", preferred if preferred is not None else F.lit(None).cast("string"))
    lower, upper = F.col("family").isin(LOWER_BODY), F.col("family").isin(UPPER_BODY)
    best = F.min(F.struct((-F.col("range")).alias("r"), F.col("family").alias("f")))
    agg = p.groupBy(*keys, "n").agg(
        best.alias("b"),
        F.max(F.when(F.col("family") == F.col("_pref"), F.struct(F.col("family").alias("f"), F.col("range").alias("r")))).alias("pref"),
        F.max(F.when(lower, F.col("range"))).alias("lower_range"), F.max(F.when(upper, F.col("range"))).alias("upper_range"),
        F.max(F.when(F.col("family") == "hinge", F.col("reps"))).alias("hinge_reps"),
        F.array_sort(F.collect_list(F.struct((-F.col("range")).alias("r"), F.col("family").alias("f")))).alias("_all"),
    )
    top = -F.col("b.r")
    close = F.col("pref").isNotNull() & (F.abs(F.col("pref.r") - top) <= F.greatest(F.lit(1.0), top * 0.03))
    family = F.when(close, F.col("pref.f")).otherwise(F.col("b.f"))
    peak = F.when(close, F.col("pref.r")).otherwise(top)
    agg = agg.withColumn("family", family).withColumn("peak", peak)
    second = F.coalesce(-F.filter("_all", lambda x: x["f"] != F.col("family"))[0]["r"], F.lit(0.0))
    conf = F.least(F.lit(0.98), F.greatest(F.lit(0.0), (F.col("peak") - second) / F.greatest(F.lit(8.0), F.col("peak"))))
    return agg.select(*keys, "n", "family", family_group(F.col("family")).alias("body_group"), "peak", rnd(conf, 3).alias("confidence"),
                      "lower_range", "upper_range", "hinge_reps")


# ---- fixed foot anchors ------------------------------------------------------------


def body_scale(frames: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    lm = F.col("landmarks")
    w = F.when(g.chain_min(lm, (LS, RS)) >= 0.35, g.distance(lm, LS, RS))
    q = quantiles(frames.select(*keys, "n", w.alias("w")), [*keys, "n"], {"m": ("w", 0.5)})
    return q.select(*keys, "n", F.greatest(F.lit(0.06), F.coalesce("m", F.lit(0.18))).alias("body_scale"))


def foot_anchors(frames: DataFrame, action: str, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Median ankle position per side when enough steady candidates exist."""
    keys = list(keys)
    lm = F.col("landmarks")
    min_ankle = 0.48 if action == "hip_thrust" else 0.32

    def one(label: str, hip: int, knee: int, ankle: int) -> Column:
        hk, ka = g.distance(lm, hip, knee), g.distance(lm, knee, ankle)
        odd = (lm[hip]["vis"] >= 0.35) & (hk >= 0.035) & ((ka < hk * 0.28) | (ka > hk * 2.25))
        ok = (lm[ankle]["vis"] >= min_ankle) & (lm[knee]["vis"] >= 0.35) & (lm[ankle]["y"] + 0.04 >= lm[knee]["y"]) & ~odd
        return F.struct(F.lit(label).alias("side"), F.when(ok, lm[ankle]["x"]).alias("x"), F.when(ok, lm[ankle]["y"]).alias("y"),
                        F.when(ok, lm[ankle]["vis"]).alias("v"))

    rows = frames.select(*keys, "n", F.explode(F.array(one("left", LH, LK, LA), one("right", RH, RK, RA))).alias("s")).select(*keys, "n", "s.*")
    q = quantiles(rows, [*keys, "n", "side"], {
        "ax": ("x", 0.5), "ay": ("y", 0.5), "av": ("v", 0.5), "x9": ("x", 0.9), "x1": ("x", 0.1), "y9": ("y", 0.9), "y1": ("y", 0.1)})
    seen = rows.groupBy(*keys, "n", "side").agg(F.count("x").alias("candidates"))
    d = seen.join(q, [*keys, "n", "side"], "left").join(body_scale(frames, keys), [*keys, "n"])
    need = F.greatest(F.lit(3), F.least(F.lit(8), F.floor(F.col("n") / 4)))
    spread = F.greatest(F.col("x9") - F.col("x1"), F.col("y9") - F.col("y1")) / F.col("body_scale")
    limit = 0.68 if action == "hack_squat" else 0.42
    ok = F.coalesce((F.col("candidates") >= need) & (spread <= limit), F.lit(False))
    return d.select(
        *keys, "side", "candidates", ok.alias("accepted"), rnd(F.when(F.col("candidates") >= need, spread), 3).alias("spread_ratio"),
        F.when(ok, F.col("ax")).alias("anchor_x"), F.when(ok, F.col("ay")).alias("anchor_y"),
        F.when(ok, clamp(F.col("av"), 0.68, 0.94)).alias("anchor_conf"),
    )


# ---- engine comparison -------------------------------------------------------------


def joint_angles_long(frames: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    lm = F.col("landmarks")
    pairs = F.array(*[F.struct(F.lit(j).alias("joint"), g.tracked_joint(lm, j).alias("angle")) for j in JOINTS])
    return frames.select(*keys, "frame_index", F.explode(pairs).alias("p")).select(*keys, "frame_index", "p.*").where(
        F.col("angle").isNotNull()
    )


def engine_deltas(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Absolute joint-angle difference of two engines on shared frames."""
    left = joint_angles_long(a, keys)
    right = joint_angles_long(b, keys).withColumnRenamed("angle", "_other")
    return left.join(right, [*keys, "joint", "frame_index"]).select(
        *keys, "joint", "frame_index", F.abs(F.col("angle") - F.col("_other")).alias("delta")
    )


def joint_delta_summary(deltas: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    group = [*keys, "joint"]
    q = quantiles(deltas, group, {"median": ("delta", 0.5), "p95": ("delta", 0.95)})
    base = deltas.groupBy(*group).agg(F.count(F.lit(1)).alias("count"), F.avg("delta").alias("mean"))
    return base.join(q, group).select(
        *group, "count", rnd("mean", 2).alias("mean_abs"), rnd("median", 2).alias("median_abs"), rnd("p95", 2).alias("p95_abs")
    )


def top_divergent(summary: DataFrame, keys: Sequence[str] = ("video_id",), k: int = 5) -> DataFrame:
    """At most eight joints per video are ranked."""
    w = Window.partitionBy(*keys).orderBy(F.desc("median_abs"), F.desc("mean_abs"), F.desc("p95_abs"), "joint")
    return summary.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- trend and noise ---------------------------------------------------------------


def coupling_fit(df: DataFrame, keys: Sequence[str], angle: str, motion: str, confidence: str,
                 floor: float = POSE_FLOOR) -> DataFrame:
    """Slope and intercept of an angle on the normalised motion over confident
    rows; NULL with fewer than five of them or a flat motion."""
    keys = list(keys)
    q = quantiles(df, [*keys, "n"], {"_hi": (motion, 0.95), "_lo": (motion, 0.05), "_mid": (motion, 0.5)})
    q = q.select(*keys, "n", (F.col("_hi") - F.col("_lo")).alias("motion_span"), F.col("_mid").alias("motion_median"))
    d = spread_join(df, q, keys)
    x = (F.col(motion) - F.col("motion_median")) / F.col("motion_span")
    ok = (F.col(confidence) >= floor) & (F.col("motion_span") > 1e-4)
    y = F.when(ok, F.col(angle))
    fit = d.groupBy(*keys, "n", "motion_span", "motion_median").agg(
        F.count(y).alias("_ok"), F.regr_slope(y, F.when(ok, x)).alias("_slope"), F.regr_intercept(y, F.when(ok, x)).alias("_icpt")
    )
    enough = F.col("_ok") >= 5
    return fit.select(*keys, "n", "motion_span", "motion_median", F.when(enough, F.col("_slope")).alias("slope"),
                      F.when(enough, F.col("_icpt")).alias("intercept"))


def noise_threshold(df: DataFrame, keys: Sequence[str], values: dict[str, tuple[str, float]]) -> DataFrame:
    """``out -> (column, base)``: max(base, 3.5 x median absolute step / .6745)."""
    keys = list(keys)
    steps = over_neighbours(
        df, keys, {f"_s_{o}": (lambda c: lambda w: F.abs(F.col(c) - F.lag(c).over(w)))(c) for o, (c, _) in values.items()}, 1, 0
    )
    q = quantiles(steps, [*keys, "n"], {f"_m_{o}": (f"_s_{o}", 0.5) for o in values})
    base = df.select(*keys, "n").distinct().join(q, [*keys, "n"], "left")
    noise = {o: F.coalesce(F.col(f"_m_{o}"), F.lit(0.0)) / 0.6745 for o in values}
    return base.select(*keys, "n", *[noise[o].alias(f"{o}_noise") for o in values],
                       *[F.greatest(F.lit(float(b)), noise[o] * 3.5).alias(o) for o, (_, b) in values.items()])
