"""Trunk stability judged frame by frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.layout import over_neighbours, scan, spread_join
from cadenza.core.num import rnd
from cadenza.core.quantiles import quantiles
from cadenza.core.session import materialise
from cadenza.functions import geometry as g
from cadenza.functions.dims import STABILITY_VIEWS
from cadenza.functions.landmarks import LH, LS, POSE_FLOOR, RH, RS, TRUNK
from cadenza.operators.measure import coupling_fit, noise_threshold
from cadenza.operators.smoothing import baseline_window, interpolate, smooth_many


def hysteresis(df: DataFrame, keys: Sequence[str], state: str = "state", score: str = "score",
               recovery: Column | int = 2) -> DataFrame:
    """Recovery after unstable frames.

    While active, a frame scoring at most .55 is ``recovering``, any other turns
    ``unstable`` again; ``recovery`` consecutive low frames end the phase, an
    unknown frame ends it at once.  A phase is active exactly when the last
    unstable frame lies after the last unknown one and after the last completed
    run of low frames, so carried indexes replace the automaton.  The length of
    a run is the distance to the last frame that is not low, so ``recovery`` may
    be any number of frames.
    """
    s, i = F.col(state), F.col("pose_idx")
    need = F.lit(recovery) if isinstance(recovery, int) else recovery
    calm = F.coalesce((F.col(score) <= 0.55) & ~s.isin("unknown", "unstable"), F.lit(False))
    at = lambda cond: F.when(cond, i)
    d = scan(df, keys, {"_restless": at(~calm)})
    done = i - F.coalesce("_restless", F.lit(-1)) >= F.greatest(need, F.lit(1))
    d = scan(d, keys, {"_u": at(s == "unstable"), "_k": at(s == "unknown"), "_d": at(done)}, inclusive=False)
    none = F.lit(-1)
    active = F.col("_u").isNotNull() & (F.coalesce("_k", none) < F.col("_u")) & (F.coalesce("_d", none) < F.col("_u"))
    out = F.when(~s.isin("unknown", "unstable") & active, F.when(F.col(score) <= 0.55, "recovering").otherwise("unstable")).otherwise(s)
    return d.withColumn(state, out).drop("_restless", "_u", "_k", "_d")


def stability_judgments(frames: DataFrame, fps: float, keys: Sequence[str] = ("video_id",), movement: str | None = None) -> DataFrame:
    """Judge every frame of every video.

    Rows: ``landmarks`` (camera-compensated where that applies), ``pose_idx``,
    ``n``, ``time_ms`` and per video ``mode``, ``camera_angle``,
    ``angle_threshold``, ``tilt_threshold``, ``minimum_ms``, ``recovery_ms``,
    ``max_coupled_angle``; ``movement`` names the working-joint signal.
    """
    keys = list(keys)
    lm = F.col("landmarks")
    head = ["mode", "camera_angle", "angle_threshold", "tilt_threshold", "minimum_ms", "recovery_ms", "max_coupled_angle"]
    rows = frames.select(
        *keys, "pose_idx", "n", "time_ms", *head, *([F.col(movement).alias("_move")] if movement else []),
        g.signed_trunk_angle(lm).alias("_a0"), g.pair_tilt(lm, LS, RS).alias("_s0"), g.pair_tilt(lm, LH, RH).alias("_p0"),
        ((g.mid(lm, LS, RS, "x") + g.mid(lm, LH, RH, "x")) / 2).alias("_cx"), ((g.mid(lm, LS, RS, "y") + g.mid(lm, LH, RH, "y")) / 2).alias("_cy"),
        F.greatest(F.lit(0.03), g.distance(lm, LS, RS)).alias("_w"), g.chain_min(lm, TRUNK).alias("confidence"),
    )
    if movement:
        rows = interpolate(rows, keys, "_move", "_move")
    window = max(3, int(round(fps * 0.25)) | 1)
    d = materialise(smooth_many(rows, keys, {"_a": "_a0", "_s": "_s0", "_p": "_p0"}, window))
    base = baseline_window(d, keys, "_a", "confidence", fps)
    early = spread_join(d, base, keys, "inner").where(F.col("pose_idx").between(F.col("start_idx"), F.col("end_idx")))
    # the baseline window is shorter than a second, so the plain median is bounded
    centre = early.groupBy(*keys, "n").agg(*[F.median(c).alias(f"_b{c}") for c in ("_a", "_s", "_p", "_cx", "_cy", "_w")])
    d = spread_join(d, centre, keys)
    delta = lambda c: g.wrapped_delta(F.col(c), F.col(f"_b{c}"))
    d = d.withColumn("angle_delta", delta("_a")).withColumn("_sd", delta("_s")).withColumn("_pd", delta("_p"))
    primary = F.col("angle_delta")
    coupled = (F.col("mode") == "relative_coupled") & (F.col("camera_angle") == "side")
    if movement:
        fit = coupling_fit(d, keys, "_a", "_move", "confidence")
        mid = quantiles(d.withColumn("_vm", F.when(F.col("confidence") >= POSE_FLOOR, F.col("_move"))), [*keys, "n"], {"_mid": ("_vm", 0.5)})
        fit = fit.join(mid, [*keys, "n"], "left")
        d = spread_join(d, fit, keys)
        x = lambda m: (m - F.col("motion_median")) / F.col("motion_span")
        line = lambda m: F.col("slope") * x(m) + F.col("intercept")
        middle = line(F.col("_mid"))
        expected = F.greatest(middle - F.col("max_coupled_angle"), F.least(middle + F.col("max_coupled_angle"), line(F.col("_move"))))
        primary = F.when(coupled & F.col("slope").isNotNull(), g.wrapped_delta(F.col("_a"), expected)).otherwise(primary)
    d = materialise(d.withColumn("residual", primary))
    noise = noise_threshold(d, keys, {"na": ("residual", 0.0), "ns": ("_sd", 0.0), "np": ("_pd", 0.0)})
    d = spread_join(d, noise.select(*keys, "n", "na", "ns", "np"), keys)
    d = d.withColumn("angle_limit", F.greatest("angle_threshold", "na")).withColumn("tilt_limit", F.greatest("tilt_threshold", "ns", "np"))
    tiny = F.lit(1e-6)
    limit, tilt = F.greatest(tiny, F.col("angle_limit")), F.greatest(tiny, F.col("tilt_limit"))
    zero = F.lit(0.0)
    metrics = [F.abs("residual") / limit]
    excess = F.greatest(zero, F.abs("angle_delta") - F.col("max_coupled_angle")) / limit
    metrics.append(F.when(coupled & (F.col("max_coupled_angle") > 0), excess).otherwise(zero))
    rear = F.col("camera_angle") == "rear"
    metrics += [F.when(rear, F.abs(c) / tilt).otherwise(zero) for c in ("_sd", "_pd")]
    seen = F.col("confidence") >= POSE_FLOOR
    d = d.withColumn("score", F.when(seen, F.greatest(*metrics)).otherwise(zero))
    first = F.when(~seen, "unknown").when(F.col("score") >= 1.0, "candidate").when(F.col("score") >= 0.65, "watch").otherwise("stable")
    frames_of = lambda ms: F.greatest(F.lit(2), F.ceil(F.col(ms) / 1000.0 * fps))
    d = d.withColumn("state", first)
    other = F.when(F.col("state") != "candidate", F.col("pose_idx"))
    d = scan(d, keys, {"_pb": other}, {"_nb": other})
    length = F.coalesce("_nb", "n") - F.coalesce("_pb", F.lit(-1)) - 1
    d = d.withColumn("state", F.when(F.col("state") == "candidate", F.when(length >= frames_of("minimum_ms"), "unstable").otherwise("watch")).otherwise(F.col("state")))
    d = hysteresis(d, keys, recovery=frames_of("recovery_ms"))
    off = F.col("mode").isin("disabled", "primary_trunk_motion")
    blind = ~F.col("camera_angle").isin(STABILITY_VIEWS)
    d = d.withColumn("state", F.when(off, "not_evaluated").when(blind, "unknown").otherwise(F.col("state")))
    changed = lambda w: F.lag("state").over(w).isNull() | (F.lag("state").over(w) != F.col("state"))
    d = over_neighbours(d, keys, {"_new": changed}, 1, 0)
    d = scan(d, keys, {"_since": F.when(F.col("_new"), F.col("time_ms"))})
    reason = F.when(F.col("mode") == "primary_trunk_motion", "PRIMARY_TRUNK_MOTION").when(F.col("mode") == "disabled", "STABILITY_DISABLED").when(blind, "STABILITY_VIEW_UNSUPPORTED")
    for name, code in {"stable": "TRUNK_STABLE", "watch": "TRUNK_WATCH", "unstable": "TRUNK_UNSTABLE", "recovering": "TRUNK_RECOVERING", "unknown": "TRUNK_EVIDENCE_LOW"}.items():
        reason = reason.when(F.col("state") == name, code)
    judged = ~off & ~blind
    way = F.when(judged & (F.col("residual") > 0.8), "screen_right").when(judged & (F.col("residual") < -0.8), "screen_left").otherwise("centered")
    shift = F.sqrt(F.pow(F.col("_cx") - F.col("_b_cx"), 2) + F.pow(F.col("_cy") - F.col("_b_cy"), 2)) / F.greatest(F.lit(0.03), F.col("_b_w"))
    return d.select(
        *keys, "pose_idx", "n", "time_ms", "mode", "camera_angle", "state", reason.alias("reason_code"), way.alias("direction"),
        F.when(judged, F.greatest(F.lit(0), F.col("time_ms") - F.col("_since"))).otherwise(0).cast("long").alias("duration_ms"),
        rnd("confidence", 3).alias("confidence"), F.when(judged, rnd("score", 3)).alias("score"), rnd("angle_delta", 2).alias("angle_delta"),
        rnd("residual", 2).alias("residual"), rnd(shift, 3).alias("center_shift"), rnd("angle_limit", 2).alias("angle_limit"),
        rnd("tilt_limit", 2).alias("tilt_limit"), rnd("_b_a", 2).alias("baseline_angle"), rnd("_sd", 2).alias("shoulder_tilt_delta"),
        rnd("_pd", 2).alias("pelvis_tilt_delta"),
    )
