"""Smoothing, interpolation, energy and runs over one series per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.layout import CHUNK, carry, islands, over_neighbours, spread_join, with_halo, chunk_window
from cadenza.core.num import clamp, odd_window
from cadenza.core.quantiles import quantiles


def smooth_many(
    df: DataFrame, keys: Sequence[str], values: dict[str, str], window: int, size: int = CHUNK
) -> DataFrame:
    """Centred mean with edge-replicated padding, ``out -> column``.

    The window shrinks to the largest odd length of a short series; series of
    fewer than three rows stay as they are.  Missing edge samples are added as
    multiples of the first / last value, so one frame of rows is enough.
    """
    radius = window // 2
    odd_n = F.col("n") - F.when(F.col("n") % 2 == 0, 1).otherwise(0)
    w = chunk_window(keys)
    padded = with_halo(df, radius, radius, size)
    exprs = []
    for out, name in values.items():
        first = F.first(name).over(w.rowsBetween(-radius, 0))
        last = F.last(name).over(w.rowsBetween(0, radius))
        choice = F.when(F.col("n") < 3, F.col(name))
        for r in range(1, radius + 1):
            left = F.greatest(F.lit(0), F.lit(r) - F.col("pose_idx"))
            right = F.greatest(F.lit(0), F.col("pose_idx") + F.lit(r) - F.col("n") + 1)
            inner = F.sum(name).over(w.rowsBetween(-r, r))
            mean = (inner + left * first + right * last) / F.lit(2.0 * r + 1.0)
            choice = choice.when(odd_n <= 2 * r + 1, mean) if r < radius else choice.otherwise(mean)
        exprs.append(choice.alias(out))
    return padded.select("*", *exprs).where("_core").drop("_core", "chunk")


def smooth(df: DataFrame, keys: Sequence[str], value: str, window: int, out: str = "smoothed",
           size: int = CHUNK) -> DataFrame:
    return smooth_many(df, keys, {out: value}, window, size)


def smooth_shrink(df: DataFrame, keys: Sequence[str], value: str, window: int = 3, out: str = "smoothed",
                  size: int = CHUNK) -> DataFrame:
    """Centred mean whose window shrinks at the edges."""
    r = max(1, window // 2)
    mean = lambda w: F.when(F.col("n") < 3, F.col(value)).otherwise(F.avg(value).over(w.rowsBetween(-r, r)))
    return over_neighbours(df, keys, {out: mean}, r, r, size)


def interpolate(df: DataFrame, keys: Sequence[str], value: str, out: str = "filled",
                empty: float | str | None = 0.0, size: int = CHUNK) -> DataFrame:
    """Linear interpolation over missing samples, edges held.  ``empty`` fills a
    series without any sample: a constant or the name of a fallback column."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("pose_idx").alias("i"), F.col(value).alias("v")))
    d = carry(df, keys, {"_a": known}, {"_b": known}, size=size)
    a, b, i = F.col("_a"), F.col("_b"), F.col("pose_idx")
    ratio = (i - a["i"]) / (b["i"] - a["i"])
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(a.isNotNull() & b.isNotNull(), a["v"] + (b["v"] - a["v"]) * ratio)
        .otherwise(F.coalesce(a["v"], b["v"]))
    )
    if empty is not None:
        filled = F.coalesce(filled, F.col(empty) if isinstance(empty, str) else F.lit(float(empty)))
    return d.withColumn(out, filled).drop("_a", "_b")


def fill_with_mean(df: DataFrame, keys: Sequence[str], value: str, out: str = "filled") -> DataFrame:
    """Missing samples take the mean of the measured ones (0 when there is none)."""
    mean = df.groupBy(*keys, "n").agg(F.avg(value).alias("_mean"))
    return spread_join(df, mean, keys).withColumn(out, F.coalesce(value, "_mean", F.lit(0.0))).drop("_mean")


def motion_energy(df: DataFrame, keys: Sequence[str], value: str, fps: float, out: str = "energy") -> DataFrame:
    """Smoothed absolute change, scaled by its 90th percentile to 0..1."""
    step = lambda w: F.abs(F.col(value) - F.coalesce(F.lag(value).over(w), F.col(value)))
    moved = over_neighbours(df, keys, {"_step": step}, 1, 0)
    moved = smooth(moved, keys, "_step", odd_window(fps * 0.35), "_sm")
    scale = quantiles(moved, [*keys, "n"], {"_scale": ("_sm", 0.9)})
    energy = F.when((F.col("n") < 2) | (F.col("_scale") < 1e-6), F.lit(0.0)).otherwise(
        clamp(F.col("_sm") / F.col("_scale"))
    )
    return spread_join(moved, scale, keys).withColumn(out, energy).drop("_step", "_sm", "_scale")


def active_segments(df: DataFrame, keys: Sequence[str], active: Column, max_gap: int) -> DataFrame:
    """Runs of active rows, merged when at most ``max_gap`` rows apart."""
    return (
        islands(df, keys, max_gap, active)
        .groupBy(*keys, "n", "island")
        .agg(F.min("pose_idx").alias("start_idx"), F.max("pose_idx").alias("end_idx"))
    )


def low_confidence_windows(df: DataFrame, keys: Sequence[str], quality: str = "quality",
                           threshold: float = 0.55) -> DataFrame:
    rows = islands(df, keys, 0, F.col(quality) < threshold)
    return rows.groupBy(*keys, "island").agg(
        F.min("pose_idx").alias("start_idx"), F.max("pose_idx").alias("end_idx"),
        F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"),
        F.bround(F.min(quality), 3).alias("min_confidence"),
    )


def judgment_segments(df: DataFrame, keys: Sequence[str], group: Sequence[str], fps: float) -> DataFrame:
    """Run-length compression of per-frame judgments by the ``group`` columns.

    Expects ``time_ms``, ``angle_delta``, ``score``, ``confidence`` and
    ``rep_index``; a segment lasts one sampling step past its last frame.
    """
    step = max(1, round(1000.0 / max(1.0, fps)))
    current = F.struct(*group)
    changed = lambda w: (F.lag(current).over(w).isNull()) | ~F.lag(current).over(w).eqNullSafe(current)
    flagged = over_neighbours(df, keys, {"_changed": changed}, 1, 0)
    rows = islands(flagged, keys, changed=F.col("_changed"))
    seg = rows.groupBy(*keys, "island", *group).agg(
        F.min("time_ms").alias("start_ms"),
        (F.max("time_ms") + step).alias("end_ms"),
        F.count(F.lit(1)).alias("sample_count"),
        F.greatest(F.lit(step), F.max("time_ms") - F.min("time_ms") + step).alias("duration_ms"),
        F.max(F.abs(F.coalesce("angle_delta", F.lit(0.0)))).alias("max_angle_delta"),
        F.max(F.coalesce("score", F.lit(0.0))).alias("max_score"),
        F.avg("confidence").alias("confidence"),
    )
    # repetitions touched by a segment: distinct pairs first, then the list
    reps = rows.where(F.col("rep_index").isNotNull()).select(*keys, "island", "rep_index").distinct()
    reps = reps.groupBy(*keys, "island").agg(F.array_sort(F.collect_list("rep_index")).alias("rep_indexes"))
    return seg.join(reps, [*keys, "island"], "left")


def baseline_window(df: DataFrame, keys: Sequence[str], value: str, confidence: str, fps: float,
                    floor: float = 0.55, size: int = CHUNK) -> DataFrame:
    """Quietest early window: smallest p90-p10 spread plus a confidence penalty.

    The window has at most ``0.9 s`` of samples, so candidates are built from a
    bounded look-ahead; the search covers the first 45 % of the series.
    Returns ``start_idx`` and ``end_idx`` per key.
    """
    span_s = F.greatest(F.lit(0.55), F.least(F.lit(0.9), F.col("n") / F.lit(max(1.0, fps))))
    win = F.greatest(F.lit(3), F.least(F.col("n"), F.bround(span_s * F.lit(fps)).cast("long")))
    reach = max(3, int(round(0.9 * fps)))
    w = chunk_window(keys).rowsBetween(0, reach - 1)
    rows = with_halo(df, 0, reach, size).select(
        *keys, "pose_idx", "n", "_core", win.alias("_win"),
        F.collect_list(F.struct(F.col(value).alias("v"), F.col(confidence).alias("c"))).over(w).alias("_ahead"),
    ).where("_core")
    rows = rows.withColumn("_local", F.slice("_ahead", 1, F.col("_win").cast("int")))
    search_end = F.greatest(
        F.col("_win"),
        F.least(F.col("n"), F.bround(F.greatest(F.col("_win").cast("double"), F.col("n") * 0.45)).cast("long")),
    )
    vs = F.array_sort(F.transform("_local", lambda s: s["v"]))
    m = F.size("_local")

    def pct(p: float) -> Column:
        pos = (m - 1) * F.lit(p)
        lo = F.floor(pos).cast("int")
        hi = F.ceil(pos).cast("int")
        return F.get(vs, lo) + (F.get(vs, hi) - F.get(vs, lo)) * (pos - lo)

    mean_conf = F.aggregate("_local", F.lit(0.0), lambda a, s: a + s["c"]) / m
    share = F.size(F.filter("_local", lambda s: s["c"] >= floor)) / m
    score = pct(0.9) - pct(0.1) + F.greatest(F.lit(0.0), F.lit(floor) - mean_conf) * 10.0
    last_start = F.greatest(F.lit(1), search_end - F.col("_win") + 1)
    usable = (m >= 3) & (share >= 0.7) & (F.col("pose_idx") < last_start)
    best = rows.select(*keys, "n", "pose_idx", "_win", F.when(usable, score).alias("_score"))
    return best.groupBy(*keys, "n").agg(
        F.coalesce(F.min(F.when(F.col("_score").isNotNull(), F.struct("_score", "pose_idx")))["pose_idx"], F.lit(0))
        .alias("start_idx"),
        F.max("_win").alias("_win"),
    ).select(*keys, "n", "start_idx", (F.least(F.col("n"), F.col("start_idx") + F.col("_win")) - 1).alias("end_idx"))
