"""Repetitions from peaks, their validation and their stage frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.layout import CHUNK, chunk_index, scan, spread_join, with_ordinal
from cadenza.core.num import rnd
from cadenza.core.session import materialise

REP_COLUMNS = [
    "rep_index", "start_idx", "key_idx", "end_idx", "start_ms", "key_ms", "end_ms", "quality",
    "start_signal", "key_signal", "end_signal", "amplitude", "duration_s", "descent_s", "ascent_s",
]


def number_in_order(df: DataFrame, keys: Sequence[str], at: str, out: str = "rep_index") -> DataFrame:
    """1-based position by ``at`` within the key."""
    ranked = with_ordinal(df, keys, [at], chunk_index(at), idx="_ord", n="_cnt")
    return ranked.withColumn(out, F.col("_ord") + 1).drop("_ord", "_cnt")


def timed(reps: DataFrame, fps: float) -> DataFrame:
    """Rounded phase durations from the pose indexes."""
    seconds = lambda a, b: rnd((F.col(b) - F.col(a)) / F.lit(max(1e-6, fps)), 2)
    return (
        reps.withColumn("duration_s", seconds("start_idx", "end_idx"))
        .withColumn("descent_s", seconds("start_idx", "key_idx"))
        .withColumn("ascent_s", seconds("key_idx", "end_idx"))
    )


def extremes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """First index of the minimum and of the maximum per series."""
    return df.groupBy(*keys, "n").agg(
        F.min(F.struct(F.col(value), F.col("pose_idx")))["pose_idx"].alias("low_idx"),
        F.min(F.struct((-F.col(value)).alias("h"), F.col("pose_idx")))["pose_idx"].alias("high_idx"),
    )


def stages_without_peaks(ends: DataFrame) -> DataFrame:
    """Start, key and last stage index of a series without peaks, from its extremes."""
    a, b, n = F.least("low_idx", "high_idx"), F.greatest("low_idx", "high_idx"), F.col("n")
    short = b - a < 3
    third = F.floor(n * 2 / 3).cast("long")
    return ends.select(
        "*",
        F.when(short, F.lit(0)).otherwise(a).cast("long").alias("stage_start"),
        F.when(short, third).otherwise(b).cast("long").alias("stage_key"),
        F.when(short, n - 1)
        .otherwise(F.least(n - 1, b + F.greatest(F.lit(1), F.floor((b - a) / 2))))
        .cast("long").alias("stage_end"),
        short.alias("stage_thirds"),
    )


def segment_by_peaks(sig: DataFrame, peaks: DataFrame, keys: Sequence[str], value: str, fps: float,
                     fallback: bool = True, size: int = CHUNK) -> DataFrame:
    """One repetition per peak: it starts and ends at the lowest sample between
    the midpoints to its neighbour peaks.

    Every sample knows the peak before and after it, so it contributes to at
    most two half cycles and the minima are partial aggregates.
    """
    keys = list(keys)
    own = peaks.select(*keys, F.col("pose_idx").alias("key_idx"))
    if fallback:
        ends = extremes(sig, keys, value).join(own.select(*keys).distinct(), keys, "left_anti")
        guess = stages_without_peaks(ends).where("n >= 4 AND stage_end > stage_start")
        own = own.unionByName(guess.select(*keys, F.col("stage_key").alias("key_idx")))
    mark = own.select(*keys, F.col("key_idx").alias("pose_idx"), F.lit(True).alias("_is_peak"))
    rows = sig.where("n >= 4").select(*keys, "pose_idx", "n", "time_ms", "quality", F.col(value).alias("_v"))
    rows = rows.join(mark, [*keys, "pose_idx"], "left")
    at = F.when(F.col("_is_peak"), F.col("pose_idx"))
    usable = F.col("quality").isNotNull()
    rows = scan(
        rows, keys, {"_before": at}, {"_after": at},
        {"_rank": F.when(F.col("_is_peak"), 1).otherwise(0), "_q": F.coalesce("quality", F.lit(0.0)),
         "_qn": usable.cast("int")},
        size=size,
    )
    i, a, b = F.col("pose_idx"), F.col("_before"), F.col("_after")
    middle = F.floor((a + b) / 2)
    lone = a == b
    rising = b.isNotNull() & (a.isNull() | lone | (i >= middle))
    falling = a.isNotNull() & (b.isNull() | lone | (i <= middle))
    halves = F.filter(
        F.array(
            F.when(rising, F.struct(b.alias("key_idx"), F.lit(0).alias("half"))),
            F.when(falling, F.struct(a.alias("key_idx"), F.lit(1).alias("half"))),
        ),
        lambda h: h.isNotNull(),
    )
    rest = [F.col("time_ms").alias("t"), F.col("quality").alias("q"), F.col("_q").alias("qs"), F.col("_qn").alias("qn")]
    v = F.col("_v").alias("v")
    sample, by_index = F.struct(v, i.alias("i"), *rest), F.struct(i.alias("i"), v, *rest)
    h = rows.select(*keys, "n", "_is_peak", "_rank", sample.alias("s"), by_index.alias("e"), F.explode(halves).alias("h"))
    left, right = F.col("h.half") == 0, F.col("h.half") == 1
    cycles = h.groupBy(*keys, F.col("h.key_idx").alias("key_idx")).agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("_is_peak"), F.col("_rank"))).cast("long").alias("rep_index"),
        F.min(F.when(left, F.col("s"))).alias("start"),
        F.min(F.when(right, F.col("s"))).alias("end"),
        F.min(F.when(left, F.col("e"))).alias("edge_l"),
        F.max(F.when(right, F.col("e"))).alias("edge_r"),
        F.max(F.when(F.col("_is_peak"), F.col("s"))).alias("key"),
    )
    flat = F.col("end.i") <= F.col("start.i")
    fields = ["v", "i", "t", "q", "qs", "qn"]
    reorder = lambda c: F.struct(*[F.col(f"{c}.{f}").alias(f) for f in fields])
    start, end = F.when(flat, reorder("edge_l")).otherwise(F.col("start")), F.when(flat, reorder("edge_r")).otherwise(F.col("end"))
    cycles = cycles.withColumn("start", start).withColumn("end", end).where(F.col("end.i") > F.col("start.i"))
    # mean quality of the cycle from the running sums at its two ends
    first_q, first_n = F.coalesce(F.col("start.q"), F.lit(0.0)), F.when(F.col("start.q").isNull(), 0).otherwise(1)
    total, count = F.col("end.qs") - F.col("start.qs") + first_q, F.col("end.qn") - F.col("start.qn") + first_n
    reps = cycles.select(
        *keys, "n", "rep_index", F.col("start.i").alias("start_idx"), "key_idx", F.col("end.i").alias("end_idx"),
        F.col("start.t").alias("start_ms"), F.col("key.t").alias("key_ms"), F.col("end.t").alias("end_ms"),
        rnd(F.when(count > 0, total / count).otherwise(0.0), 3).alias("quality"),
        rnd("start.v", 3).alias("start_signal"), rnd("key.v", 3).alias("key_signal"), rnd("end.v", 3).alias("end_signal"),
        rnd(F.col("key.v") - F.least("start.v", "end.v"), 2).alias("amplitude"),
    )
    return timed(reps, fps).select(*keys, "n", *REP_COLUMNS)


# Actions whose repetitions may last eight seconds.
SLOW_ACTIONS = [
    "hip_thrust", "back_extension", "romanian_deadlift", "plate_loaded_romanian_deadlift",
    "plate_loaded_rear_leg_raise",
]


def reject_reason(action: Column, fps: float) -> Column:
    """Why a repetition does not count; NULL when it does."""
    s, k, e, n = F.col("start_idx"), F.col("key_idx"), F.col("end_idx"), F.col("n")
    legal = (s >= 0) & (s <= k) & (k < n) & (e >= 0) & (e < n)
    f = F.lit(max(1e-6, fps))
    exact, down, up = (e - s) / f, (k - s) / f, (e - k) / f
    stored = F.when(F.coalesce(F.col("duration_s"), F.lit(0.0)) != 0, F.col("duration_s")).otherwise(exact)
    longest = F.when(action.isin(SLOW_ACTIONS), 8.0).otherwise(6.0)
    amplitude = F.coalesce(F.col("amplitude"), F.lit(0.0))
    bench_amp = F.col("key_signal") - F.least("start_signal", "end_signal")
    bench = (
        F.when(exact < 0.45, "too_short").when((down < 0.25) | (up < 0.25), "incomplete_cycle")
        .when(exact > 6.0, "too_long").when(bench_amp < 4.5, "low_amplitude")
    )
    other = (
        F.when(stored < 0.35, "too_short").when(stored > longest, "too_long").when(amplitude < 3.0, "low_amplitude")
    )
    return F.when(~legal, "invalid_index").otherwise(F.when(action == "bench_press", bench).otherwise(other))


def validate_reps(reps: DataFrame, keys: Sequence[str], action: Column, fps: float) -> tuple[DataFrame, DataFrame]:
    """Valid repetitions renumbered, and one diagnostics row per key."""
    marked = reps.withColumn("action_type", action).withColumn("reject_reason", reject_reason(F.col("action_type"), fps))
    valid = marked.where(F.col("reject_reason").isNull()).drop("rep_index", "reject_reason")
    valid = number_in_order(valid, keys, "key_idx")
    raw, ok = F.col("raw_count"), F.col("valid_count")
    slack = F.when(F.col("action_type") == "bench_press", ok * 0.35).otherwise(raw * 0.45)
    unstable = (raw > 0) & ((ok == 0) | (raw - ok > F.greatest(F.lit(1), F.bround(slack).cast("long"))))
    diagnostics = (
        marked.groupBy(*keys, "action_type")
        .agg(F.count(F.lit(1)).alias("raw_count"), F.count_if(F.col("reject_reason").isNull()).alias("valid_count"))
        .select(*keys, "raw_count", "valid_count", (raw - ok).alias("rejected_count"), unstable.alias("count_unstable"))
    )
    return valid, diagnostics


def median_rep(reps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rep in the middle of the order by amplitude, quality and duration
    (descending, earlier first on ties); the top one when there are at most two."""
    r = reps.withColumn("_na", -F.col("amplitude")).withColumn("_nq", -F.col("quality")).withColumn("_nd", -F.col("duration_s"))
    ranked = with_ordinal(r, keys, ["_na", "_nq", "_nd", "rep_index"], F.floor(F.col("_na") * 16).cast("long"), "_r", "_m")
    want = F.when(F.col("_m") > 2, F.floor(F.col("_m") / 2)).otherwise(0)
    return ranked.where(F.col("_r") == want).drop("_na", "_nq", "_nd", "_r", "_m")


def stage_frames(sig: DataFrame, reps: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Pose indexes [start, mid down, key, mid up] of the representative rep, or
    of the signal's extremes when a series has no rep."""
    keys = list(keys)
    chosen = median_rep(reps, keys).select(*keys, "n", "start_idx", "key_idx", "end_idx")
    ends = stages_without_peaks(extremes(sig, keys, value).join(chosen.select(*keys), keys, "left_anti"))
    plain = ends.select(
        *keys, "n", F.col("stage_start").alias("start_idx"), F.col("stage_key").alias("key_idx"),
        F.col("stage_end").alias("end_idx"), "stage_thirds",
    )
    spans = chosen.withColumn("stage_thirds", F.lit(None).cast("boolean")).unionByName(plain)
    i = F.col("pose_idx")
    at = lambda c: F.max(F.when(i == F.col(c), F.col(value)))
    ends = [F.col(c) for c in ("start_idx", "key_idx", "end_idx", "stage_thirds")]
    hit = spread_join(sig, materialise(spans), keys, "inner").where(i.between(F.col("start_idx"), F.col("end_idx")))
    known = hit.where((i == F.col("start_idx")) | (i == F.col("key_idx")) | (i == F.col("end_idx")))
    values = known.groupBy(*keys, "n", *ends).agg(
        at("start_idx").alias("_vs"), at("key_idx").alias("_vk"), at("end_idx").alias("_ve")
    )
    spans = materialise(values)
    hit = spread_join(sig, spans, keys, "inner")
    gap = lambda a, b: F.struct(F.abs(F.col(value) - (F.col(a) + F.col(b)) / 2.0).alias("d"), i.alias("i"))
    down, up = i.between(F.col("start_idx"), F.col("key_idx")), i.between(F.col("key_idx"), F.col("end_idx"))
    spans = hit.where(down | up).groupBy(*keys, "n", *ends).agg(
        F.min(F.when(down, gap("_vs", "_vk")))["i"].alias("_down"), F.min(F.when(up, gap("_vk", "_ve")))["i"].alias("_up")
    )
    thirds = F.col("stage_thirds")
    return spans.select(
        *keys, F.col("start_idx").alias("stage_1"),
        F.when(F.col("n") < 4, F.lit(0)).when(thirds, F.floor(F.col("n") / 3)).otherwise(F.col("_down")).cast("long").alias("stage_2"),
        F.when(F.col("n") < 4, F.lit(0)).otherwise(F.col("key_idx")).cast("long").alias("stage_3"),
        F.when(F.col("n") < 4, F.lit(0)).when(thirds.isNull(), F.col("_up")).otherwise(F.col("end_idx")).cast("long").alias("stage_4"),
    )
