"""Prominent peaks and their greedy separation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.layout import CHUNK, over_neighbours, spread_join, with_halo
from cadenza.core.quantiles import quantiles
from cadenza.core.session import materialise


def peak_candidates(df: DataFrame, keys: Sequence[str], value: str, window: int, prominence,
                    size: int = CHUNK) -> DataFrame:
    """Strict rise on the left, no rise on the right, height above the higher of
    the two neighbouring minima at least ``prominence`` (number or column)."""
    v = F.col(value)
    cols = {
        "_prev": lambda w: F.lag(value).over(w),
        "_next": lambda w: F.lead(value).over(w),
        "_left": lambda w: F.min(value).over(w.rowsBetween(-window, -1)),
        "_right": lambda w: F.min(value).over(w.rowsBetween(1, window)),
    }
    d = over_neighbours(df, keys, cols, window, window, size)
    need = prominence if not isinstance(prominence, (int, float)) else F.lit(float(prominence))
    rises = (v > F.col("_prev")) & (v >= F.col("_next"))
    return d.where(rises & (v - F.greatest("_left", "_right") >= need)).drop("_prev", "_next", "_left", "_right")


def separate(cands: DataFrame, keys: Sequence[str], value: str, distance: int, size: int = CHUNK,
             params: Sequence[str] = ()) -> DataFrame:
    """Keep peaks from the highest down when no kept peak is closer than
    ``distance`` (ties: the earlier one first).

    A chunk sees its own candidates and a halo.  A decision that would need a
    candidate outside that view stays open and is taken in the next round with
    the neighbours' decisions known, so the result equals one global pass.
    """
    keys, params = list(keys), list(params)
    halo = 8 * distance
    size = max(size, halo)  # a decision looks one distance around, so a chunk and its halo always settle some
    todo = cands.select(*keys, "pose_idx", "n", value, *params, F.lit(None).cast("boolean").alias("_kept"))
    while True:
        padded = with_halo(todo, halo, halo, size)
        entry = F.struct((-F.col(value)).alias("h"), F.col("pose_idx").alias("i"), F.col("_kept").alias("k"))
        chunks = padded.groupBy(*keys, "chunk").agg(
            F.array_sort(F.collect_list(entry)).alias("_c"), F.max("n").alias("n"),
            *[F.max(p).alias(p) for p in params],
        )
        low = F.greatest(F.lit(0).cast("long"), F.col("chunk") * size - halo)
        high = F.least(F.col("n"), (F.col("chunk") + 1) * size + halo)
        known = F.transform(F.filter("_c", lambda c: c["k"]), lambda c: c["i"])
        open_ = F.filter("_c", lambda c: c["k"].isNull())
        nothing = F.array().cast("array<bigint>")
        near = lambda c: (lambda j: F.abs(j - c["i"]) < distance)

        def visit(acc, c):
            beaten = F.exists(acc["kept"], near(c))
            hidden = (
                ((c["i"] - distance < F.col("low")) & (F.col("low") > 0))
                | ((c["i"] + distance > F.col("high")) & (F.col("high") < F.col("n")))
                | F.exists(acc["wait"], near(c))
            )
            one = F.array(c["i"])
            return F.struct(
                F.when(beaten | hidden, acc["kept"]).otherwise(F.concat(acc["kept"], one)).alias("kept"),
                F.when(~beaten & hidden, F.concat(acc["wait"], one)).otherwise(acc["wait"]).alias("wait"),
            )

        start = F.struct(known.alias("kept"), nothing.alias("wait"))
        visited = F.aggregate("_open", start, visit)
        decided = chunks.withColumn("low", low).withColumn("high", high).withColumn("_open", open_).select(
            *keys, "chunk", "n", *params, "_c", visited.alias("_d")
        )
        own = lambda i: F.floor(i / F.lit(size)) == F.col("chunk")
        i = F.col("c.i")
        state = F.when(F.array_contains("_d.kept", i), F.lit(True))
        verdict = materialise(
            decided.select(*keys, "chunk", "n", *params, "_d", F.explode("_c").alias("c"))
            .where(own(i) & (F.array_contains("_d.kept", i) | F.array_contains("_d.wait", i)))
            .select(*keys, i.alias("pose_idx"), "n", (-F.col("c.h")).alias(value), *params, state.alias("_kept"))
        )
        if verdict.where(F.col("_kept").isNull()).isEmpty():
            return verdict.drop("_kept")
        todo = verdict


def detect_repetitions(
    df: DataFrame, keys: Sequence[str], value: str, fps: float, prominence_ratio: float = 0.18,
    min_prominence: float = 3.0, distance_seconds: float = 1.0,
    prominence_window_seconds: float | None = None, min_range: float = 4.0,
    min_samples: int | None = None, size: int = CHUNK, least_distance: int = 3,
) -> DataFrame:
    """Peaks of each series with thresholds from its own p95-p5 range; none when
    the series is short or flat.  Adds ``signal_range``."""
    keys = list(keys)
    distance = max(least_distance, int(fps * distance_seconds))
    window = max(distance, int(fps * prominence_window_seconds)) if prominence_window_seconds else distance
    need = max(6, int(fps * 2)) if min_samples is None else min_samples
    stats = quantiles(df, [*keys, "n"], {"_p95": (value, 0.95), "_p05": (value, 0.05)})
    stats = stats.select(*keys, "n", (F.col("_p95") - F.col("_p05")).alias("signal_range"))
    usable = stats.where((F.col("n") >= need) & (F.col("signal_range") >= min_range))
    rows = spread_join(df, usable, keys, "inner")
    prominence = F.greatest(F.lit(float(min_prominence)), F.col("signal_range") * prominence_ratio)
    cands = peak_candidates(rows, keys, value, window, prominence, size)
    return separate(cands, keys, value, distance, size, ["signal_range"])
