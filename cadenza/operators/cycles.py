"""Threshold-cycle counters as chunked folds.

Every counter waits for a sample on the resting side, then for the working
threshold, then looks a bounded distance around the crossing for the turning
point and the return.  Only the two waits are unbounded, so the carried state is
``[phase, cursor, start]``: phase 0 waits at ``cursor``, phase 1 has a start; a
rise that timed out ends the whole search (``DEAD``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.fold import DEAD, chunked_fold
from cadenza.core.layout import CHUNK, spread_join, without_series
from cadenza.core.num import rnd
from cadenza.core.quantiles import quantiles
from cadenza.operators.peaks import detect_repetitions
from cadenza.operators.segment import REP_COLUMNS, number_in_order, segment_by_peaks, timed

EVENT = (
    "struct<start_idx:bigint,key_idx:bigint,end_idx:bigint,start_ms:bigint,key_ms:bigint,end_ms:bigint,"
    "quality:double,start_signal:double,key_signal:double,end_signal:double>"
)


class Series:
    """Index-addressed view of the samples a chunk can see."""

    def __init__(self, arrays, first: int, n: int):
        self.v, self.first, self.n = np.asarray(arrays["v"], dtype=float), first, n
        self.q, self.t = np.asarray(arrays["quality"], dtype=float), arrays["time_ms"]
        self.stop = first + len(self.v)

    def value(self, i: int) -> float:
        return float(self.v[i - self.first])

    def find(self, mask: np.ndarray, start: int, stop: int) -> int | None:
        """First index in [start, stop) where ``mask`` holds."""
        a = max(start - self.first, 0)
        hit = np.flatnonzero(mask[a : max(stop - self.first, 0)])
        return self.first + a + int(hit[0]) if hit.size else None

    def peak(self, start: int, last: int) -> int:
        return start + int(np.argmax(self.v[start - self.first : last + 1 - self.first]))

    def trough(self, start: int, last: int) -> int:
        return start + int(np.argmin(self.v[start - self.first : last + 1 - self.first]))

    def event(self, s: int, k: int, e: int) -> dict:
        a = self.first
        q = self.q[s - a : e + 1 - a]
        q = q[np.isfinite(q)]
        return {
            "start_idx": s, "key_idx": k, "end_idx": e, "start_ms": int(self.t[s - a]), "key_ms": int(self.t[k - a]),
            "end_ms": int(self.t[e - a]), "quality": float(q.mean()) if q.size else 0.0,
            "start_signal": self.value(s), "key_signal": self.value(k), "end_signal": self.value(e),
        }


def hold_until(x: Series, at: int, above: np.ndarray, origin: int, limit: int) -> int:
    """Last index of the run of ``above`` samples after ``at``, cut one step past
    ``limit`` samples from ``origin``."""
    drop = x.find(~above, at + 1, x.stop)
    last = (x.n if drop is None else drop) - 1
    return min(last, max(at + 1, origin + limit + 1), x.stop - 1) if last > at else at


def _search(x: Series, lo: int, hi: int, state: Sequence[float], resting, working, close, limit: int | None,
            memory: int | None = None):
    """Drive the waits; ``close(start, crossing)`` -> (event or None, next cursor).
    A start older than ``memory`` samples acts like any other such start, so it
    is handed on as one, and idle stretches agree after one hand-over."""
    phase, cursor, start = (int(s) for s in state) if state else (0, lo, -1)
    events = []
    while phase < 2:
        if phase == 0:
            start = x.find(resting, max(cursor, lo), hi)
            if start is None:
                return events, [0, cursor, -1] if cursor > hi else []
            phase = 1
        give_up = x.n if limit is None else start + limit + 1
        crossing = x.find(working, max(start, lo), min(hi, give_up + 1))
        if crossing is None:
            if give_up < hi or x.n <= hi:
                phase = 2
                break
            return events, [1, hi, start if memory is None else max(start, hi - memory)]
        found, cursor = close(start, crossing)
        if found:
            events.append(found)
        phase = 0
    return events, [DEAD]


def _samples(fps: float, seconds: float, floor: int) -> int:
    return max(floor, int(fps * seconds))


def _finish(events: DataFrame, keys: Sequence[str], fps: float, amplitude) -> DataFrame:
    reps = number_in_order(events.withColumn("amplitude", rnd(amplitude, 2)), keys, "start_idx")
    for c in ("start_signal", "key_signal", "end_signal", "quality"):
        reps = reps.withColumn(c, rnd(c, 3))
    return timed(reps, fps).select(*keys, "n", *REP_COLUMNS)


def rise():
    return F.col("key_signal") - F.col("start_signal")


def _prepared(sig: DataFrame, keys: Sequence[str], value: str, params: Sequence[str] = ()) -> DataFrame:
    return sig.where("n >= 4").select(*keys, "pose_idx", "n", "time_ms", "quality", F.col(value).cast("double").alias("v"), *params)


def cycles_threshold(sig: DataFrame, keys: Sequence[str], value: str, fps: float, extended: float = 135.0,
                     flexed: float | str = 90.0, size: int = CHUNK) -> DataFrame:
    """Complete extension -> flexion cycles of a flexion signal (180 - angle).

    The start moves to the last sample near the floor of the 2.5 s before the
    flexion crossing; turning point and return lie within 4 s each.  ``flexed``
    may name a column that is constant per series.
    """
    rest = 180.0 - extended
    sig = sig.withColumn("flex_limit", F.col(flexed) if isinstance(flexed, str) else F.lit(float(flexed)))
    gap, look, reach = _samples(fps, 0.35, 1), _samples(fps, 2.5, 2), int(fps * 4.0)
    tail = max(1, int(fps * 0.45))

    def step(arrays, first, lo, hi, n, params, state):
        x, work = Series(arrays, first, n), 180.0 - params["flex_limit"]
        resting, working = x.v <= rest, x.v >= work

        def close(start, crossing):
            begin = max(start, crossing - look)
            pre = x.v[begin - first : crossing + 1 - first]
            margin = max(0.8, float(pre.max() - pre.min()) * 0.02)
            start = begin + int(np.flatnonzero(pre <= pre.min() + margin)[-1])
            last = hold_until(x, crossing, ~resting, crossing, reach)
            key = x.peak(start, last)
            back = x.find(resting, key + 1, min(n, key + reach + 1))
            end = back if back is not None else min(n - 1, key + tail)
            if end <= start:
                end = min(n - 1, start + 1)
            ok = key - start >= gap and x.value(key) - x.value(start) >= work - rest
            return (x.event(start, key, end) if ok else None), max(end + 1, key + gap)

        return _search(x, lo, hi, state, resting, working, close, None, look + 1)

    events = chunked_fold(_prepared(sig, keys, value, ["flex_limit"]), keys, ["v", "quality", "time_ms"], step, EVENT,
                          params=["flex_limit"], back=look + 1, forward=2 * reach + tail + 3, size=size)
    return _finish(events, keys, fps, rise())


def cycles_or_partial(sig: DataFrame, keys: Sequence[str], value: str, fps: float, extended: float = 135.0,
                      flexed: float | str = 90.0, size: int = CHUNK) -> DataFrame:
    """Complete cycles; a series without any keeps its clear direction reversals
    as partial repetitions, with ``range_status`` telling which."""
    keys = list(keys)
    full = cycles_threshold(sig, keys, value, fps, extended, flexed, size).withColumn("range_status", F.lit("complete"))
    rest = without_series(sig.where("n >= 4"), full, keys, size)
    tops = detect_repetitions(
        rest, keys, value, fps, 0.08, 8.0, 0.65, 1.4, min_range=float("-inf"), min_samples=0, size=size, least_distance=2
    )
    part = segment_by_peaks(rest, tops, keys, value, fps, size=size)
    shortest = max(1, round(fps * 0.12))
    part = part.where(
        (F.col("amplitude") >= 8.0) & (F.col("key_idx") - F.col("start_idx") >= shortest)
        & (F.col("end_idx") - F.col("key_idx") >= shortest)
    )
    if isinstance(flexed, str):
        part = part.join(sig.groupBy(*keys).agg(F.max(flexed).alias("_limit")), keys)
    else:
        part = part.withColumn("_limit", F.lit(float(flexed)))
    whole = (180.0 - F.col("start_signal") >= extended) & (180.0 - F.col("key_signal") <= F.col("_limit"))
    part = number_in_order(part.drop("rep_index"), keys, "key_idx").withColumn(
        "range_status", F.when(whole, "complete").otherwise("insufficient")
    )
    return full.unionByName(part.select(*full.columns))


def _low_high_low(sig, keys, value, fps, params, limits, min_amp, least_seconds, from_lower_end, size):
    gap, cycle = _samples(fps, 0.25, 1), _samples(fps, 6.0, 8)

    def step(arrays, first, lo, hi, n, given, state):
        low, top, home = limits(given)
        x = Series(arrays, first, n)
        settled = x.v <= home

        def close(start, crossing):
            last = hold_until(x, crossing, ~settled, start, cycle)
            key = x.peak(start, last)
            back = x.find(settled, key + 1, min(n, key + cycle + 1))
            end = back if back is not None else min(n - 1, last)
            if end <= start:
                end = min(n - 1, start + 1)
            floor = min(x.value(start), x.value(end)) if from_lower_end else x.value(start)
            ok = (
                key - start >= gap and x.value(key) - floor >= min_amp
                and (end - start) / max(1e-6, fps) >= least_seconds
            )
            return (x.event(start, key, end) if ok else None), max(end + 1, key + gap)

        return _search(x, lo, hi, state, x.v <= low, x.v >= top, close, cycle)

    events = chunked_fold(_prepared(sig, keys, value, params), keys, ["v", "quality", "time_ms"], step, EVENT,
                          params=params, back=cycle + 3, forward=2 * cycle + 4, size=size)
    amp = F.col("key_signal") - F.least("start_signal", "end_signal") if from_lower_end else rise()
    return _finish(events, keys, fps, amp)


def cycles_low_high(sig: DataFrame, keys: Sequence[str], value: str, fps: float, size: int = CHUNK) -> DataFrame:
    """Low -> high -> low cycles with fixed 60 / 110 degree thresholds."""
    return _low_high_low(sig, keys, value, fps, [], lambda p: (60.0, 110.0, 60.0), 48.0, 0.0, False, size)


def _with_thresholds(sig, keys, value, low_p, high_p, low, high):
    stats = quantiles(sig.where("n >= 4"), [*keys, "n"], {"_lo": (value, low_p), "_hi": (value, high_p)})
    stats = stats.withColumn("low_thr", low(F.col("_lo"))).withColumn("top_thr", high(F.col("low_thr"), F.col("_hi")))
    return spread_join(sig.where("n >= 4"), stats.drop("_lo", "_hi"), keys, "inner")


def cycles_adaptive(sig: DataFrame, keys: Sequence[str], value: str, fps: float, size: int = CHUNK) -> DataFrame:
    """Low -> high -> low cycles with thresholds from the signal's p30 and p78."""
    rows = _with_thresholds(
        sig, keys, value, 0.30, 0.78, lambda lo: F.least(F.lit(140.0), lo + 5.0),
        lambda lo, hi: F.greatest(lo + 25.0, hi),
    )
    limits = lambda p: (p["low_thr"], p["top_thr"], p["low_thr"] + 4.0)
    return _low_high_low(rows, keys, value, fps, ["low_thr", "top_thr"], limits, 25.0, 0.45, True, size)


def _hinge(rows, keys, value, fps, limit, least_seconds, size):
    """Top -> bottom -> top cycles; an incomplete return is skipped."""

    def step(arrays, first, lo, hi, n, given, state):
        top, bottom = given["low_thr"], given["top_thr"]
        x = Series(arrays, first, n)
        resting, working = x.v <= top, x.v >= bottom

        def close(start, crossing):
            key = x.peak(start, crossing)
            settled = x.find(x.v <= top + 5.0, crossing, x.stop)
            end = min(n - 1 if settled is None else settled, max(crossing, key + limit + 1), x.stop - 1)
            cursor = max(end + 1, crossing + 1)
            if x.value(end) > top + 12.0:
                return None, cursor
            ok = x.value(key) - x.value(start) >= 25.0 and (end - start) / max(1e-6, fps) >= least_seconds
            return (x.event(start, key, end) if ok else None), cursor

        return _search(x, lo, hi, state, resting, working, close, limit)

    params = ["low_thr", "top_thr"]
    events = chunked_fold(_prepared(rows, keys, value, params), keys, ["v", "quality", "time_ms"], step, EVENT,
                          params=params, back=limit + 3, forward=limit + 4, size=size)
    return _finish(events, keys, fps, rise())


def _hinge_thresholds(sig, keys, value):
    return _with_thresholds(
        sig, keys, value, 0.25, 0.80, lambda lo: F.greatest(F.lit(10.0), lo + 5.0),
        lambda lo, hi: F.greatest(lo + 25.0, hi),
    )


def cycles_hinge(sig: DataFrame, keys: Sequence[str], value: str, fps: float, size: int = CHUNK) -> DataFrame:
    """Hinge cycles of an already smoothed line angle, at most 8.5 s down."""
    return _hinge(_hinge_thresholds(sig, keys, value), keys, value, fps, _samples(fps, 8.5, 8), 0.55, size)


def cycles_hinge_samples(sig: DataFrame, keys: Sequence[str], value: str, fps: float, size: int = CHUNK) -> DataFrame:
    """Hinge cycles with a cap of 100 samples and no minimum duration."""
    return _hinge(_hinge_thresholds(sig, keys, value), keys, value, fps, 100, 0.0, size)


def cycles_elbow(sig: DataFrame, keys: Sequence[str], value: str, fps: float, extended: float, flexed: float,
                 min_amplitude: float, cap: int = 80, size: int = CHUNK) -> DataFrame:
    """High -> low -> rising cycles of a joint angle.

    The bottom is confirmed by a rise of 5 degrees at least three samples later;
    the end is the return to within 15 degrees of extension.
    """

    def step(arrays, first, lo, hi, n, given, state):
        x = Series(arrays, first, n)
        ready, home = x.v >= extended, x.v >= extended - 15.0
        cursor, events = int(state[1]) if state else lo, []
        while True:
            start = x.find(ready, max(cursor, lo), hi)
            if start is None:
                return events, [0, cursor] if cursor > hi else []
            window = x.v[start - first : start - first + cap + 2]
            lows = np.minimum.accumulate(window)
            where = np.zeros(len(window), dtype=int)
            for j in range(1, len(window)):
                where[j] = j if window[j] < window[where[j - 1]] else where[j - 1]
            j = np.arange(len(window))
            crossed = np.logical_or.accumulate((j > 0) & (window <= flexed))
            turned = crossed & (j > where + 2) & (window >= lows + 5.0)
            capped = j > cap
            stop = np.flatnonzero(turned | capped)
            if not stop.size or not crossed[stop[0]] or lows[stop[0]] > flexed:
                return events, [DEAD]
            at, key = start + int(stop[0]), start + int(where[stop[0]])
            back = x.find(home, at, x.stop)
            end = min(n - 1 if back is None else back, max(at + 1, key + cap + 1), x.stop - 1)
            if x.value(start) - x.value(key) >= min_amplitude:
                events.append(x.event(start, key, end))
            cursor = max(end + 1, at + 1)

    events = chunked_fold(_prepared(sig, keys, value), keys, ["v", "quality", "time_ms"], step, EVENT,
                          back=1, forward=2 * cap + 8, size=size)
    return _finish(events, keys, fps, F.col("start_signal") - F.col("key_signal"))
