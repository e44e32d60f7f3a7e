"""Repetition counters on vectors with a known answer, and chunk invariance."""

import math
import random

from pyspark.sql import functions as F

from cadenza.operators import cycles, segment
from cadenza.operators.peaks import detect_repetitions

K = ["k"]


def swing(turns, step):
    """Signal through the turning points ``turns``, ``step`` samples between two:
    half a cosine from each to the next, so every turn is known by its index."""
    out = [float(turns[0])]
    for a, b in zip(turns, turns[1:]):
        out += [a + (b - a) * (1 - math.cos(math.pi * k / step)) / 2 for k in range(1, step + 1)]
    return out


def table(spark, *signals, fps=8):
    data = [(k, i, len(v), int(1000 * i / fps), float(x), 0.95) for k, v in enumerate(signals) for i, x in enumerate(v)]
    return spark.createDataFrame(data, "k int, pose_idx long, n long, time_ms long, v double, quality double")


def spans(df):
    return sorted((r.k, r.rep_index, r.start_idx, r.key_idx, r.end_idx) for r in df.collect())


def test_elbow_cycles(spark):
    df = table(spark, [180 - a for a in swing([164, 78, 162, 76, 165], 6)], [180 - a for a in swing([163, 108, 160], 6)])
    got = cycles.cycles_or_partial(df, K, "v", 8.0).collect()
    assert [r.range_status for r in got if r.k == 0] == ["complete"] * 2
    assert [r.range_status for r in got if r.k == 1] == ["insufficient"]


def test_low_high_and_hinge_cycles(spark):
    low_high = spans(cycles.cycles_low_high(table(spark, swing([33, 137, 34, 133, 36], 6)), K, "v", 8.0))
    assert [r[3] for r in low_high] == [6, 18]
    hinge = spans(cycles.cycles_hinge(table(spark, swing([7, 85, 8, 81, 6, 88, 9], 6)), K, "v", 8.0))
    assert len(hinge) == 3 and all(abs(r[3] - k) <= 1 for r, k in zip(hinge, [6, 18, 30]))


def test_segments_from_peaks(spark):
    df = table(spark, swing([0, 44, 1, 52, 2, 49, 0], 3))
    peaks = df.where(F.col("pose_idx").isin(3, 9, 15))
    reps = segment.segment_by_peaks(df, peaks, K, "v", 8.0)
    assert [r.rep_index for r in reps.orderBy("rep_index").collect()] == [1, 2, 3]


def test_bench_validation_and_stages(spark):
    df = table(spark, swing([0, 30, 0, 4, 0], 2))
    reps = segment.segment_by_peaks(df, df.where(F.col("pose_idx").isin(2, 6)), K, "v", 8.0)
    valid, diag = segment.validate_reps(reps, K, F.lit("bench_press"), 8.0)
    assert valid.count() == 1 and diag.first().rejected_count == 1
    assert segment.stage_frames(df, reps, K, "v").first().stage_3 == 2


def wave(rng, n):
    out, v = [], 0.0
    for _ in range(n):
        v = max(0.0, min(170.0, v + rng.choice([-45, -20, 0, 25, 50])))
        out.append(v + rng.random())
    return out


def test_folds_do_not_depend_on_the_chunk_size(spark):
    rng = random.Random(4)
    df = table(spark, wave(rng, 900), wave(rng, 333), [100.0] * 40 + [20.0] * 300 + [150.0] * 9, fps=10).cache()
    counters = [
        lambda size: cycles.cycles_threshold(df, K, "v", 10.0, size=size),
        lambda size: cycles.cycles_low_high(df, K, "v", 10.0, size=size),
        lambda size: cycles.cycles_adaptive(df, K, "v", 10.0, size=size),
        lambda size: cycles.cycles_hinge(df, K, "v", 10.0, size=size),
        lambda size: cycles.cycles_elbow(df, K, "v", 10.0, 120.0, 60.0, 30.0, size=size),
    ]
    for count in counters:
        whole = spans(count(4096))
        assert whole and whole == spans(count(128))


def test_input_order_does_not_matter(spark):
    rng = random.Random(6)
    v = wave(rng, 200)
    a = table(spark, v, fps=10)
    b = a.orderBy(F.xxhash64("pose_idx")).repartition(5)
    for df in (a, b):
        got = spans(segment.segment_by_peaks(df, detect_repetitions(df, K, "v", 10.0), K, "v", 10.0))
        first = got if df is a else first
    assert got == first and got


def test_idle_stretch_settles_in_a_few_rounds(spark, monkeypatch):
    from cadenza.core import fold

    runs = []
    real = fold.materialise
    monkeypatch.setattr(fold, "materialise", lambda df: runs.append(df.columns) or real(df))
    df = table(spark, [0.0] * 3200 + swing([0, 120, 0], 9), fps=8)
    got = cycles.cycles_threshold(df, K, "v", 8.0, size=32)
    assert len(spans(got)) == 1
    assert sum("_out" in c for c in runs) <= 3
