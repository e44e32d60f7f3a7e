"""Chunk layout: results do not depend on the chunk size or on the row order."""

import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.core import quantiles as q
from cadenza.core.layout import islands, scan, spread_join, with_ordinal
from cadenza.core.quantiles import quantiles, ranked_quantiles
from cadenza.operators import smoothing
from cadenza.operators.peaks import peak_candidates, separate

K = ["k"]


def series(spark, lengths, seed=1):
    rng = random.Random(seed)
    rows = []
    for k, n in enumerate(lengths):
        for i in range(n):
            v = None if rng.random() < 0.1 else round(rng.uniform(-50, 120), 2)
            rows.append((k, i, n, 100 * i, v, round(rng.random(), 2)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, pose_idx long, n long, time_ms long, v double, quality double")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_ordinal_matches_sorting(spark):
    rng = random.Random(3)
    data = [(0 if rng.random() < 0.6 else rng.randrange(1, 4), t) for t in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(data, "k int, t int")
    got = with_ordinal(df, K, ["t"], F.floor(F.col("t") / 700)).collect()
    for k in {k for k, _ in data}:
        want = sorted(t for kk, t in data if kk == k)
        mine = sorted((r.pose_idx, r.t, r.n) for r in got if r.k == k)
        assert [t for _, t, _ in mine] == want
        assert [i for i, _, _ in mine] == list(range(len(want))) and {n for _, _, n in mine} == {len(want)}


def test_scan_and_islands_are_chunk_size_free(spark):
    df = series(spark, [37, 5, 1]).cache()
    at = F.when(F.col("v") > 60, F.col("pose_idx"))
    for inclusive in (True, False):
        big = rows(scan(df, K, {"p": at}, {"x": at}, {"s": F.coalesce("v", F.lit(0.0)).cast("decimal(12,2)")}, inclusive), "k", "pose_idx", "p", "x", "s")
        small = rows(scan(df, K, {"p": at}, {"x": at}, {"s": F.coalesce("v", F.lit(0.0)).cast("decimal(12,2)")}, inclusive, size=4), "k", "pose_idx", "p", "x", "s")
        assert big == small
    runs = lambda size: rows(islands(df, K, 2, F.col("v") > 40, size=size).groupBy("k", "island").agg(F.min("pose_idx").alias("a"), F.max("pose_idx").alias("b")), "k", "a", "b")
    assert runs(4096) == runs(3)


def test_smoothing_matches_numpy(spark):
    df = smoothing.interpolate(series(spark, [23, 4, 3, 2]), K, "v", "f").cache()
    for size in (4096, 6):
        got = smoothing.smooth(df, K, "f", 5, size=size).collect()
        for k in range(4):
            mine = sorted((r.pose_idx, r.f, r.smoothed) for r in got if r.k == k)
            v = np.array([f for _, f, _ in mine])
            if len(v) < 3:
                want = v
            else:
                w = max(3, min(5, len(v) if len(v) % 2 else len(v) - 1))
                want = np.convolve(np.pad(v, w // 2, mode="edge"), np.ones(w) / w, mode="valid")[: len(v)]
            assert np.allclose([s for _, _, s in mine], want)


def test_interpolation_matches_numpy(spark):
    df = series(spark, [40, 9]).cache()
    for size in (4096, 5):
        got = smoothing.interpolate(df, K, "v", size=size).collect()
        for k in (0, 1):
            mine = sorted((r.pose_idx, r.v, r.filled) for r in got if r.k == k)
            known = [(i, v) for i, v, _ in mine if v is not None]
            want = np.interp([i for i, _, _ in mine], [i for i, _ in known], [v for _, v in known])
            assert np.allclose([f for _, _, f in mine], want)


def greedy(values, window, prominence, distance):
    """Brute force over the whole series."""
    cand = []
    for i in range(1, len(values) - 1):
        left, right = values[max(0, i - window) : i], values[i + 1 : i + window + 1]
        if values[i] > values[i - 1] and values[i] >= values[i + 1] and values[i] - max(min(left), min(right)) >= prominence:
            cand.append(i)
    kept = []
    for i in sorted(cand, key=lambda j: (-values[j], j)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    return sorted(kept)


def test_peak_separation_is_global_even_in_tiny_chunks(spark):
    rng = random.Random(9)
    # a rising ramp of peaks makes every decision depend on the next one
    ramp = [(i // 2) * 1.0 + (5 if i % 2 else 0) for i in range(90)]
    noise = [round(rng.uniform(0, 100), 1) for _ in range(120)]
    data = [(k, i, len(v), float(x)) for k, v in enumerate((ramp, noise)) for i, x in enumerate(v)]
    df = spark.createDataFrame(data, "k int, pose_idx long, n long, v double")
    for size in (4096, 16):
        got = separate(peak_candidates(df, K, "v", 6, 3.0, size), K, "v", 6, size).collect()
        for k, v in enumerate((ramp, noise)):
            assert sorted(r.pose_idx for r in got if r.k == k) == greedy(v, 6, 3.0, 6)


def test_ranked_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 30, 501), 3), np.array([7.0] * 300 + [1e-14, -2.5, 1e6])
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("a", None)], "k string, v double")
    ps = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    got = {r.k: r for r in ranked_quantiles(df, K, {n: ("v", p) for n, p in ps.items()}).collect()}
    for k, v in (("a", a), ("b", b)):
        for n, p in ps.items():
            assert abs(got[k][n] - np.percentile(v, 100 * p)) < 1e-9, (k, n)


def test_spread_join_reaches_every_chunk(spark):
    df = series(spark, [33, 2])
    stats = df.groupBy("k", "n").agg(F.max("pose_idx").alias("m"))
    assert spread_join(df, stats, K, size=4).where("m = n - 1").count() == 35


def test_quantiles_do_not_depend_on_the_path(spark, monkeypatch):
    rng = random.Random(8)
    data = [("near", 0.5 + rng.random() * 1e-4) for _ in range(3000)] + [("same", 0.25)] * 40 + [("none", None)] * 3 + [("nan", float("nan"))] + [("one", -3.0)]
    data += [("wide", rng.gauss(0, 1) * 10 ** rng.randint(-6, 6)) for _ in range(2000)]
    sizes = {k: sum(x == k for x, _ in data) for k, _ in data}
    df = spark.createDataFrame([(k, sizes[k], v) for k, v in data], "k string, n long, v double")
    specs = {"a": ("v", 0.05), "b": ("v", 0.5), "c": (F.col("v") * 2, 0.951), "d": (F.col("v") * 2 + 1, 1.0)}
    rows = lambda short: sorted(map(tuple, quantiles(df, ["k", "n"], specs, short=short).collect()))
    direct = rows(10**9)
    assert {r[0] for r in direct} == set(sizes) and [r[2:] for r in direct if r[0] == "none"] == [(None,) * 4]
    assert rows(0) == direct == rows(100)
    monkeypatch.setattr(q, "WIDE", 10)
    monkeypatch.setattr(q, "PARTS", 8)
    assert rows(0) == direct
