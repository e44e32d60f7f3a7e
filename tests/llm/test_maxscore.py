import math
import random

from cadenza.llm import maxscore


def slow(rows, every, k):
    q = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for n, (i, a) in enumerate(q):
        if i % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), j) for m, (j, b) in enumerate(q) if m != n)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, every=10, k=5):
    return sorted(tuple(r) for r in maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every, k).collect())


def test_equals_brute_force_over_shards(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 64)
    monkeypatch.setattr(maxscore, "BLOCK", 16)
    monkeypatch.setattr(maxscore, "QUERIES", 8)
    r = random.Random(6)
    rows = [(i, [round(r.gauss(0, 1) * 8) / 64 for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]
    assert run(spark, rows) == slow(rows, 10, 5)


def test_repeated_ids_stay_candidates(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 8)
    rows = [(0, [1.0, 0.5]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (0, [1.0, 0.5]), (0, [2.0, 1.0])] + [(20, [0.5, k / 8]) for k in range(40)] + [(30, [1.0, 1.0])] * 30
    got = run(spark, rows)
    assert got == slow(rows, 10, 5) and (0, 1, 1, 3 * 1024 * 1024) in got
    named = spark.createDataFrame([(*r, 1, "g", "p", 2) for r in rows], "vec_id long, embedding array<float>, part int, `group` string, place string, copy int")
    assert sorted(tuple(r) for r in maxscore.top_k(named, 10, 5).collect()) == got


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0]), (7, [-1.0, -2.0]), (10, [0.0, 0.0]), (10, [0.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0])]
    assert run(spark, rows) == slow(rows, 10, 5)
    assert run(spark, []) == [] and run(spark, [(3, [1.0])]) == [] and run(spark, [(0, [1.0])]) == []
