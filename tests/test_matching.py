import bisect
import random

from cadenza.operators import evaluation

SCHEMA = "case_id int, start_ms long, end_ms long"


def greedy(expected, predicted):
    """Matches by a plain walk; the later predicted range wins a tie."""
    p = sorted(predicted)
    starts, longest = [s for s, _ in p], max((b - a for a, b in p), default=0)
    used, out = set(), []
    for e in sorted(expected):
        best = (0.0, -1)
        for i in range(bisect.bisect_left(starts, e[0] - longest), bisect.bisect_left(starts, e[1])):
            over = min(e[1], p[i][1]) - max(e[0], p[i][0])
            if i not in used and over > 0:
                best = max(best, (over / (max(e[1], p[i][1]) - min(e[0], p[i][0])), i))
        if best[1] >= 0:
            used.add(best[1])
            out.append((e, p[best[1]]))
    return sorted(out)


def matches(spark, e, p, **more):
    make = lambda xs: spark.createDataFrame([(1, a, b) for a, b in xs], SCHEMA)
    got = evaluation.boundary_match(make(e), make(p), ["case_id"], **more).collect()
    return sorted(((r.expected_start, r.expected_end), (r.predicted_start, r.predicted_end)) for r in got)


def test_overlap_pairs_are_all_and_once(spark):
    rng = random.Random(5)
    draw = lambda: [(s, s + rng.choice([0, 1, 2, 7, 64, 1000, 30_000])) for s in (rng.randrange(0, 40_000) for _ in range(150))]
    e, p = draw(), draw()
    make = lambda xs: spark.createDataFrame([(1, a, b, k) for k, (a, b) in enumerate(xs)], SCHEMA + ", no long")
    got = sorted((r.e, r.p) for r in evaluation.overlap_pairs(make(e), make(p), ["case_id"]).collect())
    assert got == sorted((i, k) for i, a in enumerate(e) for k, b in enumerate(p) if min(a[1], b[1]) > max(a[0], b[0]))


def test_one_cluster_of_twenty_thousand_ranges(spark):
    rng = random.Random(6)
    draw = lambda: [(s, s + rng.randrange(400, 1500)) for s in (rng.randrange(0, 2_500_000) for _ in range(10_000))]
    e, p = draw(), draw()
    assert matches(spark, e, p) == greedy(e, p)


def test_a_chain_over_many_chunks(spark):
    # every range prefers the one its predecessor holds, so one choice decides all
    e = [(100 * k, 100 * k + 100) for k in range(60)]
    p = [(100 * k + 55, 100 * k + 155) for k in range(-1, 60)]
    assert matches(spark, e, p, size=16) == greedy(e, p)
    assert matches(spark, e, p, size=16) == matches(spark, e, p)


def test_ties_repeats_and_empty_tables(spark):
    e, p = [(0, 100), (0, 100), (50, 50), (300, 400)], [(0, 100), (0, 100), (0, 100), (50, 50)]
    assert matches(spark, e, p) == greedy(e, p) == [((0, 100), (0, 100))] * 2
    assert matches(spark, [], p) == matches(spark, e, []) == []
