import random

import pytest

from cadenza.core import sweep


def tables(spark, seed, n_points, n_spans, top):
    r = random.Random(seed)
    points = [(r.randrange(2), r.randrange(top), k) for k in range(n_points)]
    spans = [(r.randrange(2), s, s + r.choice([-5, 0, 1, 3, 20, top // 2]), k) for k in range(n_spans) for s in [r.randrange(-10, top)]]
    return points, spans, spark.createDataFrame(points, "k long, t long, no long").repartition(3), spark.createDataFrame(spans, "k long, a long, b long, rep long").repartition(3)


@pytest.mark.parametrize("width", [7, 64, sweep.SLOT])
@pytest.mark.parametrize("n_spans, top", [(0, 50), (12, 200), (150, 300)])
def test_sweep_equals_looking_at_all_intervals(spark, width, n_spans, top):
    points, spans, p, s = tables(spark, n_spans + width, 300, n_spans, top)
    first = {(k, no): min(((a, rep, b) for q, a, b, rep in spans if q == k and a <= t <= b), default=None) for k, t, no in points}
    got = sweep.first_covering(p, s, ["k"], ["rep"], ["a", "rep", "b"], "t", "a", "b", width).collect()
    assert len(got) == len(points) and {(r["k"], r["no"]): (r["a"], r["rep"], r["b"]) if r["rep"] is not None else None for r in got} == first
    for closed in (False, True):
        want = {(k, no): any(q == k and a <= t and (t <= b if closed else t < b) for q, a, b, _ in spans) for k, t, no in points}
        flags = sweep.flag_covered(p, s, ["k"], "hit", "t", "a", "b", closed, width).collect()
        assert {(r["k"], r["no"]): r["hit"] for r in flags} == want


def rows_made(df):
    """Greatest number of rows that any operator of the executed plan gives out."""
    df.collect()
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
            continue
        if hasattr(plan, "plan") and plan.getClass().getSimpleName().endswith("QueryStageExec"):
            plans.append(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        if metric.isDefined():
            most = max(most, metric.get().value())
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return most


def test_a_thousand_intervals_over_one_instant(spark):
    """Rows handled are points plus intervals, not their product."""
    p = spark.range(5000).selectExpr("1L as k", "id as t", "id as no")
    s = spark.range(1000).selectExpr("1L as k", "id as a", "4000 + id as b", "1000 - id as rep")
    found = sweep.first_covering(p, s, ["k"], ["rep"], ["rep"], "t", "a", "b", 256)
    rows = found.collect()
    assert {r["t"]: r["rep"] for r in rows} == {t: (1000 if t <= 4000 else 1000 - (t - 4000)) if t <= 4999 else None for t in range(5000)}
    assert 0 < rows_made(sweep.first_covering(p, s, ["k"], ["rep"], ["rep"], "t", "a", "b", 256)) <= 6000
    assert 0 < rows_made(sweep.flag_covered(p, s, ["k"], "hit", "t", "a", "b", False, 256)) <= 6000
