"""Components over long paths."""

from cadenza.llm.graph import connected_components


def test_size_estimates_do_not_multiply_over_the_rounds(spark):
    n = 500
    path = spark.createDataFrame([((k * 7919) % 1009, ((k + 1) * 7919) % 1009) for k in range(n)], "a long, b long")
    found = connected_components(path)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 30
    rows = found.collect()
    assert len(rows) == n + 1 and len({r.node for r in rows}) == n + 1
    assert {r.root for r in rows} == {min(r.node for r in rows)}
