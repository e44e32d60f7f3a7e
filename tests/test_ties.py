"""Results that hang on the last bit of a threshold."""

import random

import duckdb

from cadenza.core.quantiles import quantiles, ranked_quantiles
from cadenza.plans import catalog

LEVELS = {"p25": 0.25, "p30": 0.3, "p78": 0.78, "p80": 0.8}


def test_percentiles_equal_the_sql_ones_to_the_last_bit(spark):
    rng = random.Random(2)
    data = []
    for k in range(300):
        size = rng.randint(4, 99)
        data += [(k, size, round(rng.expovariate(1 / 50), 2)) for _ in range(size)]
    df = spark.createDataFrame(data, "k int, n long, v double")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INT, n BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", data)
    want = con.execute(f"SELECT k, {', '.join(f'quantile_cont(v, {p})' for p in LEVELS.values())} FROM t GROUP BY 1 ORDER BY 1").fetchall()
    specs = {name: ("v", p) for name, p in LEVELS.items()}
    for got in (quantiles(df, ["k"], specs), ranked_quantiles(df, ["k"], specs)):
        assert sorted(map(tuple, got.collect())) == want


def test_capture_quality_at_a_limit_does_not_hang_on_row_order(spark, tmp_path):
    rng = random.Random(4)
    data, want = [], {}
    inverse = {i * 37 % 100: i for i in range(100)}
    for user in range(60):
        limit = 55 if user % 2 else 38
        half = [rng.randrange(2 * limit - 99, 100) if limit > 50 else rng.randrange(0, 2 * limit + 1) for _ in range(rng.randint(8, 40))]
        marks = half + [2 * limit - h for h in half]  # mean is the limit
        rng.shuffle(marks)
        data += [(inverse[m] + 100 * rng.randrange(1000), user, "view") for m in marks]
        want[user] = "good" if limit == 55 else "limited"
    spark.createDataFrame(data, "event_id long, user_id long, event_type string").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.capture_quality for r in catalog.queries()["p11_capture_quality"](spark, str(tmp_path)).collect()}
    assert got == want
