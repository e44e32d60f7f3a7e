"""Compare registered queries with their DuckDB counterparts on one data folder."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if v is not None and type(v).__name__ == "Decimal":
        return float(v)
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, d, name, fn, sql):
    start = time.time()
    df = fn(spark, d)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"rows-only {len(got[1])}", took
    cur = con.execute(sql)
    want = table([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", took
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} != {len(want[1])}", took
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return False, f"{len(bad)}/{len(got[1])} differ, e.g.\n   spark {bad[0][0]}\n   duck  {bad[0][1]}", took
    return True, f"{len(got[1])} rows", took


def main(argv):
    from cadenza.core.session import build_session
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            d = a
        else:
            names.append(a)
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, note, took = compare(spark, con, d, name, fn, oracles.get(name))
        except Exception as error:  # report and go on
            ok, note, took = False, f"{type(error).__name__}: {str(error).splitlines()[0][:400]}", 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.2f}s {note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
