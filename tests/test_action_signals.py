"""Signals of many actions over the same frames, and looking ahead in long series."""

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from cadenza.core.layout import scan


def test_look_ahead_is_one_pass(spark):
    rows = [(k, i, None if i % 5 or k == 3 else i * 10 + k) for k in (1, 2, 3) for i in range(40 * k)]
    df = spark.createDataFrame(rows, "k int, pose_idx long, v long")
    known = F.when(F.col("v").isNotNull(), F.col("v"))
    for inclusive in (True, False):
        out = scan(df, ["k"], {"back": known}, {"ahead": known}, inclusive=inclusive, size=16)
        # a frame up to the end is summed anew for every row
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.k, r.pose_idx): (r.back, r.ahead) for r in out.collect()}
        near = 0 if inclusive else 1
        for k, i, _ in rows:
            back = [v for kk, j, v in rows if kk == k and j <= i - near and v is not None]
            ahead = [v for kk, j, v in rows if kk == k and j >= i + near and v is not None]
            assert got[k, i] == (back[-1] if back else None, ahead[0] if ahead else None)


def test_actions_multiply_only_finished_signals(spark, monkeypatch):
    """No stored table may hold the frames once per action."""
    d, sizes = "/root/testdata/sf0.01", []
    checkpoint, parquet = DataFrame.checkpoint, DataFrameWriter.parquet

    def counted_checkpoint(df, eager=True):
        out = checkpoint(df, eager)
        sizes.append(out.count())
        return out

    def counted_parquet(writer, path, *args, **kwargs):
        parquet(writer, path, *args, **kwargs)
        sizes.append(spark.read.parquet(path).count())

    monkeypatch.setattr(DataFrame, "checkpoint", counted_checkpoint)
    monkeypatch.setattr(DataFrameWriter, "parquet", counted_parquet)
    out = entry.queries()["x3_action_signals"](spark, d)
    monkeypatch.undo()
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    assert out.count() == 37 * n
    assert sizes and max(sizes) <= 4 * n
