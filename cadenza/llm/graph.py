"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.session import stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = stored(e.groupBy("a").agg(F.min("b").alias("m")))
    moved = e.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: columns a, b (long, any order, repeats allowed).  Returns one
    row (node, root) per node that has a link; root is the least node reached.

    Each round keeps at most as many edges as before, and rounds grow with the
    logarithm of the longest path.  Edges and per-node minima are written to
    the shared checkpoint folder, so a hub's join reads plain exchanges that
    the adaptive planner can split, and a lost executor costs a re-read.  They
    are Parquet tables: those have the size of their files, where a checkpoint
    keeps the estimate of its plan, which joins multiply round by round until
    the number alone fills the driver."""
    e = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = _digest(e)
        if now == seen or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        seen = now
        e = stored(_small_star(stored(_large_star(e))))
