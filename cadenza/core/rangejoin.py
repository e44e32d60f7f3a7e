"""Interval and top-k helpers that never build a cross product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_slot(col: Column, width: int) -> Column:
    return F.floor(col / F.lit(width)).cast("long")


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    width: int,
    how: str = "left",
    closed: bool = True,
) -> DataFrame:
    """Join points to the intervals that contain them.

    Intervals are copied to the fixed-width time slots they touch, so the join
    is an equi join on (key, slot) and a hot key is spread over its slots.
    """
    keys = list(keys)
    slots = F.sequence(time_slot(F.col(start), width), time_slot(F.col(end), width))
    right = intervals.where(F.col(start) <= F.col(end)).withColumn("_slot", F.explode(slots))
    left = points.withColumn("_slot", time_slot(F.col(at), width))
    l, r = left.alias("l"), right.alias("r")
    upper = F.col(f"r.{end}") >= F.col(f"l.{at}") if closed else F.col(f"r.{end}") > F.col(f"l.{at}")
    on = (F.col("l._slot") == F.col("r._slot")) & (F.col(f"r.{start}") <= F.col(f"l.{at}")) & upper
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    extra = [c for c in intervals.columns if c not in keys]
    return l.join(r, on, how).select(
        *[F.col(f"l.{c}") for c in points.columns], *[F.col(f"r.{c}").alias(c) for c in extra]
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = 64,
          rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key.  A salted first pass keeps at most ``k`` rows
    per (key, salt), so the final ranking sees at most ``salts * k`` rows."""
    keys = list(keys)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    return (
        kept.drop("_salt", "_r").withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= k)
    )


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Whole row with the smallest ``order`` per key, as a partial aggregate."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    row = F.struct(*rest)
    return df.groupBy(*keys).agg(F.min_by(row, ranked).alias("_row")).select(*keys, "_row.*").select(*df.columns)
