"""Interval stabbing by sweep: starts and points merged in time order.

What a point needs to know of the intervals that began before it is a running
value: the greatest end so far tells whether any is open, and an interval that
is open at a point nobody earlier covers is the first one there.  Running
values are windows inside a time slot and one summary row per slot across
slots, so no interval is copied to the slots it spans and no point meets the
intervals one by one: rows handled are points plus intervals, however many
intervals lie over one instant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = 4096  # time units of a chunk


def _running(rows: DataFrame, keys: list[str], order: Sequence[str], at: str, width: int, value: Column, last: bool, strictly: bool) -> DataFrame:
    """Adds ``_run``: greatest (or, with ``last``, latest) non-null value of the
    rows up to a row (before it, if ``strictly``) in the order (at, *order)."""
    rows = rows.withColumn("_value", value).withColumn("_slot", F.floor(F.col(at) / F.lit(width)).cast("long"))
    upto = Window.partitionBy(*keys, "_slot").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    place = F.when(F.col("_value").isNotNull(), F.struct(at, *order))
    ends = rows.groupBy(*keys, "_slot").agg((F.max_by("_value", place) if last else F.max("_value")).alias("_of_slot"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.select(*keys, "_slot", (F.last("_of_slot", True) if last else F.max("_of_slot")).over(before).alias("_known"))
    local = rows.withColumn("_local", (F.last("_value", True) if last else F.max("_value")).over(upto))
    joined = local.join(known, [*keys, "_slot"])
    run = F.coalesce("_local", "_known") if last else F.greatest("_local", "_known")
    return joined.withColumn("_run", run).drop("_value", "_slot", "_local", "_known")


def flag_covered(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], out: str, at: str = "time_ms",
    start: str = "start_ms", end: str = "end_ms", closed: bool = False, width: int = SLOT,
) -> DataFrame:
    """``points`` with the boolean ``out``: does any interval of the key hold
    the point (its end too, if ``closed``)?  Keys and times are not null;
    repeated points and intervals are fine; intervals that end before they
    start hold nothing."""
    keys = list(keys)
    spans = intervals.where(F.col(start) <= F.col(end)).select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(end).alias("_end"))
    rows = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    both = _running(spans.unionByName(rows, allowMissingColumns=True), keys, ["_kind"], "_at", width, F.col("_end"), False, False)
    open_ = F.col("_run") >= F.col("_at") if closed else F.col("_run") > F.col("_at")
    return both.where("_kind = 1").select("_row.*", F.coalesce(open_, F.lit(False)).alias(out))


def first_covering(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
    at: str = "time_ms", start: str = "start_ms", end: str = "end_ms", width: int = SLOT,
) -> DataFrame:
    """``points`` with ``payload`` of the first closed interval, by (start,
    *order), that holds the point; nulls where none does.

    The k-th interval is the first one just behind the greatest end of those
    before it, up to its own end: these stretches do not overlap, so a point
    takes the latest stretch that began before it and looks at its end."""
    keys = list(keys)
    spans = intervals.where(F.col(start) <= F.col(end))
    reached = _running(spans, keys, list(order), start, width, F.col(end), False, True)
    inner = F.coalesce(F.col("_run") >= F.col(start), F.lit(False))  # begins behind an earlier end, which is not its own
    shown = reached.where(F.col("_run").isNull() | (F.col(end) > F.col("_run"))).select(
        *keys, F.when(inner, F.col("_run")).otherwise(F.col(start)).alias("_at"), F.when(inner, 2).otherwise(0).alias("_kind"),
        F.struct(F.col(end).alias("_end"), *payload).alias("_span"),
    )
    rows = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    both = _running(shown.unionByName(rows, allowMissingColumns=True), keys, ["_kind"], "_at", width, F.col("_span"), True, False)
    held = F.when(F.col("_run._end") >= F.col("_at"), F.col("_run")).alias("_held")
    found = both.where("_kind = 1").select("_row", held)
    return found.select("_row.*", *[F.col(f"_held.{c}").alias(c) for c in payload])
