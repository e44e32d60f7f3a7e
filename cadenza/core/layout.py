"""Skew-proof layout of ordered series.

A series (one video, one user, one sensor) can hold any share of all rows, so
no operator here partitions by the series key alone.  Rows carry a dense index
``pose_idx`` and the series length ``n``; the index is cut into chunks of a
fixed number of rows and ``(key, chunk)`` is the unit of work.  Three idioms
cover every ordered operator:

* ``with_halo``  - bounded look-around: border rows are copied to neighbours;
* ``scan``       - unbounded look-back/ahead: one summary row per chunk;
* ``spread_join``- per-series values joined at chunk grain.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def chunk_index(idx: str | Column, size: int = CHUNK) -> Column:
    col = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(col / F.lit(size)).cast("long")


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    idx: str = "pose_idx",
    n: str = "n",
) -> DataFrame:
    """Dense 0-based position and series length without one task per key.

    ``bucket`` must be monotone in ``order`` (a time slice, an index range):
    rows are ranked inside their bucket, bucket sizes are pre-aggregated and
    turned into offsets.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(per_key).alias(n),
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    ranked = rows.withColumn("_rank", rank)
    return (
        ranked.join(offsets, [*keys, "_bucket"])
        .withColumn(idx, (F.col("_offset") + F.col("_rank") - 1).cast("long"))
        .drop("_bucket", "_offset", "_rank")
    )


def with_halo(
    df: DataFrame,
    back: int,
    forward: int,
    size: int = CHUNK,
    idx: str = "pose_idx",
    n: str = "n",
) -> DataFrame:
    """Copy each row to every chunk that has to see it; ``_core`` marks the owner."""
    first = F.floor((F.col(idx) - forward) / F.lit(size))
    last = F.floor((F.col(idx) + back) / F.lit(size))
    top = F.floor((F.col(n) - 1) / F.lit(size))
    span = F.sequence(F.greatest(first, F.lit(0)).cast("long"), F.least(last, top).cast("long"))
    return df.withColumn("chunk", F.explode(span)).withColumn(
        "_core", F.col("chunk") == chunk_index(idx, size)
    )


def chunk_window(keys: Sequence[str], idx: str = "pose_idx"):
    return Window.partitionBy(*keys, "chunk").orderBy(idx)


def over_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Callable[[object], Column]],
    back: int,
    forward: int,
    size: int = CHUNK,
    idx: str = "pose_idx",
) -> DataFrame:
    """Add window columns whose frame reaches at most ``back``/``forward`` rows.

    Each value of ``columns`` receives the ordered chunk window.
    """
    w = chunk_window(keys, idx)
    padded = with_halo(df, back, forward, size, idx)
    built = padded.select("*", *[make(w).alias(name) for name, make in columns.items()])
    return built.where("_core").drop("_core", "chunk")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    prev: dict[str, Column] | None = None,
    next_: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    inclusive: bool = True,
    size: int = CHUNK,
    idx: str = "pose_idx",
) -> DataFrame:
    """Unbounded look-around in one pass.

    ``prev`` / ``next_``: nearest non-null value at or before / at or after a row
    (strictly when not ``inclusive``).  ``totals``: inclusive running sums.
    Inside a chunk these are windows; across chunks they are windows over one
    summary row per chunk, built by partial aggregation before any shuffle.
    Looking ahead is looking back in descending order: a frame up to the end is
    worked out anew for every row, so it costs the square of the chunk.
    """
    keys, prev, next_, totals = list(keys), prev or {}, next_ or {}, totals or {}
    rows = df.withColumn("chunk", chunk_index(idx, size))
    rows = rows.select(
        "*",
        *[c.alias(f"_p_{k}") for k, c in prev.items()],
        *[c.alias(f"_n_{k}") for k, c in next_.items()],
        *[c.alias(f"_t_{k}") for k, c in totals.items()],
    )
    near = 0 if inclusive else 1
    w = chunk_window(keys, idx)
    w_prev = w.rowsBetween(Window.unboundedPreceding, -near)
    w_next = Window.partitionBy(*keys, "chunk").orderBy(F.col(idx).desc()).rowsBetween(Window.unboundedPreceding, -near)
    w_sum = w.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        "*",
        *[F.last(f"_p_{k}", True).over(w_prev).alias(f"_lp_{k}") for k in prev],
        *[F.last(f"_n_{k}", True).over(w_next).alias(f"_ln_{k}") for k in next_],
        *[F.sum(f"_t_{k}").over(w_sum).alias(f"_lt_{k}") for k in totals],
    )
    at = F.col(idx)
    known = lambda c: F.when(F.col(c).isNotNull(), at)
    summary = rows.groupBy(*keys, "chunk").agg(
        *[F.max_by(f"_p_{k}", known(f"_p_{k}")).alias(f"_sp_{k}") for k in prev],
        *[F.min_by(f"_n_{k}", known(f"_n_{k}")).alias(f"_sn_{k}") for k in next_],
        *[F.sum(f"_t_{k}").alias(f"_st_{k}") for k in totals],
    )
    by_chunk = Window.partitionBy(*keys).orderBy("chunk")
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    incoming = summary.select(
        *keys,
        "chunk",
        *[F.last(f"_sp_{k}", True).over(earlier).alias(f"_cp_{k}") for k in prev],
        *[F.last(f"_sn_{k}", True).over(later).alias(f"_cn_{k}") for k in next_],
        *[F.sum(f"_st_{k}").over(earlier).alias(f"_ct_{k}") for k in totals],
    )
    joined = local.join(incoming, [*keys, "chunk"], "left")
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_lp_{k}", f"_cp_{k}").alias(k) for k in prev],
        *[F.coalesce(f"_ln_{k}", f"_cn_{k}").alias(k) for k in next_],
        *[
            (F.coalesce(f"_lt_{k}", zero) + F.coalesce(f"_ct_{k}", zero)).alias(k)
            for k in totals
        ],
    )


def carry(df, keys, prev=None, next_=None, inclusive=True, size=CHUNK, idx="pose_idx") -> DataFrame:
    """``scan`` without running totals."""
    return scan(df, keys, prev, next_, None, inclusive, size, idx)


def running_total(df, keys, totals, size=CHUNK, idx="pose_idx") -> DataFrame:
    """``scan`` with running totals only."""
    return scan(df, keys, totals=totals, size=size, idx=idx)


def spread_join(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    size: int = CHUNK,
    idx: str = "pose_idx",
    n: str = "n",
) -> DataFrame:
    """Join one row per series (with its length ``n``) to the series rows.

    The per-series row is copied to each chunk of its series, so a long series
    meets its statistics in as many tasks as it has chunks.
    """
    keys = list(keys)
    top = F.floor((F.col(n) - 1) / F.lit(size)).cast("long")
    small = stats.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), top))).drop(n)
    return (
        df.withColumn("chunk", chunk_index(idx, size)).join(small, [*keys, "chunk"], how).drop("chunk")
    )


def without_series(
    df: DataFrame,
    done: DataFrame,
    keys: Sequence[str],
    size: int = CHUNK,
    idx: str = "pose_idx",
) -> DataFrame:
    """Rows of the series that are not in ``done`` (key and ``n``), decided at
    chunk grain so that no long series is shuffled to one place."""
    keys = list(keys)
    top = F.floor((F.col("n") - 1) / F.lit(size)).cast("long")
    small = done.select(*keys, "n").distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("chunk"))
    return df.withColumn("chunk", chunk_index(idx, size)).join(small, [*keys, "chunk"], "left_anti").drop("chunk")


def islands(
    df: DataFrame,
    keys: Sequence[str],
    max_gap: int = 0,
    active: Column | None = None,
    changed: Column | None = None,
    size: int = CHUNK,
    idx: str = "pose_idx",
) -> DataFrame:
    """Number runs of rows: active rows at most ``max_gap`` inactive rows apart,
    or (``changed`` given) rows between change flags.  Adds ``island``."""
    if changed is None:
        marked = df.withColumn("_at", F.when(active, F.col(idx)))
        marked = carry(marked, keys, prev={"_last": F.col("_at")}, inclusive=False, size=size, idx=idx)
        rows = marked.where(F.col("_at").isNotNull())
        flag = F.when(
            F.col("_last").isNull() | (F.col(idx) - F.col("_last") - 1 > max_gap), 1
        ).otherwise(0)
    else:
        rows, flag = df, F.when(changed, 1).otherwise(0)
    out = running_total(rows, keys, {"island": flag}, size, idx)
    return out.drop("_at", "_last")
