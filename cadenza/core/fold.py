"""Sequential automata over long series, run chunk by chunk.

A fold reads one bounded chunk (plus a bounded halo), starts from an entry
state and returns events and an exit state.  All chunks first run in parallel
from a neutral state; chunks whose entry turns out to differ from the exit of
their predecessor run again.  The loop ends when every entry equals the exit
before it, so the result is that of one sequential pass, whatever the length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import CHUNK, with_halo
from .session import materialise


DEAD = 2.0


def chunk_rows(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    params: Sequence[str] = (),
    back: int = 0,
    forward: int = 0,
    size: int = CHUNK,
    idx: str = "pose_idx",
    ragged: Sequence[str] = (),
) -> DataFrame:
    """One row per (key, chunk) with the samples of chunk and halo in order; the
    list holds at most ``size + back + forward`` samples."""
    padded = with_halo(df, back, forward, size, idx)
    sample = F.struct(F.col(idx).alias("i"), *values)
    grouped = padded.groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(sample)).alias("_s"),
        F.max("n").alias("n"),
        *[F.max(p).alias(p) for p in params],
    )
    return grouped.select(
        *keys, "chunk", "n", *params,
        F.col("_s.i")[0].alias("_first"),
        *[(F.flatten(f"_s.{v}") if v in ragged else F.col(f"_s.{v}")).alias(f"_a_{v}") for v in values],
        *[F.transform(f"_s.{v}", F.size).alias(f"_a_{v}_len") for v in ragged],
    )


def chunked_fold(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    step: Callable,
    event_type: str,
    params: Sequence[str] = (),
    back: int = 0,
    forward: int = 0,
    size: int = CHUNK,
    idx: str = "pose_idx",
    ragged: Sequence[str] = (),
) -> DataFrame:
    """Run ``step(arrays, first, lo, hi, n, params, state) -> (events, state)``.

    ``arrays`` maps each value name to a NumPy array starting at index
    ``first``; the chunk owns ``[lo, hi)``.  ``state`` is a list of floats, empty
    at the start of a series (and as the neutral guess); ``[DEAD]`` ends the
    search for the rest of the series.  ``ragged`` values are arrays per sample:
    they arrive flattened, with their lengths under ``<name>_len``.
    """
    keys, values, params = list(keys), list(values), list(params)
    names = [*values, *[f"{r}_len" for r in ragged]]
    schema = f"struct<events:array<{event_type}>,state:array<double>>"

    @F.pandas_udf(schema)
    def run(head: pd.DataFrame, arrays: pd.DataFrame, entry: pd.Series) -> pd.DataFrame:
        events, states = [], []
        for row, arr, state in zip(head.itertuples(index=False), arrays.itertuples(index=False), entry):
            lo = int(row.chunk) * size
            hi = min(lo + size, int(row.n))
            state = [] if state is None else list(state)
            given = {p: getattr(row, p) for p in params}
            if state == [DEAD]:
                found, out = [], state
            else:
                found, out = step(dict(zip(names, arr)), int(row.first), lo, hi, int(row.n), given, state)
            events.append(found)
            states.append([float(x) for x in out])
        return pd.DataFrame({"events": events, "state": states})

    head = F.struct("chunk", "n", F.col("_first").alias("first"), *params)
    arrays = F.struct(*[F.col(f"_a_{v}").alias(v) for v in names])
    chunks = materialise(chunk_rows(df, keys, values, params, back, forward, size, idx, ragged))
    neutral = F.array().cast("array<double>")
    narrow = [*keys, "chunk", "n", "_entry", "_out"]
    done = materialise(chunks.withColumn("_entry", neutral).withColumn("_out", run(head, arrays, F.col("_entry"))).select(*narrow))
    series = Window.partitionBy(*keys)
    order = series.orderBy("chunk")
    over = F.array(F.lit(DEAD))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    on = reduce(lambda a, b: a & b, same, F.col("_c") == F.col("chunk"))
    while True:
        # one small row per chunk: the states alone pass through the windows
        states = done.select(*keys, "chunk", "_entry", F.col("_out.state").alias("_exit"))
        states = states.withColumn("_want", F.coalesce(F.lag("_exit").over(order), neutral))
        states = states.withColumn("_stale", F.col("_want") != F.col("_entry"))
        # everything before the first stale chunk is final, so is a search that ended there
        states = states.withColumn("_first_stale", F.min(F.when(F.col("_stale"), F.col("chunk"))).over(series))
        final = F.col("_first_stale").isNull() | (F.col("chunk") < F.col("_first_stale"))
        states = states.withColumn("_ended", F.min(F.when(final & (F.col("_exit") == over), F.col("chunk"))).over(series))
        live = F.col("_ended").isNull() | (F.col("chunk") <= F.col("_ended"))
        states = materialise(states.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("chunk").alias("_c"), "_want", "_stale", live.alias("_live")))
        wanted = states.where(F.col("_stale") & F.col("_live"))
        if wanted.isEmpty():
            kept = states.where("_live").drop("_want", "_stale", "_live")
            return done.join(kept, on, "left_semi").select(*keys, "n", F.inline("_out.events"))
        redo = chunks.join(wanted, on).withColumn("_entry", F.col("_want")).withColumn("_out", run(head, arrays, F.col("_entry")))
        kept = states.where(~F.col("_stale") & F.col("_live")).drop("_want", "_stale", "_live")
        done = materialise(done.join(kept, on, "left_semi").unionByName(redo.select(*narrow)))
