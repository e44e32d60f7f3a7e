"""Which counter segments which action, and key samples for review."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.session import stored
from cadenza.operators import cycles
from cadenza.operators.peaks import detect_repetitions
from cadenza.operators.segment import REP_COLUMNS, segment_by_peaks

# Flexed elbow angle of the elbow-cycle actions, primary path.
FLEXED = {"lat_pulldown": 90.0, "single_arm_pulldown": 110.0, "single_arm_hammer_row": 110.0}
# The second engine counts these by elbow cycles too.
FLEXED_SECONDARY = FLEXED | {"chest_supported_row": 112.0, "plate_loaded_pulldown": 110.0}
# Peak parameters (ratio, least prominence, distance s, prominence window s).
PEAKS = {
    "machine_chest_press": (0.08, 1.0, 0.75, 1.6),
    "preacher_curl": (0.14, 2.0, 0.65, None), "back_extension": (0.14, 2.0, 0.65, None), "plate_loaded_romanian_deadlift": (0.14, 2.0, 0.65, None),
}
DEFAULT_PEAKS = (0.18, 3.0, 1.0, None)


def _angle(angles: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, angle in angles.items():
        out = F.when(F.col("action_type") == name, angle).otherwise(out)
    return out


def segment(sig: DataFrame, keys: Sequence[str], value: str, fps: float, secondary: bool | str = False) -> DataFrame:
    """Repetitions of every series by the counter of its action.

    ``sig`` holds ``action_type``, ``family`` and the smoothed signal (for hinge
    actions the smoothed line angle).  One branch per algorithm, each over its
    own series only.  ``secondary`` may name a column that is constant per series.
    """
    keys = list(keys)
    action, family = F.col("action_type"), F.col("family")
    second = F.col(secondary) if isinstance(secondary, str) else F.lit(secondary)
    limit = F.when(second, _angle(FLEXED_SECONDARY)).otherwise(_angle(FLEXED))
    elbow = limit.isNotNull()
    adaptive = action.isin("hip_thrust", "plate_loaded_rear_leg_raise")
    hinge = (family == "hinge") & ~adaptive & ~action.isin("back_extension", "plate_loaded_romanian_deadlift")
    found = [
        ("elbow_cycle", cycles.cycles_or_partial(sig.where(elbow).withColumn("flex_at", limit), keys, value, fps, 135.0, "flex_at")),
        ("low_high_cycle", cycles.cycles_low_high(sig.where(action == "y_raise"), keys, value, fps)),
        ("adaptive_cycle", cycles.cycles_adaptive(sig.where(adaptive), keys, value, fps)),
        ("hinge_cycle", cycles.cycles_hinge(sig.where(hinge), keys, value, fps)),
    ]
    rest = sig.where(~elbow & (action != "y_raise") & ~adaptive & ~hinge)
    groups: dict[tuple, list[str]] = {}
    for name, params in PEAKS.items():
        groups.setdefault(params, []).append(name)
    listed = [(p, rest.where(action.isin(names))) for p, names in groups.items()]
    listed.append((DEFAULT_PEAKS, rest.where(~action.isin(list(PEAKS)))))
    for (ratio, least, distance, window), rows in listed:
        tops = detect_repetitions(rows, keys, value, fps, ratio, least, distance, window)
        found.append(("peaks", segment_by_peaks(rows, tops, keys, value, fps)))
    parts = [d.select(*keys, "n", *REP_COLUMNS).withColumn("algorithm", F.lit(name)) for name, d in found]
    return reduce(DataFrame.unionByName, parts)


def segment_engines(sig: DataFrame, keys: Sequence[str], value: str, fps: float) -> DataFrame:
    """``segment`` by the rules of both engines, told apart by ``secondary``, in
    one pass: series that both count alike are counted once."""
    keys, both = list(keys), F.array(F.lit(False), F.lit(True))
    alike = ~F.col("action_type").isin([a for a, angle in FLEXED_SECONDARY.items() if FLEXED.get(a) != angle])
    engines = F.when(alike, F.array(F.lit(False))).otherwise(both)
    rows = stored(sig.withColumn("_alike", alike).withColumn("secondary", F.explode(engines)))
    found = segment(rows, [*keys, "_alike", "secondary"], value, fps, "secondary")
    return found.withColumn("secondary", F.explode(F.when(F.col("_alike"), both).otherwise(F.array("secondary")))).drop("_alike")


def key_samples(sig: DataFrame, reps: DataFrame, keys: Sequence[str], value: str, leaning: Column) -> DataFrame:
    """Sample indexes worth looking at: those of the middle repetition, else the
    deepest lean of a hinge, else thirds of the recording."""
    keys = list(keys)
    count = reps.groupBy(*keys).agg(F.max("rep_index").alias("_m"))
    middle = reps.join(count, keys).where(F.col("rep_index") == F.floor(F.col("_m") / 2) + 1)
    s, k, e = F.col("start_idx"), F.col("key_idx"), F.col("end_idx")
    middle = middle.select(*keys, F.array(s, F.floor((s + k) / 2), k, e).cast("array<bigint>").alias("_rep"))
    top = sig.groupBy(*keys, "n").agg(F.min(F.struct((-F.col(value)).alias("h"), F.col("pose_idx").alias("i")))["i"].alias("_b"))
    n = F.col("n")
    lean = F.array(F.lit(0), F.floor(F.col("_b") / 2), F.col("_b"), n - 1).cast("array<bigint>")
    thirds = F.array(F.lit(0), F.floor(n / 3), F.floor(n * 2 / 3), n - 1).cast("array<bigint>")
    pick = F.coalesce("_rep", F.when(leaning, lean), thirds)
    return top.join(middle, keys, "left").select(*keys, F.array_sort(F.array_distinct(pick)).alias("samples"))
