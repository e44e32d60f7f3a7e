"""Time and interval joins between frames, repetitions, issues and priors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.layout import scan, spread_join
from cadenza.core.rangejoin import range_join, time_slot
from cadenza.core.sweep import first_covering

SLOT_MS = 1000


def nearest_within(points: DataFrame, targets: DataFrame, keys: Sequence[str], at: str, target_at: str,
                   tolerance: int, point_id: str) -> DataFrame:
    """For every point the nearest target at most ``tolerance`` away (the earlier
    one on ties).  Points look into the three slots they can reach."""
    keys = list(keys)
    width = max(1, 2 * tolerance)
    near = F.array_distinct(F.array(time_slot(F.col(at) - tolerance, width), time_slot(F.col(at) + tolerance, width)))
    left = points.select(*keys, point_id, F.col(at).alias("_at"), F.explode(near).alias("_slot"))
    right = targets.select(*keys, F.col(target_at).alias("_hit"), time_slot(F.col(target_at), width).alias("_slot"))
    close = left.join(right, [*keys, "_slot"]).where(F.abs(F.col("_at") - F.col("_hit")) <= tolerance)
    best = F.min(F.struct(F.abs(F.col("_at") - F.col("_hit")).alias("d"), F.col("_hit").alias("h")))
    return close.groupBy(*keys, point_id).agg(best["h"].alias(target_at))


def apply_priors(frames: DataFrame, priors: DataFrame, keys: Sequence[str] = ("video_id",), frame_tolerance: int = 2,
                 time_tolerance_ms: int = 180) -> DataFrame:
    """Blend keypoint priors into their nearest frames.

    ``priors``: prior_id (input order), frame_index or time_ms, slot, x, y, z,
    conf; one row per point.  A weak point is replaced, a strong one (visibility
    at least .82) moves 65 % towards the prior; priors of one frame apply in order.
    """
    keys = list(keys)
    heads = priors.select(*keys, "prior_id", "frame_index", "time_ms").distinct()
    by_frame = nearest_within(heads.where(F.col("frame_index").isNotNull()), frames, keys, "frame_index", "frame_index", frame_tolerance, "prior_id")
    timed = heads.where(F.col("frame_index").isNull() & F.col("time_ms").isNotNull())
    by_time = nearest_within(timed, frames, keys, "time_ms", "time_ms", time_tolerance_ms, "prior_id")
    by_time = by_time.join(frames.select(*keys, "time_ms", "frame_index"), [*keys, "time_ms"]).select(*keys, "prior_id", "frame_index")
    target = by_frame.select(*keys, "prior_id", "frame_index").unionByName(by_time)
    points = priors.drop("frame_index", "time_ms").join(target, [*keys, "prior_id"])
    point = F.struct("prior_id", "x", "y", "z", "conf")
    # points of one landmark of one frame: as many as priors name that very point
    per_slot = points.groupBy(*keys, "frame_index", "slot").agg(F.array_sort(F.collect_list(point)).alias("ps"))
    per_frame = per_slot.groupBy(*keys, "frame_index").agg(F.map_from_entries(F.collect_list(F.struct("slot", "ps"))).alias("_priors"))
    joined = frames.join(per_frame, [*keys, "frame_index"], "left")

    def step(p: Column, q: Column) -> Column:
        mix = lambda f: F.lit(0.35) * p[f] + F.lit(0.65) * q[f]
        fresh = F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"), q["conf"].alias("vis"))
        moved = F.struct(mix("x").alias("x"), mix("y").alias("y"), mix("z").alias("z"), F.greatest(p["vis"], q["conf"]).alias("vis"))
        return F.when(p["vis"] < 0.82, fresh).otherwise(moved)

    merged = F.transform(
        "landmarks",
        lambda p, i: F.when(
            F.col("_priors").isNotNull() & F.map_contains_key("_priors", i), F.aggregate(F.col("_priors")[i], p, step)
        ).otherwise(p),
    )
    return joined.withColumn("landmarks", merged).drop("_priors").select(*frames.columns)


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], payload: Sequence[str], slot_ms: int = 60_000) -> DataFrame:
    """Closest right row by ``time_ms`` for every left row, earlier one on ties,
    without tolerance: both sides are merged and looked up by carrying values."""
    keys = list(keys)
    side = F.struct(*[F.col(c) for c in ("time_ms", *payload)])
    l = left.select(*keys, (F.col("time_ms") * 2 + 1).alias("_at"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    r = right.select(*keys, (F.col("time_ms") * 2).alias("_at"), side.alias("_r"))
    both = l.drop("_r").unionByName(r, allowMissingColumns=True)
    both = scan(both, keys, {"_b": F.col("_r")}, {"_a": F.col("_r")}, size=2 * slot_ms, idx="_at").where(F.col("_l").isNotNull())
    t = F.col("_l.time_ms")
    earlier = F.col("_a").isNull() | (t - F.col("_b.time_ms") <= F.col("_a.time_ms") - t)
    pick = F.when(F.col("_b").isNotNull() & earlier, F.col("_b")).otherwise(F.coalesce("_a", "_b"))
    return both.withColumn("_x", pick).select("_l.*", F.col("_x.time_ms").alias("match_ms"), *[F.col(f"_x.{p}").alias(p) for p in payload])


def phase_timeline(frames: DataFrame, reps: DataFrame, keys: Sequence[str], key_window_ms: int | None) -> DataFrame:
    """Repetition and phase of every frame: the first repetition (by start) whose
    closed interval holds it.  Without a key window there is no ``key`` phase."""
    keys = list(keys)
    one = first_covering(frames.select(*keys, "pose_idx", "time_ms"), reps, keys, ["rep_index"], ["rep_index", "key_ms"])
    t, k = F.col("time_ms"), F.col("key_ms")
    phase = F.when(F.col("rep_index").isNull(), "between_reps")
    if key_window_ms is not None:
        phase = phase.when(F.abs(t - k) <= key_window_ms, "key").when(t < k, "to_key")
    else:
        phase = phase.when(t <= k, "to_key")
    return one.select(*keys, "pose_idx", "time_ms", "rep_index", phase.otherwise("return").alias("phase"))


def frame_issue(timeline: DataFrame, issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First issue that applies to a frame: one of its time ranges holds the
    frame, or it has no ranges and names the frame's repetition.

    ``issues``: issue_no (order), code, ranges ARRAY<STRUCT<start_ms,end_ms>>, reps ARRAY.
    """
    keys = list(keys)
    spans = issues.select(*keys, "issue_no", "code", F.explode("ranges").alias("r")).select(*keys, "issue_no", "code", "r.start_ms", "r.end_ms")
    timed = range_join(timeline, spans, keys, "time_ms", "start_ms", "end_ms", SLOT_MS, "inner")
    loose = issues.where(F.size("ranges") == 0).select(*keys, "issue_no", "code", F.explode("reps").alias("rep_index"))
    named = timeline.where(F.col("rep_index").isNotNull()).join(loose, [*keys, "rep_index"])
    cols = [*keys, "pose_idx", "issue_no", "code"]
    found = timed.select(*cols).unionByName(named.select(*cols))
    best = found.groupBy(*keys, "pose_idx").agg(F.min(F.struct("issue_no", "code")).alias("i"))
    return timeline.join(best, [*keys, "pose_idx"], "left").select(*timeline.columns, F.col("i.code").alias("issue_code"))


def frame_notes(frames: DataFrame, reps: DataFrame, issues: DataFrame, keys: Sequence[str], key_window_ms: int = 260) -> DataFrame:
    """What the overlay says of a frame: the first issue with a time range that
    holds it, else the position inside its repetition (``key`` near the key
    frame, else ``path``), else ``none``.  Columns note, code, rep_index."""
    line = phase_timeline(frames, reps, keys, key_window_ms)
    timed = frame_issue(line, issues.where(F.size("ranges") > 0), keys)
    inside = F.when(F.col("phase") == "key", "key").otherwise("path")
    note = F.when(F.col("issue_code").isNotNull(), "issue").when(F.col("rep_index").isNotNull(), inside).otherwise("none")
    noted = timed.withColumn("note", note)
    rep = F.when(F.col("note").isin("key", "path"), F.col("rep_index")).alias("rep_index")
    return noted.select(*keys, "pose_idx", "note", F.col("issue_code").alias("code"), rep)


def attach_motion(frames: DataFrame, motion: DataFrame, keys: Sequence[str], at: str = "frame_index") -> DataFrame:
    """Left join per-frame camera motion; ``applied`` tells whether the series has
    at least three frames and 60 % of them available."""
    keys = list(keys)
    d = frames.join(motion, [*keys, at], "left")
    d = d.withColumn("available", F.coalesce("available", F.lit(False)))
    cover = d.groupBy(*keys, "n").agg(F.avg(F.col("available").cast("int")).alias("coverage"))
    cover = cover.withColumn("applied", (F.col("coverage") >= 0.6) & (F.col("n") >= 3))
    return spread_join(d, cover, keys)


def display_window(frames: DataFrame, reps: DataFrame, active: DataFrame, keys: Sequence[str], pad_ms: int = 650) -> DataFrame:
    """Frames shown to the user: repetitions with a margin clipped to the active
    window, else the active window, else everything.  ``active`` has start_ms,
    end_ms and n per key."""
    keys = list(keys)
    span = reps.groupBy(*keys).agg(F.min("start_ms").alias("_rs"), F.max("end_ms").alias("_re"))
    w = active.join(span, keys, "left").select(
        *keys, "n",
        F.when(F.col("_rs").isNotNull(), F.greatest("start_ms", F.col("_rs") - pad_ms)).otherwise(F.col("start_ms")).alias("_from"),
        F.when(F.col("_re").isNotNull(), F.least("end_ms", F.col("_re") + pad_ms)).otherwise(F.col("end_ms")).alias("_to"),
    )
    d = spread_join(frames, w, keys)
    keep = (F.col("_from").isNull() | (F.col("time_ms") >= F.col("_from"))) & (F.col("_to").isNull() | (F.col("time_ms") <= F.col("_to")))
    return d.where(keep).drop("_from", "_to")


def rep_keyframes(reps: DataFrame, frames: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Attach the start, key and end frame of each repetition in one join."""
    keys = list(keys)
    marks = F.array(*[F.struct(F.lit(m).alias("mark"), F.col(f"{m}_idx").alias("pose_idx")) for m in ("start", "key", "end")])
    wanted = reps.select(*keys, "rep_index", F.explode(marks).alias("m")).select(*keys, "rep_index", "m.*")
    hit = wanted.join(frames.select(*keys, "pose_idx", F.struct(*payload).alias("_f")), [*keys, "pose_idx"])
    row = hit.groupBy(*keys, "rep_index").agg(
        *[F.max(F.when(F.col("mark") == m, F.col("_f"))).alias(f"{m}_frame") for m in ("start", "key", "end")]
    )
    return reps.join(row, [*keys, "rep_index"], "left")


def join_or_position(a: DataFrame, b: DataFrame, group: Sequence[str], key: str, position: str, payload: Sequence[str]) -> DataFrame:
    """Match by id, else by position inside the group.  Where an id or a position
    occurs more than once in ``b``, the row with the least payload counts, so no
    row of ``a`` is multiplied."""
    row = F.struct(*payload)
    by_id = b.groupBy(*group, key).agg(F.min(row).alias("_i"))
    by_pos = b.groupBy(*group, position).agg(F.min(row).alias("_p"))
    d = a.join(by_id, [*group, key], "left").join(by_pos, [*group, position], "left")
    best = F.coalesce("_i", "_p")
    return d.select(*a.columns, *[best[c].alias(c) for c in payload])
