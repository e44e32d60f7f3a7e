"""Job, video and log records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.layout import scan, with_ordinal
from cadenza.core.num import clamp
from cadenza.core.rangejoin import first_per, time_slot, top_k
from cadenza.functions.dims import ACTION_NAMES, CAMERAS


def trimmed(c: Column, n: int) -> Column:
    return F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)


def bounded(c: Column, lo: float, hi: float, default: float, integer: bool = False) -> Column:
    """Text to number; anything malformed or outside the bounds takes the default."""
    v = F.trim(c).try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & v.between(lo, hi)
    if integer:
        return F.when(ok & (v == F.floor(v)), v.cast("long")).otherwise(F.lit(int(default)))
    return F.when(ok, v).otherwise(F.lit(float(default)))


def truthy(c: Column, default: bool = False) -> Column:
    empty = c.isNull() | (c == "")
    return F.when(empty, F.lit(default)).otherwise(F.lower(F.trim(c)).isin("1", "true", "yes", "on"))


def option(c: Column, allowed: Sequence[str], default: str) -> Column:
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v.isin(list(allowed)), v).otherwise(F.lit(default))


AUTO = ["", "auto", "auto_detect", "detect", "unknown"]


def normalize_videos(df: DataFrame) -> DataFrame:
    """Typed video rows from raw text columns: action_type, camera_angle, load_kg,
    sets, reps, rpe, notes, pose_engine_mode, pose_engine_compare and the four
    roi_* fractions."""
    c = F.col
    num = lambda name, top: F.coalesce(
        F.when(c(name).try_cast("double") >= 0, F.least(c(name).try_cast("double"), F.lit(float(top)))), F.lit(0.0)
    )
    action = F.trim(F.coalesce(c("action_type"), F.lit("auto_detect")))
    kind = F.when(F.lower(action).isin(AUTO), "auto_detect").when(action.isin(ACTION_NAMES), action).otherwise("other")
    mode = F.lower(F.trim(F.coalesce(c("pose_engine_mode"), F.lit(""))))
    compare = F.coalesce(F.lower(c("pose_engine_compare")) != "false", F.lit(True))
    engine = F.when(mode.isin("both", "mediapipe"), mode).when(mode.isin("rtmo", "rtmlib"), "rtmo").when(compare, "both").otherwise("rtmo")
    x, y, w, h = (c(f"roi_{k}").try_cast("double") for k in ("x", "y", "w", "h"))
    ok = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1)
    roi = F.when(ok, F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")))
    used = {"action_type", "camera_angle", "load_kg", "sets", "reps", "rpe", "notes", "pose_engine_mode", "pose_engine_compare", "roi_x", "roi_y", "roi_w", "roi_h"}
    return df.select(
        *[k for k in df.columns if k not in used], kind.alias("action_type"),
        F.when(c("camera_angle").isin(CAMERAS), c("camera_angle")).otherwise("unknown").alias("camera_angle"),
        num("load_kg", 2000).alias("load_kg"), num("sets", 100).alias("sets"), num("reps", 1000).alias("reps"), num("rpe", 10).alias("rpe"),
        trimmed(c("notes"), 1000).alias("notes"), engine.alias("pose_engine_mode"), compare.alias("pose_engine_compare"), roi.alias("target_roi"),
    )


def normalize_equipment(df: DataFrame, keys: Sequence[str], position: str, limit: int = 60) -> DataFrame:
    """First ``limit`` entries, trimmed; blanks dropped, first entry per id kept."""
    raw = top_k(df, keys, [F.col(position)], limit)
    d = raw.select(
        *keys, position, trimmed(F.col("equipment_id"), 100).alias("equipment_id"), trimmed(F.col("name"), 80).alias("name"),
        F.greatest(F.lit(1.0), F.least(F.lit(20.0), _or(F.col("default_sets"), 4.0))).alias("default_sets"),
        F.greatest(F.lit(0.0), F.least(F.lit(600.0), _or(F.col("default_rest_seconds"), 75.0))).alias("default_rest_seconds"),
    ).where("equipment_id <> '' AND name <> ''")
    return first_per(d, [*keys, "equipment_id"], [F.col(position)])


def _or(c: Column, default: float) -> Column:
    """Text to number where zero and malformed values take the default."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v == 0), F.lit(default)).otherwise(v)


def expand_engines(videos: DataFrame) -> DataFrame:
    """One row per (video, engine) with the backend that serves it."""
    both = F.array(F.lit("rtmo"), F.lit("mediapipe"))
    m = F.col("pose_engine_mode")
    engines = F.when(m == "both", both).when(m == "mediapipe", F.array(F.lit("mediapipe"))).otherwise(F.array(F.lit("rtmo")))
    d = videos.withColumn("engine", F.explode(engines))
    return d.withColumn("backend", F.when(F.col("engine") == "mediapipe", "mediapipe").otherwise("rtmlib"))


def valid_user_id(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^[a-zA-Z0-9_-]{16,100}$"), F.lit(False))


def valid_job_id(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^(?i)[a-f0-9-]{20,50}$"), F.lit(False))


def user_key(c: Column) -> Column:
    return F.when(valid_user_id(c), F.substring(F.sha2(F.trim(c), 256), 1, 32))


def append_log(logs: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 120) -> DataFrame:
    """Append entries and keep the newest ``n`` per key; ``order`` is newest first."""
    return top_k(logs.unionByName(new), keys, order, n)


def latest_jobs(patches: DataFrame, fields: Sequence[str], job: str = "job_id", version: str = "version") -> DataFrame:
    """Current record per job: the newest non-null value of each field."""
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col(version))).alias(f)
    return patches.groupBy(job).agg(*[last(f) for f in fields], F.max(version).alias(version))


def expire(jobs: DataFrame, now: Column, days: float) -> DataFrame:
    """Drop records not touched for ``days``; undated ones stay."""
    stamp = F.coalesce("updated_at", "created_at")
    keep = stamp.isNull() | (stamp >= now - F.make_dt_interval(secs=F.lit(round(days * 86400, 6))))
    return jobs.where(keep) if days > 0 else jobs


def recover(jobs: DataFrame) -> DataFrame:
    interrupted = F.col("status").isin("queued", "processing", "reporting")
    return jobs.withColumn("recovered", interrupted).withColumn("status", F.when(interrupted, "queued").otherwise(F.col("status")))


def list_jobs(jobs: DataFrame, user: str = "user_key", day: str = "created_on", job: str = "job_id") -> DataFrame:
    """``position`` of every job in its user's list, newest first; a day of one
    user is ranked in one task, never a user."""
    d = jobs.withColumn("_age", -F.unix_date(day).cast("long")).withColumn("_no", -F.col(job))
    out = with_ordinal(d, [user], ["_age", "_no"], F.col("_age"), "_p", "_c")
    return out.withColumn("position", F.col("_p") + 1).drop("_age", "_no", "_p", "_c")


def pick_engine(frames: DataFrame, keys: Sequence[str], order: Sequence[str], strict: bool = False) -> DataFrame:
    """Per key the first engine in ``order`` that produced frames; strict mode
    accepts the first engine only.  The last resort is accepted even when empty."""
    rank = F.lit(len(order))
    for i, e in enumerate(order):
        rank = F.when(F.col("engine") == e, i).otherwise(rank)
    pool = frames.where(F.col("engine").isin(list(order[:1] if strict else order)))
    counts = pool.groupBy(*keys, "engine").agg(F.count("frame_index").alias("frames"))
    usable = (F.col("frames") > 0) | (F.col("engine") == order[-1])
    return counts.where(usable).groupBy(*keys).agg(F.min_by(F.struct("engine", "frames"), rank).alias("b")).select(*keys, "b.*")


def previous_session(jobs: DataFrame, job_actions: DataFrame) -> DataFrame:
    """Newest completed earlier job of the same user that shares the body part or
    an action, with the score change.

    Looked up by carrying the last completed job along (user, body part) and
    (user, action) in time order: no self join of a user's jobs.
    """
    slot = F.unix_date("created_on").cast("long")
    j = with_ordinal(jobs, ["user_key"], ["created_on", "job_id"], slot, "seq", "cnt").drop("cnt")
    done = F.when(F.col("status") == "completed", F.struct("seq", "job_id", "score"))
    by_part = scan(j, ["user_key", "body_part"], {"_p": done}, inclusive=False, idx="seq").select("job_id", F.col("_p").alias("prev"))
    acted = j.join(job_actions.select("job_id", "action_type").distinct(), "job_id")
    by_action = scan(acted, ["user_key", "action_type"], {"_p": done}, inclusive=False, idx="seq").select("job_id", F.col("_p").alias("prev"))
    best = by_part.unionByName(by_action).groupBy("job_id").agg(F.max("prev").alias("prev"))
    change = F.when((F.col("prev.score") != 0) & (F.col("score") != 0), F.col("score") - F.col("prev.score"))
    return j.join(best, "job_id", "left").select(*jobs.columns, F.col("prev.job_id").alias("previous_job"), change.alias("score_change"))


def feedback(df: DataFrame, key: str, order: Sequence[Column], n: int = 50) -> DataFrame:
    """Typed feedback entries, newest ``n`` per job."""
    kind = F.when(F.col("type").isin("helpful", "missed", "incorrect"), F.col("type")).otherwise("helpful")
    d = df.withColumn("type", kind).withColumn("note", trimmed(F.col("note"), 1000))
    return top_k(d, [key], order, n)


def next_load(load: Column) -> Column:
    """Next weight on a half-kilogram grid: at least 1 kg or 2.5 % more."""
    up = load + F.greatest(F.lit(1.0), load * 0.025)
    return F.when(load > 0, F.floor(up * 2 + 0.5) / 2)


def chat_window(turns: DataFrame, key: str, n: int = 12, max_chars: int = 8000) -> tuple[DataFrame, DataFrame]:
    """Last ``n`` turns per conversation and the rejected conversations.

    A conversation is rejected when any turn has a foreign role, is empty or
    too long; the reason of its first bad turn is kept.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    bad = (
        F.when(~F.col("role").isin("user", "assistant"), "INVALID_ROLE").when(text == "", "MESSAGE_REQUIRED")
        .when(F.length(text) > max_chars, "TEXT_TOO_LONG")
    )
    d = turns.withColumn("text", text).withColumn("reason", bad)
    rejected = d.where(F.col("reason").isNotNull()).groupBy(key).agg(F.min_by("reason", "turn").alias("reason"))
    ok = d.join(rejected.select(key), key, "left_anti").drop("reason")
    kept = top_k(ok, [key], [F.desc("turn")], n)
    return kept.drop("rn"), rejected


def digest(record: Column) -> Column:
    return F.sha2(F.to_json(record), 256)
