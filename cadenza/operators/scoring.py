"""Issues, scores, roll-ups, rankings and set operations over results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.num import js_round, rnd
from cadenza.core.rangejoin import first_per, top_k
from cadenza.functions.dims import SUPERSEDED_CODES

BLOCKING = ["ACTION_MISMATCH", "INSUFFICIENT_EVIDENCE", "COUNT_UNSTABLE", "TARGET_UNCERTAIN"]
SEVERITY_RANK = {"red": 3, "yellow": 2, "green": 1}


def dedupe_issues(issues: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First issue per (code, repetition list)."""
    return first_per(issues, [*keys, "code", "reps"], order)


def drop_superseded_codes(issues: DataFrame, codes: Sequence[str] = tuple(SUPERSEDED_CODES)) -> DataFrame:
    return issues.where(~F.col("code").isin(list(codes)))


def supersede(set_issues: DataFrame, rep_issues: DataFrame, keys: Sequence[str], blocking: Sequence[str] = tuple(BLOCKING)) -> DataFrame:
    """Repetition issues replace set issues of the same code, unless a blocking
    code makes the repetition rules moot for that key."""
    keys = list(keys)
    blocked = set_issues.where(F.col("code").isin(list(blocking))).select(*keys).distinct()
    reps = rep_issues.join(blocked, keys, "left_anti")
    codes = reps.select(*keys, "code").distinct()
    kept = set_issues.join(codes, [*keys, "code"], "left_anti")
    return kept.unionByName(reps, allowMissingColumns=True)


def all_issues(set_issues: DataFrame, rep_issues: DataFrame, stability: DataFrame, unstable_counts: DataFrame,
               uncertain_targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set rules, stability, count and target issues, then the repetition rules
    with their precedence; superseded codes never appear."""
    keys = list(keys)
    note = lambda df, code: df.select(*keys, F.lit(code).alias("code"), F.lit("yellow").alias("severity"))
    base = drop_superseded_codes(set_issues)
    for extra in (stability, note(unstable_counts, "COUNT_UNSTABLE"), note(uncertain_targets, "TARGET_UNCERTAIN")):
        base = base.unionByName(extra, allowMissingColumns=True)
    return drop_superseded_codes(supersede(base, rep_issues, keys))


def result_confidence(avg_quality: Column, coverage: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(0.98), avg_quality * F.least(F.lit(1.0), coverage / 0.8)))


def score(stats: DataFrame, issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overall score and safety level; ``stats`` has ``confidence`` per key."""
    keys = list(keys)
    has = lambda code: F.max((F.col("code") == code).cast("int")) == 1
    agg = issues.groupBy(*keys).agg(
        F.sum(F.when(F.col("severity") == "red", 28).otherwise(10)).alias("_ded"), has("INSUFFICIENT_EVIDENCE").alias("_ins"),
        has("ACTION_MISMATCH").alias("_mis"), F.max((F.col("severity") == "red").cast("int")).alias("_red"),
    )
    d = stats.join(agg, keys, "left")
    ins, mis = F.coalesce("_ins", F.lit(False)), F.coalesce("_mis", F.lit(False))
    penalty = F.greatest(F.lit(0), ((F.lit(0.75) - F.col("confidence")) * 30).cast("int"))
    value = F.greatest(F.lit(35), F.least(F.lit(98), F.lit(95) - F.coalesce("_ded", F.lit(0)) - penalty))
    level = (
        F.when(ins, "insufficient").when(mis | (F.col("_red") == 1), "red").when(F.col("_ded").isNotNull(), "yellow").otherwise("green")
    )
    return d.select(*keys, F.when(ins | mis, F.lit(0)).otherwise(value).cast("long").alias("overall_score"), level.alias("safety_level"))


def score_simple(issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """100 minus 18 per yellow and 35 per other issue."""
    loss = F.sum(F.when(F.col("severity") == "yellow", 18).otherwise(35))
    return issues.groupBy(*keys).agg(F.greatest(F.lit(0).cast("long"), F.lit(100) - loss).alias("score"))


def training_volume(videos: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sets, repetitions and tonnage; negative or missing numbers count as zero."""
    z = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0)))
    return videos.groupBy(*keys).agg(
        F.sum(z("sets")).alias("sets"), F.sum(z("sets") * z("reps")).alias("repetitions"),
        F.sum(z("sets") * z("reps") * z("load_kg")).alias("tonnage_kg"),
    )


def job_rollup(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the positive scores, worst safety level, insufficient results."""
    rank = F.lit(0)
    for level, r in SEVERITY_RANK.items():
        rank = F.when(F.col("safety_level") == level, r).otherwise(rank)
    usable = (F.col("capture_quality") != "insufficient") & (F.col("safety_level") != "not_applicable")
    positive = F.col("overall_score") > 0
    a = results.groupBy(*keys).agg(
        F.avg(F.when(positive, F.col("overall_score"))).alias("_avg"), F.max(F.when(usable, rank)).alias("_worst"),
        F.max(rank).alias("_any"), F.count_if(F.col("capture_quality") == "insufficient").alias("insufficient"), F.count(F.lit(1)).alias("results"),
    )
    level = F.when(F.col("_worst").isNull(), "not_applicable").when(F.col("_any") == 3, "red").when(F.col("_any") == 2, "yellow").otherwise("green")
    return a.select(*keys, F.coalesce(js_round(F.col("_avg")), F.lit(0)).cast("long").alias("average_score"), level.alias("safety_level"),
                    "insufficient", "results")


def tracking_diagnostics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Switches, losses, rejected frames, multi-person frames and mean lock."""
    return df.groupBy(*keys).agg(
        F.count_if("switched").alias("switches"), F.count_if("lost").alias("lost"), F.count_if("rejected").alias("rejected"),
        F.count_if(F.col("candidates") > 1).alias("multi_person_frames"), rnd(F.avg("lock_confidence"), 3).alias("lock_confidence"),
    )


def motion_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage, median inlier ratio and status of the camera-motion estimate."""
    from cadenza.core.quantiles import quantiles

    keys = list(keys)
    q = quantiles(df, keys, {"_m": ("inlier_ratio", 0.5)})
    a = df.groupBy(*keys).agg(F.count_if("available").alias("available_frames"), F.count(F.lit(1)).alias("frame_count"))
    cover = F.col("available_frames") / F.col("frame_count")
    return a.join(q, keys, "left").select(
        *keys, "available_frames", "frame_count", rnd(cover, 3).alias("coverage"), rnd(F.coalesce("_m", F.lit(0.0)), 3).alias("median_inlier_ratio"),
        F.when(cover >= 0.6, "ready").otherwise("insufficient").alias("status"),
    )


def capture_quality(coverage: Column, quality: Column, frames: Column) -> Column:
    return (
        F.when((coverage < 0.45) | (quality < 0.48) | (frames < 8), "insufficient")
        .when((coverage < 0.72) | (quality < 0.65), "limited").otherwise("good")
    )


def backlog_report(queue: DataFrame, max_user: int = 8, max_queued: int = 32) -> DataFrame:
    """Pending and active items per user with admission verdicts, plus one total row."""
    waiting, running = F.col("state") == "pending", F.col("state") == "active"
    g = queue.groupingSets([["user_key"], []], "user_key").agg(
        F.count_if(waiting).alias("pending"), F.count_if(running).alias("active"), F.grouping("user_key").alias("_all")
    )
    total = F.col("_all") == 1
    return g.select(
        F.when(total, "*").otherwise(F.col("user_key").cast("string")).alias("user_key"), "pending", "active",
        F.when(total, F.greatest(F.lit(0).cast("long"), F.lit(max_queued) - F.col("pending")))
        .otherwise(F.greatest(F.lit(0).cast("long"), F.lit(max_user) - F.col("pending") - F.col("active"))).alias("slots_left"),
        F.when(total, F.col("pending") >= max_queued).otherwise(F.col("pending") + F.col("active") >= max_user).alias("overloaded"),
    )


def fair_pick(queue: DataFrame, cap: int, order: Sequence[str]) -> DataFrame:
    """Oldest pending items, at most ``cap`` minus the active ones per user."""
    busy = queue.where("state = 'active'").groupBy("user_key").agg(F.count(F.lit(1)).alias("_busy"))
    first = top_k(queue.where("state = 'pending'"), ["user_key"], [F.col(c) for c in order], cap)
    return first.join(busy, "user_key", "left").where(F.col("rn") <= cap - F.coalesce("_busy", F.lit(0))).drop("_busy")


def prioritise(issues: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 4) -> DataFrame:
    """Review priority of the first issues: red is high, the first one primary."""
    first = top_k(issues, keys, order, k)
    p = F.when(F.col("severity") == "red", "high").when(F.col("rn") == 1, "primary").otherwise("secondary")
    return first.withColumn("priority", p)


def stability_issue(segments: DataFrame, keys: Sequence[str], mode: Column, ranges: int = 12) -> DataFrame:
    """One issue per key with unstable segments: first ranges, mean confidence,
    total duration and largest angle delta."""
    keys = list(keys)
    bad = segments.where("state = 'unstable'").withColumn("mode", mode)
    a = bad.groupBy(*keys, "mode").agg(
        F.sum("duration_ms").alias("unstable_ms"), F.avg("confidence").alias("_c"), F.max("max_angle_delta").alias("max_angle_delta"),
        F.count(F.lit(1)).alias("segments"),
    )
    firsts = top_k(bad.select(*keys, "start_ms", "end_ms"), keys, [F.col("start_ms")], ranges)
    lists = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("ranges"))
    code = F.when(F.col("mode") == "relative_coupled", "TRUNK_RELATIVE_INSTABILITY").otherwise("TRUNK_ABSOLUTE_INSTABILITY")
    return a.join(lists, keys).select(
        *keys, code.alias("code"), F.lit("yellow").alias("severity"), "segments", "unstable_ms", rnd("_c", 3).alias("confidence"),
        rnd("max_angle_delta", 2).alias("max_angle_delta"), "ranges",
    )


def recommend(df: DataFrame) -> Column:
    """Engine-comparison recommendation from coverage, confidence and deltas."""
    better = (F.col("coverage_b") >= F.col("coverage_a") + 0.15) | (F.col("confidence_b") >= F.col("confidence_a") + 0.12)
    worst = F.coalesce(F.col("worst_delta"), F.lit(0.0))
    return F.when(worst >= 30.0, "needs_manual_review").when(better, "import_secondary_metrics").otherwise("keep_primary")


COUNT_FAMILIES = ["pull", "hinge", "isolation_elbow", "isolation_knee", "isolation_shoulder"]
ARM_HINGE = ["pull", "hinge", "isolation_elbow"]


def fuse_engines(df: DataFrame) -> DataFrame:
    """Choose the engine and the source of the repetition count.

    Columns: coverage_a/b, confidence_a/b, has_comparison, capture_quality,
    switches, lock_confidence, worst_delta, reps_a/b, unstable_a/b, family.
    A lock confidence of 0 counts as unknown and is read as 1.
    """
    c = F.col
    qa, qb = c("coverage_a") * 0.55 + c("confidence_a") * 0.45, c("coverage_b") * 0.55 + c("confidence_b") * 0.45
    lock = F.when(F.coalesce(c("lock_confidence"), F.lit(0.0)) == 0, 1.0).otherwise(c("lock_confidence"))
    risky = (c("switches") > 0) | (lock < 0.55)
    usable = c("has_comparison") & (c("reps_b") > 0) & ~c("unstable_b") & (c("capture_quality") != "insufficient") & ~risky & c("family").isin(COUNT_FAMILIES)
    arm = c("family").isin(ARM_HINGE)
    branch = (
        F.when(~c("has_comparison"), 1).when(c("capture_quality") == "insufficient", 2).when(risky, 3)
        .when(c("worst_delta") >= 30.0, 4).when((c("reps_b") > c("reps_a")) & ~c("unstable_b") & arm, 5)
        .when((qb >= qa + 0.10) & arm, 6).when(c("unstable_a") & (qb >= qa - 0.05), 7).otherwise(8)
    )
    d = df.withColumn("_b", branch)
    by = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_b"))
    count_from_b = usable & (F.col("_b") > 3)
    return d.select(
        *df.columns,
        by(["primary", "needs_review", "primary", "hybrid_review", "secondary", "secondary", "hybrid_review", "primary"]).alias("selected_engine"),
        by([0.52, 0.35, 0.72, 0.46, 0.74, 0.72, 0.58, 0.68]).alias("fusion_confidence"),
        F.when(count_from_b, "secondary").otherwise("primary").alias("rep_source"),
        F.when(count_from_b, c("reps_b")).otherwise(c("reps_a")).alias("fused_reps"),
        rnd(qa, 3).alias("quality_a"), rnd(qb, 3).alias("quality_b"),
    )


def published_reps(primary: DataFrame, secondary: DataFrame, decision: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repetitions of the chosen engine; an empty secondary falls back to primary."""
    keys = list(keys)
    filled = secondary.select(*keys).distinct().withColumn("_has_b", F.lit(True))
    d = decision.select(*keys, "rep_source").join(filled, keys, "left").select(
        *keys, F.when((F.col("rep_source") == "secondary") & F.col("_has_b"), "secondary").otherwise("primary").alias("source_engine")
    )
    both = primary.withColumn("source_engine", F.lit("primary")).unionByName(secondary.withColumn("source_engine", F.lit("secondary")), allowMissingColumns=True)
    return both.join(d, [*keys, "source_engine"], "left_semi")
