"""Review sections, arbitration and session facts over result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.num import clamp
from cadenza.functions.dims import family_group


def job_summary(results: DataFrame, keys: Sequence[str], order: Sequence[str] = ("engine",)) -> DataFrame:
    """Engine results nested under their video, first one primary; a video has at
    most one row per engine."""
    entry = F.struct(*order, *[c for c in results.columns if c not in (*keys, *order)])
    g = results.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("engine_results"))
    mode = F.when(F.size("engine_results") > 1, "both").otherwise(F.col("engine_results")[0]["engine"])
    return g.select(*keys, F.col("engine_results")[0].alias("primary"), "engine_results", mode.alias("engine_mode"))


SECTIONS = ["movement_task", "range_endpoints", "stability_compensation", "tempo_consistency"]


def review_sections(issues: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of each review section per result: limited evidence, needs attention
    or mostly meets.  ``issues`` has ``category``; ``results`` capture_quality."""
    keys = list(keys)
    counts = issues.groupBy(*keys, F.col("category").alias("section")).agg(F.count(F.lit(1)).alias("relevant"))
    grid = results.select(*keys, "capture_quality", F.explode(F.array(*[F.lit(s) for s in SECTIONS])).alias("section"))
    d = grid.join(counts, [*keys, "section"], "left")
    n = F.coalesce("relevant", F.lit(0))
    status = F.when(F.col("capture_quality") == "insufficient", "limited_evidence").when(n > 0, "needs_attention").otherwise("mostly_meets")
    return d.select(*keys, "section", n.alias("relevant"), status.alias("status"))


STATUSES = ["meets_standard", "mostly_meets", "needs_attention", "limited_evidence", "not_assessed"]


def normalise_review(generated: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Generated section texts where present and valid, deterministic ones elsewhere."""
    g = generated.select(*keys, "section", F.col("status").alias("_s"), F.col("assessment").alias("_a"))
    d = fallback.join(g, [*keys, "section"], "left")
    text = F.when(F.trim("_a") != "", F.trim("_a"))
    return d.select(*keys, "section", F.when(F.col("_s").isin(STATUSES), F.col("_s")).otherwise(F.col("status")).alias("status"),
                    F.coalesce(text, F.col("assessment")).alias("assessment"), text.isNotNull().alias("generated"))


def arbitration_reasons(r: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reasons to distrust a result, in order.

    Columns: capture_quality, codes ARRAY, count_unstable, switches, lost,
    rejected, rejected_reps, has_keyframes, selected_family, detected_family,
    mismatch, signature_confidence, window_enabled, window_confidence,
    full_frames, analysis_frames, trimmed_start, trimmed_end.
    """
    c = F.col
    has = lambda code: F.array_contains("codes", code)
    # the arbitration groups leave hip isolation out of the lower body
    group = lambda f: F.when(f == "isolation_hip", "general").otherwise(family_group(f))
    sg, dg = group(c("selected_family")), group(c("detected_family"))
    differs = c("selected_family").isNotNull() & c("detected_family").isNotNull() & (c("selected_family") != c("detected_family")) & (c("signature_confidence") < 0.45)
    cross = c("mismatch") | ((sg != dg) & (sg != "general") & (dg != "general"))
    kept = F.when(c("full_frames") > 0, c("analysis_frames") / c("full_frames")).otherwise(1.0)
    shaky = c("window_enabled") & (c("window_confidence") < 0.22) & ((kept < 0.55) | (c("trimmed_start") > 0) | (c("trimmed_end") > 0))
    rules = [
        ("INSUFFICIENT_EVIDENCE", "red", (c("capture_quality") == "insufficient") | has("INSUFFICIENT_EVIDENCE")),
        ("COUNT_UNSTABLE", "yellow", c("count_unstable") | has("COUNT_UNSTABLE")),
        ("TARGET_UNCERTAIN", "yellow", has("TARGET_UNCERTAIN") | (c("switches") > 0)),
        ("STAGE_EVIDENCE_VISUAL_REVIEW", "info", c("has_keyframes") & ((c("lost") > 0) | (c("rejected") > 0) | (c("rejected_reps") > 0))),
        ("ACTION_CLASS_UNCERTAIN", "yellow", differs & cross),
        ("ACTION_SUBTYPE_VISUAL_REVIEW", "info", differs & ~cross),
        ("ACTIVE_WINDOW_UNCERTAIN", "yellow", shaky),
    ]
    entries = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(i).alias("no"), F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for i, (code, sev, cond) in enumerate(rules)]
    return r.select(*keys, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("x")).select(*keys, "x.*")


CAPS = {"ACTION_CLASS_UNCERTAIN": 75.0, "ACTIVE_WINDOW_UNCERTAIN": 80.0, "COUNT_UNSTABLE": 85.0}
DECISIONS = ["confirm_algorithm", "mark_insufficient", "mark_uncertain", "cap_score", "request_rerun"]


# Names of the protective actions, with the issue each one adds and its severity.
MARKS = {
    "mark_insufficient": ("INSUFFICIENT_EVIDENCE", "red"),
    "mark_action_class_uncertain": ("ACTION_CLASS_UNCERTAIN", "yellow"),
    "mark_active_window_uncertain": ("ACTIVE_WINDOW_UNCERTAIN", "yellow"),
    "mark_count_unstable": ("COUNT_UNSTABLE", "yellow"),
}
REFUSED = "reject_ai_mark_insufficient"


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def normalise_decisions(decisions: DataFrame, keys: Sequence[str], k: int = 8) -> DataFrame:
    """First ``k`` valid decisions per result in the order of ``no``, as ``rn`` 1 to k.

    Unknown actions go; ``cap`` is held between 0 and 100 and is void for a
    confirmation, ``confidence`` between 0 and 1; numbers that are not finite
    are void; texts are trimmed and cut.  ``confidence``, ``require_review`` and
    ``note`` may be absent."""
    from cadenza.core.num import finite
    from cadenza.core.rangejoin import top_k

    short = lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)
    number = lambda name, high: F.when(finite(_optional(decisions, name, "double")).isNotNull(), clamp(finite(_optional(decisions, name, "double")), 0.0, high))
    d = decisions.withColumn("action", F.trim("action")).where(F.col("action").isin(DECISIONS)).select(
        *keys, "no", "action", short(F.col("reason_code"), 80).alias("reason_code"), F.when(F.col("action") != "confirm_algorithm", number("cap", 100.0)).alias("cap"),
        number("confidence", 1.0).alias("confidence"), F.coalesce(_optional(decisions, "require_review", "boolean"), F.lit(False)).alias("require_review"),
        short(_optional(decisions, "note", "string"), 500).alias("note"),
    )
    return top_k(d, keys, [F.col("no")], k)


def apply_arbitration(results: DataFrame, reasons: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Caps, level, evidence marks and added issues from reasons and external decisions.

    ``results``: overall_score, safety_level, capture_quality, has_count_issue;
    rep_count, codes (issues present), signature_confidence and
    window_confidence may be absent.  ``decisions``: see ``normalise_decisions``.
    Scores fold into a least cap per result, since no effect ever lifts a score.
    ``applied`` names the effects in the order of their first use, reasons before
    decisions; ``added`` holds the issues (code, severity, confidence,
    observation) that the result lacks, in that order; ``cleared`` says that
    strengths and key frames no longer count.  A null observation stands for the
    usual text.
    """
    keys = list(keys)
    code = F.col("code")
    own = reasons.groupBy(*keys).agg(
        F.max((code == "INSUFFICIENT_EVIDENCE").cast("int")).alias("_ins"),
        *[F.max((code == k).cast("int")).alias(f"_r_{k}") for k in CAPS], F.max((F.col("severity") != "info").cast("int")).alias("_review"),
    )
    valid = normalise_decisions(decisions, keys)
    a, why, cap = F.col("action"), F.col("reason_code"), F.when(F.col("action") != "mark_insufficient", F.col("cap"))
    soft = a.isin("mark_uncertain", "request_rerun")
    doubt = {c: soft & (why == c) for c in ("ACTION_CLASS_UNCERTAIN", "ACTIVE_WINDOW_UNCERTAIN")}
    joined = valid.join(own.select(*keys, F.col("_ins").alias("_known")), keys, "left")
    marks = (a == "mark_insufficient") & ((F.coalesce("_known", F.lit(0)) == 1) | (why == "INSUFFICIENT_EVIDENCE"))
    refused = (a == "mark_insufficient") & ~marks
    shown = F.when(cap == F.floor(cap), cap.cast("long").cast("string")).otherwise(cap.cast("string"))
    named = {name: doubt[c] for name, (c, _) in MARKS.items() if c in doubt}
    names = F.array_compact(F.array(F.when(marks, "mark_insufficient"), F.when(refused, REFUSED), *[F.when(on, name) for name, on in named.items()], F.concat(F.lit("cap_score_"), shown)))
    ext = joined.groupBy(*keys).agg(
        F.max(marks.cast("int")).alias("_mark"), F.max(F.col("require_review").cast("int")).alias("_asked"),
        F.min(F.least(cap, F.when(refused, 80.0), *[F.when(on, CAPS[c]) for c, on in doubt.items()])).alias("_cap"),
        F.max((refused | F.coalesce(cap < 80, F.lit(False)) | doubt["ACTION_CLASS_UNCERTAIN"] | doubt["ACTIVE_WINDOW_UNCERTAIN"]).cast("int")).alias("_warn"),
        F.min_by("note", F.when(marks, F.col("rn"))).alias("_note"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rn", names.alias("names")))), lambda x: x["names"])).alias("_names"),
    )
    d = results.join(own, keys, "left").join(ext, keys, "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    insufficient = on("_ins") | on("_mark")
    count = on("_r_COUNT_UNSTABLE") & ~F.col("has_count_issue")
    first = {"mark_insufficient": on("_ins"), "mark_action_class_uncertain": on("_r_ACTION_CLASS_UNCERTAIN"), "mark_active_window_uncertain": on("_r_ACTIVE_WINDOW_UNCERTAIN"), "mark_count_unstable": count}
    own_cap = F.least(*[F.when(first[name], CAPS[c]) for name, (c, _) in MARKS.items() if c in CAPS])
    limit = F.coalesce(F.least(own_cap, F.col("_cap")), F.lit(float("inf")))
    warn = own_cap.isNotNull() | on("_warn")
    none = F.array().cast("array<string>")
    applied = F.array_distinct(F.concat(F.array_compact(F.array(*[F.when(hit, name) for name, hit in first.items()])), F.coalesce("_names", none)))
    sure = {"ACTION_CLASS_UNCERTAIN": "signature_confidence", "ACTIVE_WINDOW_UNCERTAIN": "window_confidence"}
    seen = lambda c: F.coalesce(_optional(results, sure[c], "double"), F.lit(0.0)) if c in sure else F.lit(None).cast("double")
    told = F.when(~on("_ins") & (F.col("_note") != ""), F.col("_note"))
    issue = {name: F.struct(F.lit(c).alias("code"), F.lit(sev).alias("severity"), seen(c).alias("confidence"), (told if name == "mark_insufficient" else F.lit(None).cast("string")).alias("observation")) for name, (c, sev) in MARKS.items()}
    present = F.coalesce(_optional(results, "codes", "array<string>"), none)
    table = F.create_map(*[x for name, entry in issue.items() for x in (F.lit(name), entry)])
    entries = F.transform(F.filter("applied", lambda x: x.isin(list(MARKS))), lambda x: table[x])
    d = d.withColumn("applied", applied)
    return d.select(
        *keys,
        F.when(insufficient, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.col("overall_score"), limit))).alias("overall_score"),
        F.when(insufficient, "not_applicable").when(warn & (F.col("safety_level") == "green"), "yellow").otherwise(F.col("safety_level")).alias("safety_level"),
        F.when(insufficient, "insufficient").otherwise(F.col("capture_quality")).alias("capture_quality"), (on("_review") | on("_asked")).alias("review"),
        F.when(insufficient, F.lit(0).cast("long")).otherwise(_optional(results, "rep_count", "long")).alias("rep_count"), insufficient.alias("cleared"),
        F.filter(entries, lambda x: ~F.array_contains(present, x["code"])).alias("added"), "applied",
    )


def standard_impact(results: DataFrame, issues: DataFrame, dim: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 10) -> DataFrame:
    """Triggered rules (first ``k``) of each result with the profile of its action."""
    from cadenza.core.rangejoin import top_k

    keys = list(keys)
    first = top_k(issues, keys, order, k)
    lists = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "code"))), lambda x: x["code"]).alias("triggered"))
    d = results.join(dim.select("action_type", "family", "mode"), "action_type", "left").join(lists, keys, "left")
    return d.select(*keys, "action_type", "family", "mode", F.coalesce("triggered", F.array().cast("array<string>")).alias("triggered"))


def session_facts(jobs: DataFrame, issues: DataFrame, volume: DataFrame, history: DataFrame, order: Sequence[Column], k: int = 8) -> DataFrame:
    """Facts of a session report: first priorities, red flags, volume and trend."""
    from cadenza.core.rangejoin import top_k

    first = top_k(issues, ["job_id"], order, k).groupBy("job_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "code"))), lambda x: x["code"]).alias("priorities"))
    red = issues.groupBy("job_id").agg(F.count_if(F.col("severity") == "red").alias("red_flags"), F.count_if(F.col("severity") == "yellow").alias("yellow_flags"))
    trend = F.when(F.col("previous_job").isNull(), "first").when(F.col("score_change").isNull(), "known").when(F.col("score_change") >= 0, "up").otherwise("down")
    d = jobs.join(first, "job_id", "left").join(red, "job_id", "left").join(volume, "job_id", "left").join(history.select("job_id", "previous_job", "score_change"), "job_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return d.select(*jobs.columns, F.coalesce("priorities", F.array().cast("array<string>")).alias("priorities"), zero("red_flags").alias("red_flags"), zero("yellow_flags").alias("yellow_flags"),
                    zero("sets").alias("sets"), zero("tonnage_kg").alias("tonnage_kg"), trend.alias("trend"), "score_change")


# Fields with counts that are not shown to users.
COUNT_FIELDS = [
    "repCount", "repCountSource", "repEvents", "repIndexes", "repSegmentation", "visualRepEstimate", "finalRepCount",
    "repCountReason", "primaryRepCount", "secondaryRepCount", "fusedRepCount", "counterRule",
]


def without_fields(df: DataFrame, names: Sequence[str] = tuple(COUNT_FIELDS), prefix: str | None = None) -> DataFrame:
    """Drop the named fields at every depth of the schema (and columns that start
    with ``prefix``)."""
    from pyspark.sql import types as T

    def strip(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            kept = [f for f in t.fields if f.name not in names]
            return F.when(c.isNotNull(), F.struct(*[strip(c[f.name], f.dataType).alias(f.name) for f in kept]))
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.ArrayType)):
            return F.transform(c, lambda x: strip(x, t.elementType))
        return c

    keep = [f for f in df.schema.fields if f.name not in names and not (prefix and f.name.startswith(prefix))]
    return df.select(*[strip(F.col(f.name), f.dataType).alias(f.name) for f in keep])
