"""Queries of the ordered-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import peaks, smoothing
from cadenza.plans.registry import query
from cadenza.plans.views import FPS, sig, sig_sql

SIG = "WITH " + sig_sql()
SIGG = "WITH " + sig_sql(gaps=True)
K = ["user_id"]


def r6(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def q_smooth(src: str, v: str, window: int, out: str = "smoothed", key: str = "user_id", extra: str = "") -> str:
    """Edge-padded mean as a self-contained SELECT over ``src``."""
    r = window // 2
    w = f"PARTITION BY {key} ORDER BY pose_idx"
    return f"""SELECT *, CASE WHEN n < {window} THEN NULL ELSE
 (sum({v}) OVER ({w} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)
 + greatest(0, {r} - pose_idx) * first_value({v}) OVER ({w})
 + greatest(0, pose_idx + {r} - n + 1) * last_value({v}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {window}.0::DOUBLE END AS {out} FROM {src}"""


@query("w1_smooth", SIG + f", s AS ({q_smooth('sig', 'v', 5)}) SELECT user_id, pose_idx, round(smoothed, 6) AS smoothed FROM s")
def w1(spark, d):
    return smoothing.smooth(sig(spark, d), K, "v", 5).select("user_id", "pose_idx", r6("smoothed"))


@query("w2_smooth_shrink", SIG + """ SELECT user_id, pose_idx, round(avg(v) OVER (PARTITION BY user_id ORDER BY pose_idx
 ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM sig""")
def w2(spark, d):
    return smoothing.smooth_shrink(sig(spark, d), K, "v", 5).select("user_id", "pose_idx", r6("smoothed"))


PEAKS = """, rng AS (SELECT user_id, quantile_cont(v, .95) - quantile_cont(v, .05) AS signal_range FROM sig GROUP BY 1),
 w AS (SELECT s.*, signal_range, lag(v) OVER p AS pv, lead(v) OVER p AS nv,
 min(v) OVER (p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS lm, min(v) OVER (p ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS rm
 FROM sig s JOIN rng USING (user_id) WHERE signal_range >= 4 AND n >= 20 WINDOW p AS (PARTITION BY user_id ORDER BY pose_idx)),
 cand AS (SELECT user_id, pose_idx, v, n FROM w WHERE v > pv AND v >= nv AND v - greatest(lm, rm) >= greatest(3.0, signal_range * 0.18)),
 lists AS (SELECT user_id, list(pose_idx ORDER BY v DESC, pose_idx) AS c FROM cand GROUP BY 1),
 kept AS (SELECT user_id, list_reduce(list_prepend([]::BIGINT[], list_transform(c, lambda x: [x])),
   lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k - x[1]) < 10)) = 0 THEN list_concat(acc, x) ELSE acc END) AS k FROM lists),
 peaks AS (SELECT user_id, unnest(k) AS pose_idx FROM kept)"""


@query("w3_find_peaks", SIG + PEAKS + " SELECT user_id, pose_idx, round(s.v, 6) AS v FROM peaks JOIN sig s USING (user_id, pose_idx)")
def w3(spark, d):
    return peaks.detect_repetitions(sig(spark, d), K, "v", FPS).select("user_id", "pose_idx", r6("v"))


FILL = """, k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pose_idx END IGNORE NULLS) OVER p AS pi,
 first_value(CASE WHEN v IS NOT NULL THEN pose_idx END IGNORE NULLS) OVER q AS ni,
 last_value(v IGNORE NULLS) OVER p AS pv, first_value(v IGNORE NULLS) OVER q AS nv FROM sig
 WINDOW p AS (PARTITION BY user_id ORDER BY pose_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 q AS (PARTITION BY user_id ORDER BY pose_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("w4_interpolate", SIGG + FILL + """ SELECT user_id, pose_idx, round(CASE WHEN v IS NOT NULL THEN v
 WHEN pi IS NOT NULL AND ni IS NOT NULL THEN pv + (nv - pv) * ((pose_idx - pi) / (ni - pi)::DOUBLE) ELSE coalesce(pv, nv, 0) END, 6) AS filled FROM k""")
def w4(spark, d):
    return smoothing.interpolate(sig(spark, d, gaps=True), K, "v").select("user_id", "pose_idx", r6("filled"))


@query("w4_fill_mean", SIGG + """ SELECT user_id, pose_idx, round(coalesce(v, avg(v) OVER (PARTITION BY user_id), 0), 9) AS filled FROM sig""")
def w4b(spark, d):
    out = smoothing.fill_with_mean(sig(spark, d, gaps=True), K, "v")
    return out.select("user_id", "pose_idx", F.round("filled", 9).alias("filled"))


ENERGY = f""", d0 AS (SELECT *, abs(v - coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY pose_idx), v)) AS st FROM sig),
 d1 AS ({q_smooth('d0', 'st', 3, 'sm')}), d2 AS (SELECT *, quantile_cont(sm, .9) OVER (PARTITION BY user_id) AS sc FROM d1),
 energy AS (SELECT user_id, pose_idx, n, time_ms, v, quality, CASE WHEN sc < 1e-6 THEN 0 ELSE greatest(0, least(1, sm / sc)) END AS energy FROM d2)"""


@query("w7_motion_energy", SIG + ENERGY + " SELECT user_id, pose_idx, round(energy, 6) AS energy FROM energy")
def w7(spark, d):
    return smoothing.motion_energy(sig(spark, d), K, "v", FPS).select("user_id", "pose_idx", r6("energy"))


@query("w8_active_segments", SIG + """, a AS (SELECT *, pose_idx - lag(pose_idx) OVER (PARTITION BY user_id ORDER BY pose_idx) AS g FROM sig WHERE v >= 60),
 b AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pose_idx) AS isl FROM a)
 SELECT user_id, min(pose_idx) AS start_idx, max(pose_idx) AS end_idx FROM b GROUP BY user_id, isl""")
def w8(spark, d):
    return smoothing.active_segments(sig(spark, d), K, F.col("v") >= 60, 2).select("user_id", "start_idx", "end_idx")


@query("w9_low_confidence_windows", SIG + """, a AS (SELECT *, pose_idx - row_number() OVER (PARTITION BY user_id ORDER BY pose_idx) AS isl FROM sig WHERE quality < .55)
 SELECT user_id, min(pose_idx) AS start_idx, max(pose_idx) AS end_idx, min(time_ms) AS start_ms, max(time_ms) AS end_ms,
 round(min(quality), 6) AS min_confidence FROM a GROUP BY user_id, isl""")
def w9(spark, d):
    out = smoothing.low_confidence_windows(sig(spark, d), K)
    return out.select("user_id", "start_idx", "end_idx", "start_ms", "end_ms", r6("min_confidence"))


JUDGE = """, j AS (SELECT user_id, pose_idx, n, time_ms, CASE WHEN quality < .25 THEN 'unknown' WHEN v >= 90 THEN 'unstable' WHEN v >= 45 THEN 'watch' ELSE 'stable' END AS state,
 CASE WHEN v >= 120 THEN 'screen_right' ELSE 'centered' END AS direction, v AS angle_delta, v / 100 AS score, v / 700 AS confidence,
 CASE WHEN pose_idx % 7 < 5 THEN pose_idx // 7 + 1 END AS rep_index FROM sig)"""


def judged(spark, d):
    s = sig(spark, d)
    return s.select(
        "user_id", "pose_idx", "n", "time_ms",
        F.when(F.col("quality") < 0.25, "unknown").when(F.col("v") >= 90, "unstable")
        .when(F.col("v") >= 45, "watch").otherwise("stable").alias("state"),
        F.when(F.col("v") >= 120, "screen_right").otherwise("centered").alias("direction"),
        F.col("v").alias("angle_delta"), (F.col("v") / 100).alias("score"), (F.col("v") / 700).alias("confidence"),
        F.when(F.col("pose_idx") % 7 < 5, F.floor(F.col("pose_idx") / 7) + 1).alias("rep_index"),
    )


@query("w10_judgment_segments", SIG + JUDGE + """, c AS (SELECT *, CASE WHEN lag(state || direction) OVER p IS DISTINCT FROM (state || direction) THEN 1 ELSE 0 END AS ch FROM j
 WINDOW p AS (PARTITION BY user_id ORDER BY pose_idx)), i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY pose_idx) AS isl FROM c)
 SELECT user_id, state, direction, min(time_ms) AS start_ms, max(time_ms) + 100 AS end_ms, count(*) AS sample_count,
 max(time_ms) - min(time_ms) + 100 AS duration_ms, round(max(abs(angle_delta)), 6) AS max_angle_delta, round(max(score), 6) AS max_score,
 round(avg(confidence), 6) AS confidence, array_to_string(list_sort(list_distinct(list(rep_index) FILTER (WHERE rep_index IS NOT NULL))), ',') AS reps
 FROM i GROUP BY user_id, isl, state, direction""")
def w10(spark, d):
    s = smoothing.judgment_segments(judged(spark, d), K, ["state", "direction"], FPS)
    return s.select(
        "user_id", "state", "direction", "start_ms", "end_ms", "sample_count", "duration_ms",
        r6("max_angle_delta"), r6("max_score"), r6("confidence"),
        F.array_join("rep_indexes", ",").alias("reps"),
    )


@query("w11_baseline_window", SIG + """, w AS (SELECT user_id, pose_idx, n, 9 AS win, list(v) OVER f AS vs, list(quality) OVER f AS cs FROM sig
 WINDOW f AS (PARTITION BY user_id ORDER BY pose_idx ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)),
 sc AS (SELECT user_id, pose_idx, n, list_aggregate(vs, 'quantile_cont', .9) - list_aggregate(vs, 'quantile_cont', .1) + greatest(0, .3 - list_avg(cs)) * 10 AS score
 FROM w WHERE len(list_filter(cs, lambda c: c >= .3)) / len(cs) >= .7 AND len(vs) >= 3 AND pose_idx < greatest(1, greatest(win, least(n, round_even(greatest(win, n * .45), 0)::BIGINT)) - win + 1)),
 b AS (SELECT user_id, min(struct_pack(score := score, i := pose_idx)).i AS i FROM sc GROUP BY 1)
 SELECT u.user_id, coalesce(i, 0) AS start_idx, least(n, coalesce(i, 0) + 9) - 1 AS end_idx FROM (SELECT DISTINCT user_id, n FROM sig) u LEFT JOIN b USING (user_id)""")
def w11(spark, d):
    s = sig(spark, d).withColumn("c2", F.col("quality") + 0.25)
    out = smoothing.baseline_window(s, K, "v", "c2", FPS)
    return out.select("user_id", "start_idx", "end_idx")
