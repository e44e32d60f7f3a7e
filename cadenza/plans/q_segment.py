"""Queries of the repetition operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.core.num import odd_window
from cadenza.core.quantiles import quantiles
from cadenza.core.session import materialise
from cadenza.operators import cycles, peaks, segment, smoothing
from cadenza.plans.q_series import K, PEAKS, q_smooth, r6
from cadenza.plans.registry import query
from cadenza.plans.views import FPS, sig, sig_sql

SIG = "WITH RECURSIVE " + sig_sql()

REPS = """, pk0 AS (SELECT user_id, pose_idx AS key_idx FROM peaks),
 ext AS (SELECT user_id, n, min(struct_pack(v := v, i := pose_idx)).i AS lo, min(struct_pack(v := -v, i := pose_idx)).i AS hi FROM sig
  WHERE user_id NOT IN (SELECT user_id FROM pk0) AND n >= 4 GROUP BY 1, 2),
 st AS (SELECT user_id, n, CASE WHEN abs(hi - lo) < 3 THEN 0 ELSE least(lo, hi) END AS s1, CASE WHEN abs(hi - lo) < 3 THEN n // 3 END AS s2t,
  CASE WHEN abs(hi - lo) < 3 THEN 2 * n // 3 ELSE greatest(lo, hi) END AS s3,
  CASE WHEN abs(hi - lo) < 3 THEN n - 1 ELSE least(n - 1, greatest(lo, hi) + greatest(1, abs(hi - lo) // 2)) END AS s4 FROM ext),
 pk AS (SELECT *, row_number() OVER p AS rep_index, lag(key_idx) OVER p AS pp, lead(key_idx) OVER p AS np FROM
  (SELECT * FROM pk0 UNION ALL SELECT user_id, s3 FROM st WHERE s4 > s1) WINDOW p AS (PARTITION BY user_id ORDER BY key_idx)),
 lr AS (SELECT p.*, s.n, min(struct_pack(v := s.v, i := s.pose_idx)) FILTER (WHERE s.pose_idx <= key_idx AND s.pose_idx >= coalesce((pp + key_idx) // 2, 0)) AS ls,
  min(struct_pack(v := s.v, i := s.pose_idx)) FILTER (WHERE s.pose_idx >= key_idx AND s.pose_idx <= coalesce((np + key_idx) // 2, s.n - 1)) AS rs,
  max(s.v) FILTER (WHERE s.pose_idx = key_idx) AS kv FROM pk p JOIN sig s USING (user_id) GROUP BY ALL),
 reps AS (SELECT r.user_id, r.n, rep_index, ls.i AS start_idx, key_idx, rs.i AS end_idx, ls.i * 100 AS start_ms, key_idx * 100 AS key_ms, rs.i * 100 AS end_ms,
  round_even(round(avg(s.quality), 9), 3) AS quality, round_even(ls.v, 3) AS start_signal, round_even(kv, 3) AS key_signal, round_even(rs.v, 3) AS end_signal,
  round_even(kv - least(ls.v, rs.v), 2) AS amplitude, round_even((rs.i - ls.i) / 10, 2) AS duration_s, round_even((key_idx - ls.i) / 10, 2) AS descent_s, round_even((rs.i - key_idx) / 10, 2) AS ascent_s
  FROM lr r JOIN sig s ON s.user_id = r.user_id AND s.pose_idx BETWEEN ls.i AND rs.i WHERE rs.i > ls.i GROUP BY ALL)"""
OUT = ", ".join(["user_id", *segment.REP_COLUMNS])


def base_reps(spark, d):
    s = sig(spark, d)
    return s, segment.segment_by_peaks(s, peaks.detect_repetitions(s, K, "v", FPS), K, "v", FPS)


@query("w15_segment_by_peaks", SIG + PEAKS + REPS + f" SELECT {OUT} FROM reps")
def w15(spark, d):
    return base_reps(spark, d)[1].select("user_id", *segment.REP_COLUMNS)


ACTIONS = ["bench_press", "hip_thrust", "row"]


def action_col():
    return F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("user_id") % 3 + 1).cast("int"))


CHECKED = """, act AS (SELECT *, ['bench_press', 'hip_thrust', 'row'][user_id % 3 + 1] AS action_type FROM reps),
 chk AS (SELECT *, CASE WHEN action_type = 'bench_press' THEN CASE WHEN (end_idx - start_idx) / 10 < .45 THEN 'too_short'
  WHEN (key_idx - start_idx) / 10 < .25 OR (end_idx - key_idx) / 10 < .25 THEN 'incomplete_cycle' WHEN (end_idx - start_idx) / 10 > 6 THEN 'too_long'
  WHEN key_signal - least(start_signal, end_signal) < 4.5 THEN 'low_amplitude' END
  ELSE CASE WHEN duration_s < .35 THEN 'too_short' WHEN duration_s > CASE WHEN action_type = 'hip_thrust' THEN 8 ELSE 6 END THEN 'too_long' WHEN amplitude < 3 THEN 'low_amplitude' END END AS reason FROM act)"""


@query("s10_validate_reps", SIG + PEAKS + REPS + CHECKED + """ SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY key_idx) AS rep_index,
 start_idx, key_idx, end_idx, amplitude, duration_s FROM chk WHERE reason IS NULL""")
def s10(spark, d):
    valid, _ = segment.validate_reps(base_reps(spark, d)[1], K, action_col(), FPS)
    return valid.select("user_id", "rep_index", "start_idx", "key_idx", "end_idx", "amplitude", "duration_s")


@query("s10_rep_diagnostics", SIG + PEAKS + REPS + CHECKED + """ SELECT user_id, action_type, count(*) AS raw_count, count(*) FILTER (WHERE reason IS NULL) AS valid_count,
 count(reason) AS rejected_count, count(*) FILTER (WHERE reason IS NULL) = 0 OR count(reason) > greatest(1, round_even(CASE WHEN action_type = 'bench_press'
 THEN count(*) FILTER (WHERE reason IS NULL) * .35 ELSE count(*) * .45 END, 0)) AS count_unstable FROM chk GROUP BY 1, 2""")
def s10b(spark, d):
    _, diag = segment.validate_reps(base_reps(spark, d)[1], K, action_col(), FPS)
    return diag.select("user_id", F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("user_id") % 3 + 1).cast("int")).alias("action_type"),
                       "raw_count", "valid_count", "rejected_count", "count_unstable")


@query("t2_stage_frames", SIG + PEAKS + REPS + """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amplitude DESC, quality DESC, duration_s DESC, rep_index) - 1 AS r,
  count(*) OVER (PARTITION BY user_id) AS m FROM reps), ch AS (SELECT user_id, start_idx AS s1, key_idx AS s3, end_idx AS e, NULL AS s2t FROM o WHERE r = CASE WHEN m > 2 THEN m // 2 ELSE 0 END
  UNION ALL SELECT user_id, s1, s3, s4, coalesce(s2t, -1) FROM st WHERE user_id NOT IN (SELECT user_id FROM reps)),
 vv AS (SELECT c.*, max(v) FILTER (WHERE pose_idx = s1) AS vs, max(v) FILTER (WHERE pose_idx = s3) AS vk, max(v) FILTER (WHERE pose_idx = e) AS ve FROM ch c JOIN sig USING (user_id) GROUP BY ALL)
 SELECT user_id, s1 AS stage_1, CASE WHEN s2t >= 0 THEN s2t ELSE min(struct_pack(d := abs(v - (vs + vk) / 2), i := pose_idx)) FILTER (WHERE pose_idx BETWEEN s1 AND s3).i END AS stage_2,
 s3 AS stage_3, CASE WHEN s2t IS NULL THEN min(struct_pack(d := abs(v - (vk + ve) / 2), i := pose_idx)) FILTER (WHERE pose_idx BETWEEN s3 AND e).i ELSE e END AS stage_4
 FROM vv JOIN sig USING (user_id) GROUP BY user_id, s1, s3, e, s2t""")
def t2(spark, d):
    s, reps = base_reps(spark, d)
    return segment.stage_frames(s, reps, K, "v")


SMOOTH_REPS = REPS.replace("FROM sig", "FROM sg").replace("JOIN sig s", "JOIN sg s")


@query("flagship_rep_summary", SIG + f", sg AS (SELECT user_id, pose_idx, n, time_ms, quality, sm AS v FROM ({q_smooth('sig', 'v', 3, 'sm')}))" + PEAKS.replace("FROM sig", "FROM sg") + SMOOTH_REPS
       + """, ok AS (SELECT * FROM reps WHERE duration_s >= .35 AND duration_s <= 6 AND amplitude >= 3) SELECT user_id, count(*) AS rep_count, round(quantile_cont(amplitude, .5), 6) AS amplitude_p50,
 round(quantile_cont(amplitude, .95), 6) AS amplitude_p95, round(avg(duration_s), 9) AS avg_duration_s FROM ok GROUP BY 1""")
def flagship(spark, d):
    """Smooth, find repetitions, validate, summarise per user."""
    s = materialise(smoothing.smooth(sig(spark, d), K, "v", odd_window(FPS * 0.25), "sm"))
    tops = peaks.detect_repetitions(s, K, "sm", FPS)
    valid, _ = segment.validate_reps(segment.segment_by_peaks(s, tops, K, "sm", FPS), K, F.lit("row"), FPS)
    q = quantiles(valid, K, {"amplitude_p50": ("amplitude", 0.5), "amplitude_p95": ("amplitude", 0.95)})
    base = valid.groupBy(*K).agg(F.count(F.lit(1)).alias("rep_count"), F.avg("duration_s").alias("avg_duration_s"))
    return base.join(q, K).select("user_id", "rep_count", r6("amplitude_p50"), r6("amplitude_p95"), F.round("avg_duration_s", 9).alias("avg_duration_s"))


# ---- cycle automata: the SQL side walks cycle by cycle in a recursive query ----------

ARR = ", arr AS (SELECT user_id, n, list(v ORDER BY pose_idx) AS a FROM sig WHERE n >= 4 GROUP BY 1, 2)"
FIRST = "list_filter(range({lo}, {hi}), lambda i: a[i + 1] {cond})[1]"


def q_first(lo, hi, cond):
    return FIRST.format(lo=lo, hi=hi, cond=cond)


def q_cycles(levels: list[dict[str, str]], src: str = "arr") -> str:
    """Recursive walk: each level adds computed columns to the one below; the last
    must define s, k, e, ok and nxt (NULL ends the walk)."""
    inner = f"SELECT x.*, w.nxt AS cur FROM walk w JOIN {src} x USING (user_id) WHERE w.nxt < x.n"
    for level in levels:
        cols = ", ".join(f"{expr} AS {name}" for name, expr in level.items())
        inner = f"SELECT *, {cols} FROM ({inner})"
    return f""", walk AS (SELECT user_id, 0::BIGINT AS nxt, NULL::BIGINT AS s, NULL::BIGINT AS k, NULL::BIGINT AS e, false AS ok FROM {src}
 UNION ALL SELECT user_id, nxt, s, k, e, ok FROM ({inner}) WHERE nxt IS NOT NULL)
 SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s) AS rep_index, s AS start_idx, k AS key_idx, e AS end_idx FROM walk WHERE ok"""


ARGMAX = "s + list_position(a[s + 1 : {last} + 1], list_max(a[s + 1 : {last} + 1])) - 1"


def q_threshold(rest, work):
    return q_cycles([
        {"s0": q_first("cur", "n", f"<= {rest}")},
        {"f": q_first("s0", "n", f">= {work}")},
        {"b": "greatest(s0, f - 25)"},
        {"fl": "list_min(a[b + 1 : f + 1])", "fx": "list_max(a[b + 1 : f + 1])"},
        {"s": "list_filter(range(b, f + 1), lambda i: a[i + 1] <= fl + greatest(.8, (fx - fl) * .02))[-1]",
         "la": f"least(coalesce({q_first('f + 1', 'n', f'<= {rest}')}, n) - 1, f + 41)"},
        {"k": ARGMAX.format(last="la")},
        {"bk": q_first("k + 1", "least(n, k + 41)", f"<= {rest}")},
        {"e0": "coalesce(bk, least(n - 1, k + 4))"},
        {"e": "CASE WHEN e0 <= s THEN least(n - 1, s + 1) ELSE e0 END"},
        {"ok": f"coalesce(k - s >= 3 AND a[k + 1] - a[s + 1] >= {work - rest}, false)", "nxt": "greatest(e + 1, k + 3)"},
    ])


@query("s1_cycles_threshold", SIG + ARR + q_threshold(45.0, 90.0))
def s1(spark, d):
    r = cycles.cycles_threshold(sig(spark, d), K, "v", FPS)
    return r.select("user_id", "rep_index", "start_idx", "key_idx", "end_idx")


@query("s1_cycles_or_partial")
def s1b(spark, d):
    # thresholds few users reach, so that both paths are taken
    r = cycles.cycles_or_partial(sig(spark, d), K, "v", FPS, 177.0, -300.0)
    return r.select("user_id", "rep_index", "start_idx", "key_idx", "end_idx", "range_status", "amplitude")


def q_low_high(low, top, home, amp, floor_expr, extra_ok="true"):
    return q_cycles([
        {"s": q_first("cur", "n", f"<= {low}")},
        {"f": q_first("s", "least(n, s + 62)", f">= {top}")},
        {"la": f"least(coalesce({q_first('f + 1', 'n', f'<= {home}')}, n) - 1, greatest(f + 1, s + 61))"},
        {"la2": "CASE WHEN f IS NULL THEN NULL ELSE greatest(f, la) END"},
        {"k": ARGMAX.format(last="la2")},
        {"bk": q_first("k + 1", "least(n, k + 61)", f"<= {home}")},
        {"e0": "coalesce(bk, least(n - 1, la2))"},
        {"e": "CASE WHEN e0 <= s THEN least(n - 1, s + 1) ELSE e0 END"},
        {"ok": f"coalesce(k - s >= 2 AND a[k + 1] - {floor_expr} >= {amp} AND {extra_ok}, false)", "nxt": "greatest(e + 1, k + 2)"},
    ])


@query("s2_cycles_low_high", SIG + ARR + q_low_high("60", "110", "60", 48, "a[s + 1]"))
def s2(spark, d):
    r = cycles.cycles_low_high(sig(spark, d), K, "v", FPS)
    return r.select("user_id", "rep_index", "start_idx", "key_idx", "end_idx")


ARR3 = """, arr AS (SELECT user_id, n, list(v ORDER BY pose_idx) AS a, {low} AS lo, greatest({low} + 25, quantile_cont(v, {p})) AS hi FROM sig WHERE n >= 4 GROUP BY 1, 2)"""


@query("s3_cycles_adaptive", SIG + ARR3.format(low="least(140.0::DOUBLE, quantile_cont(v, .3) + 5)", p=".78")
       + q_low_high("lo", "hi", "lo + 4", 25, "least(a[s + 1], a[e + 1])", "(e - s) / 10 >= .45"))
def s3(spark, d):
    r = cycles.cycles_adaptive(sig(spark, d), K, "v", FPS)
    return r.select("user_id", "rep_index", "start_idx", "key_idx", "end_idx")


def q_hinge(limit, ok):
    return q_cycles([
        {"s": q_first("cur", "n", "<= lo")},
        {"k": q_first("s", f"least(n, s + {limit + 2})", ">= hi")},
        {"e": f"least(coalesce({q_first('k', 'n', '<= lo + 5')}, n - 1), k + {limit + 1})"},
        {"ok": f"coalesce(a[e + 1] <= lo + 12 AND a[k + 1] - a[s + 1] >= 25 AND {ok}, false)",
         "nxt": "CASE WHEN k IS NOT NULL THEN greatest(e + 1, k + 1) END"},
    ])


HINGE_ARR = ARR3.format(low="greatest(10.0::DOUBLE, quantile_cont(v, .25) + 5)", p=".8")


@query("s4_cycles_hinge", SIG + HINGE_ARR + q_hinge(85, "(e - s) / 10 >= .55"))
def s4(spark, d):
    r = cycles.cycles_hinge(sig(spark, d), K, "v", FPS)
    return r.select("user_id", "rep_index", "start_idx", "key_idx", "end_idx")


@query("s6_cycles_hinge_simple", SIG + HINGE_ARR + q_hinge(100, "true"))
def s6(spark, d):
    r = cycles.cycles_hinge_samples(sig(spark, d), K, "v", FPS)
    return r.select("user_id", "rep_index", "start_idx", "key_idx", "end_idx")


@query("s5_cycles_elbow", SIG + ARR + q_cycles([
    {"s": q_first("cur", "n", ">= 60")},
    {"j": """list_filter(range(s + 1, least(n, s + 82)), lambda i: i - s > 80 OR (list_min(a[s + 2 : i + 1]) <= 20
      AND i > s + list_position(a[s + 1 : i + 1], list_min(a[s + 1 : i + 1])) + 1 AND a[i + 1] >= list_min(a[s + 1 : i + 1]) + 5))[1]"""},
    {"mn": "list_min(a[s + 1 : j + 1])"},
    {"k": "CASE WHEN mn <= 20 AND list_min(a[s + 2 : j + 1]) <= 20 THEN s + list_position(a[s + 1 : j + 1], mn) - 1 END"},
    {"e": f"CASE WHEN a[j + 1] >= 45 THEN j ELSE least(coalesce({q_first('j', 'n', '>= 45')}, n - 1), greatest(j + 1, k + 81)) END"},
    {"ok": "coalesce(k IS NOT NULL AND a[s + 1] - a[k + 1] >= 30, false)", "nxt": "CASE WHEN k IS NOT NULL THEN greatest(e + 1, j + 1) END"},
]))
def s5(spark, d):
    r = cycles.cycles_elbow(sig(spark, d), K, "v", FPS, 60.0, 20.0, 30.0)
    return r.select("user_id", "rep_index", "start_idx", "key_idx", "end_idx")
