from cadenza.operators import review

RESULT = "job int, overall_score double, safety_level string, capture_quality string, has_count_issue boolean, rep_count int, codes array<string>, signature_confidence double, window_confidence double"
DECISION = "job int, no int, action string, reason_code string, cap double, confidence double, require_review boolean, note string"


def run(spark, reasons, decisions, codes=(), score=95.0, rows=1):
    results = spark.createDataFrame([(1, score, "green", "good", "COUNT_UNSTABLE" in codes, 7, list(codes), 0.3, 0.1)] * rows, RESULT)
    why = spark.createDataFrame([(1, k, c, s) for k, (c, s) in enumerate(reasons)], "job int, no int, code string, severity string")
    return review.apply_arbitration(results, why, spark.createDataFrame([(1, *d) for d in decisions], DECISION), ["job"]).collect()


def test_decisions_are_validated_and_cut(spark):
    rows = [(1, k, a, " why ", cap, conf, None, " x ") for k, (a, cap, conf) in enumerate(
        [("nonsense", 1.0, 1.0), ("confirm_algorithm", 5.0, 1.5), (" cap_score ", 130.0, -1.0), ("cap_score", float("nan"), None)] + [("request_rerun", 50.0, 0.5)] * 9)]
    got = review.normalise_decisions(spark.createDataFrame(rows, DECISION), ["job"]).orderBy("rn").collect()
    assert [(r.rn, r.action, r.cap, r.confidence) for r in got[:3]] == [(1, "confirm_algorithm", None, 1.0), (2, "cap_score", 100.0, 0.0), (3, "cap_score", None, None)]
    assert len(got) == 8 and {(r.reason_code, r.note, r.require_review) for r in got} == {("why", "x", False)}


def test_effects_keep_their_order_and_add_missing_issues(spark):
    reasons = [("ACTIVE_WINDOW_UNCERTAIN", "yellow"), ("COUNT_UNSTABLE", "yellow")]
    decisions = [(2, "mark_uncertain", "ACTION_CLASS_UNCERTAIN", 72.5, None, False, ""), (1, "mark_insufficient", "X", 10.0, None, False, "no"), (3, "mark_uncertain", "ACTIVE_WINDOW_UNCERTAIN", None, None, False, "")]
    (r,) = run(spark, reasons, decisions, codes=["COUNT_UNSTABLE"])
    assert r.applied == ["mark_active_window_uncertain", "reject_ai_mark_insufficient", "mark_action_class_uncertain", "cap_score_72.5"]
    assert [(x.code, x.severity, x.confidence, x.observation) for x in r.added] == [("ACTIVE_WINDOW_UNCERTAIN", "yellow", 0.1, None), ("ACTION_CLASS_UNCERTAIN", "yellow", 0.3, None)]
    assert (r.overall_score, r.safety_level, r.rep_count, r.cleared, r.review) == (72.5, "yellow", 7, False, True)


def test_insufficient_evidence_clears_the_result(spark):
    (r,) = run(spark, [], [(1, "mark_insufficient", "INSUFFICIENT_EVIDENCE", None, None, True, "dark")])
    assert (r.overall_score, r.safety_level, r.capture_quality, r.rep_count, r.cleared, r.review) == (0.0, "not_applicable", "insufficient", 0, True, True)
    assert r.applied == ["mark_insufficient"] and r.added[0].observation == "dark"


def test_nothing_to_do_and_repeated_rows(spark):
    got = run(spark, [("STAGE_EVIDENCE_VISUAL_REVIEW", "info")], [], rows=2)
    assert [(r.overall_score, r.safety_level, r.review, r.applied, r.added) for r in got] == [(95.0, "green", False, [], [])] * 2
