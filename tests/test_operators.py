"""Known answers for stability, evaluation, tracking, text and streaming."""

import tempfile

from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.operators import evaluation, jobs, joins, stability, tracking

EMPTY = (0.5, 0.5, 0.0, 0.95)


def skeleton(angle_deg=0.0, **points):
    """33 slots with a trunk tilted by ``angle_deg`` from the vertical."""
    import math

    lm = [EMPTY] * 33
    dx = 0.3 * math.sin(math.radians(angle_deg))
    dy = 0.3 * math.cos(math.radians(angle_deg))
    for slot, side in ((23, -0.05), (24, 0.05)):
        lm[slot] = (0.5 + side, 0.7, 0.0, 0.95)
    for slot, side in ((11, -0.05), (12, 0.05)):
        lm[slot] = (0.5 + side + dx, 0.7 - dy, 0.0, 0.95)
    return lm


def judged(spark, angles, mode="absolute_fixed"):
    data = [(1, i, len(angles), 120 * i, skeleton(a)) for i, a in enumerate(angles)]
    df = spark.createDataFrame(data, "video_id long, pose_idx long, n long, time_ms long, landmarks array<struct<x:double,y:double,z:double,vis:double>>")
    df = df.select("*", F.lit(mode).alias("mode"), F.lit("side").alias("camera_angle"), F.lit(4.5).alias("angle_threshold"), F.lit(4.0).alias("tilt_threshold"),
                   F.lit(320).alias("minimum_ms"), F.lit(240).alias("recovery_ms"), F.lit(0.0).alias("max_coupled_angle"))
    return [r.state for r in stability.stability_judgments(df, 8.33).orderBy("pose_idx").collect()]


def test_sustained_lean_is_unstable_and_a_spike_is_not(spark):
    assert "unstable" in judged(spark, [0] * 8 + [9] * 6 + [0] * 6)
    assert "unstable" not in judged(spark, [0] * 8 + [11] + [0] * 8)
    assert set(judged(spark, [0, 5, 10] * 4, "primary_trunk_motion")) == {"not_evaluated"}


def test_confusion_kappa_and_boundaries(spark):
    frames = spark.createDataFrame([(1, t, s) for t, s in zip(range(0, 600, 100), ["stable", "stable", "unstable", "unstable", "stable", "unknown"])], "case_id int, time_ms long, state string")
    truth = spark.createDataFrame([(1, 180, 420)], "case_id int, start_ms long, end_ms long")
    f = evaluation.flag_ranges(frames, truth, ["case_id"], "actual")
    r = evaluation.confusion(f, ["case_id"], F.col("actual"), F.col("state") == "unstable", F.col("state") != "unknown").first()
    assert (r.tp, r.fp, r.fn, r.ignored) == (2, 0, 1, 1)
    m = evaluation.boundary_metrics(truth, spark.createDataFrame([(1, 200, 400)], truth.schema), ["case_id"]).first()
    assert (m.matched_segments, m.mean_onset_error_ms, m.mean_offset_error_ms) == (1, 20.0, 20.0)
    same = spark.createDataFrame([(1, True), (1, False)], "k int, a boolean")
    assert evaluation.cohens_kappa(same, ["k"], F.col("a"), F.col("a")).first().kappa == 1.0


def brute_match(expected, predicted):
    left, out = set(range(len(predicted))), []
    for e in sorted(expected):
        best = (0.0, -1)
        for i in left:
            p = sorted(predicted)[i]
            over, union = max(0, min(e[1], p[1]) - max(e[0], p[0])), max(e[1], p[1]) - min(e[0], p[0])
            best = max(best, (over / union if union else 0.0, i))
        if best[0] > 0:
            left.remove(best[1])
            out.append((e, sorted(predicted)[best[1]]))
    return sorted(out)


def test_greedy_matching_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    for seed in range(3):
        make = lambda n: [(s, s + rng.randrange(1, 900)) for s in rng.sample(range(0, 20_000, 50), n)]
        e, p = make(25), make(25)
        to = lambda xs: spark.createDataFrame([(1, a, b) for a, b in xs], "case_id int, start_ms long, end_ms long")
        got = evaluation.boundary_match(to(e), to(p), ["case_id"]).collect()
        assert sorted(((r.expected_start, r.expected_end), (r.predicted_start, r.predicted_end)) for r in got) == brute_match(e, p)


def test_hysteresis_sequence(spark):
    states = ["unstable", "stable", "watch", "stable", "stable", "stable", "stable", "unknown", "stable"]
    scores = [1.2, 0.1, 0.8, 0.1, 0.1, 0.1, 0.7, 0.0, 0.1]
    df = spark.createDataFrame([(1, i, 9, s, x) for i, (s, x) in enumerate(zip(states, scores))], "k int, pose_idx long, n long, state string, score double")
    got = [r.state for r in stability.hysteresis(df, ["k"], recovery=2).orderBy("pose_idx").collect()]
    assert got == ["unstable", "recovering", "unstable", "recovering", "recovering", "stable", "stable", "unknown", "stable"]


def test_tracker_ignores_a_far_smaller_person():
    big = {"no": 0, "base": 0.7, "x1": 0.1, "y1": 0.2, "x2": 0.4, "y2": 0.9}
    small = {"no": 1, "base": 0.75, "x1": 0.85, "y1": 0.5, "x2": 0.9, "y2": 0.6}
    out, held = tracking.choose([big], None)
    assert out["selected"] == 0
    out, held = tracking.choose([small], held)
    assert out["rejected"] and held["x1"] == 0.1
    out, _ = tracking.choose([small, big], held)
    assert out["selected"] == 0 and not out["switched"]


def test_stream_equals_batch(spark):
    from cadenza.plans.catalog import queries

    d = "/root/testdata/sf0.001"
    q = queries()
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(q["st1_track_target_stream"](spark, d)) == key(q["s7_track_target"](spark, d))


def test_text_repair(spark):
    known = ["训练视频的问题与建议", "动作质量分析结果很好"]  # an even number of bytes each, so nothing is lost on the way
    damaged = [w.encode().decode("gb18030") for w in known]
    df = spark.createDataFrame([("plain lat pulldown",), *[(x,) for x in damaged], ("鐨勭殑鐨",)], "t string")
    with text.charsets(spark):
        got = [r[0] for r in df.select(text.repair_text(F.col("t"))).collect()]
    assert got[0] == "plain 高位下拉"
    assert got[1:3] == known
    drop = spark.createDataFrame([("膝盖稳定。请重拍视频！继续",)], "t string").select(text.drop_sentences(F.col("t"))).first()[0]
    assert drop == "膝盖稳定。继续"


def test_positional_fallback_and_phase(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "job int, id string, pos int")
    b = spark.createDataFrame([(1, "x", 5, 10), (1, "zz", 1, 20)], "job int, id string, pos int, score int")
    assert [r.score for r in joins.join_or_position(a, b, ["job"], "id", "pos", ["score"]).orderBy("pos").collect()] == [10, 20]
    f = spark.createDataFrame([(1, i, 100 * i) for i in range(8)], "k int, pose_idx long, time_ms long")
    reps = spark.createDataFrame([(1, 1, 100, 300, 500)], "k int, rep_index int, start_ms long, key_ms long, end_ms long")
    got = [r.phase for r in joins.phase_timeline(f, reps, ["k"], 70).orderBy("pose_idx").collect()]
    assert got == ["between_reps", "to_key", "to_key", "key", "return", "return", "between_reps", "between_reps"]


def test_json_files(spark):
    import json
    import os

    from cadenza.sources import scans

    d = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(f"{d}/u1/j1")
    json.dump({"id": "j1", "status": "done", "createdAt": "2024-01-02T03:04:05Z"}, open(f"{d}/u1/j1/job.json", "w"))
    open(f"{d}/u1/bad.json", "w").write("{oops")
    assert [r.id for r in scans.scan_jobs(spark, d).collect()] == ["j1"]
    r = tempfile.mkdtemp(prefix="spark-")
    json.dump({"frameJudgments": [{"timeMs": 1, "state": "stable"}], "actionType": "row"}, open(f"{r}/a.json", "w"))
    json.dump({"ok": True, "result": {"actionType": "dip"}}, open(f"{r}/b.json", "w"))
    m = tempfile.mkdtemp(prefix="spark-")
    json.dump({"cases": [{"id": "c", "resultPath": "./a.json", "unstableRangesMs": [[5, 1]]}]}, open(f"{m}/m.json", "w"))
    assert sorted(x.video.actionType for x in scans.scan_results(spark, r).collect()) == ["dip", "row"]
    for folder in ("u1", "u2"):
        os.makedirs(f"{r}/{folder}")
        json.dump({"actionType": folder}, open(f"{r}/{folder}/result.json", "w"))
    json.dump([{"id": "1", "resultPath": "u1/result.json"}, {"id": "2", "resultPath": f"{r}/u1/.././u2/result.json"}, {"id": "3", "resultPath": "u3/result.json"}], open(f"{m}/list.json", "w"))
    listed = scans.scan_eval_manifest(spark, f"{m}/list.json", r).collect()
    assert {(c.case_id, c.video and c.video.actionType) for c in listed} == {("1", "u1"), ("2", "u2"), ("3", None)} and len(listed) == 3
    case = scans.scan_eval_manifest(spark, f"{m}/m.json", r).first()
    assert case.video.actionType == "row" and case.expected[0].end_ms == 5
    assert jobs.user_key(F.lit("a" * 16)) is not None


def test_late_frames_come_out_marked(spark):
    import uuid

    from cadenza.core.session import ensure_checkpoint_dir, settings
    from cadenza.streaming.live import track_target_stream

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/late-{uuid.uuid4().hex}"
    person = "array<struct<no:double,base:double,x1:double,y1:double,x2:double,y2:double>>"
    rows = lambda frames: spark.createDataFrame([(1, k, [(0.0, 0.9, 0.1, 0.1, 0.4, 0.9)]) for k in frames], f"video_id long, frame_index long, people {person}")
    for part in ([0, 1, 5], [3, 5, 6]):
        rows(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        store = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
        with settings(spark, store):
            out = track_target_stream(spark.readStream.schema(rows([0]).schema).parquet(f"{base}/in"))
            out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["frame_index"], r["late"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(0, False), (1, False), (3, True), (5, False), (5, True), (6, False)]
