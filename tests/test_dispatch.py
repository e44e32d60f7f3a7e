"""Both engines in one pass give the rows of one pass each."""

from pyspark.sql import functions as F

from cadenza.functions import dims
from cadenza.operators.dispatch import segment, segment_engines

K = ["k"]


def test_both_engines_at_once_equal_one_after_the_other(spark):
    names = ["chest_supported_row", "plate_loaded_pulldown", "lat_pulldown", "hack_squat", "preacher_curl"]
    rows = [(k, i, 60, i * 100, 1.0, float(90 + 85 * ((i * (k + 3)) % 17 - 8) / 8), a, dims.ACTIONS[a][0]) for k, a in enumerate(names) for i in range(60)]
    sig = spark.createDataFrame(rows, "k long, pose_idx long, n long, time_ms long, quality double, v double, action_type string, family string")
    cols = ["k", "algorithm", "rep_index", "start_idx", "key_idx", "end_idx"]
    got = segment_engines(sig, K, "v", 10.0)
    for secondary in (False, True):
        want = sorted(map(tuple, segment(sig, K, "v", 10.0, secondary).select(cols).collect()))
        assert want and sorted(map(tuple, got.where(F.col("secondary") == secondary).select(cols).collect())) == want
    # only the two actions that the engines count differently are series of their own per engine
    assert {(r.k, r.algorithm) for r in got.where("secondary").collect()} != {(r.k, r.algorithm) for r in got.where("not secondary").collect()}
