"""Inputs derived from the driver tables: Spark on one side, the same view as
DuckDB text on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.core.layout import with_ordinal

FPS = 10.0
# Slot of the skeleton -> point number inside an embedding row.
SLOT_POINT = {0: 0, 11: 4, 12: 5, 13: 6, 14: 7, 15: 8, 16: 9, 23: 10, 24: 11, 25: 12, 26: 13, 27: 14, 28: 15}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sig(spark: SparkSession, d: str, gaps: bool = False) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    minute = F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    e = with_ordinal(e, ["user_id"], ["ts", "event_id"], minute)
    v = F.when(F.col("event_id") % 11 != 0, F.col("value")) if gaps else F.col("value")
    return e.select(
        "user_id", "pose_idx", "n", (F.col("pose_idx") * 100).alias("time_ms"), v.alias("v"),
        (((F.col("event_id") * 37) % 100) / F.lit(100.0)).alias("quality"), "event_id",
    )


def sig_sql(gaps: bool = False) -> str:
    v = "CASE WHEN event_id % 11 <> 0 THEN value END" if gaps else "value"
    return f"""sig AS (SELECT user_id, pose_idx, n, pose_idx * 100 AS time_ms, v, quality, event_id FROM (
 SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pose_idx,
 count(*) OVER (PARTITION BY user_id) AS n, {v} AS v, ((event_id * 37) % 100) / 100.0::DOUBLE AS quality FROM events))"""


def frames(spark: SparkSession, d: str, engine: str = "a") -> DataFrame:
    e = table(spark, d, "embeddings")
    shift = 0.0
    if engine == "b":
        e = e.where(F.col("vec_id") % 5 != 0)
        shift = F.col("embedding")[0].cast("double") / 10.0
    e = with_ordinal(e, ["label"], ["vec_id"], F.floor(F.col("vec_id") / 4096))
    c = [F.col("embedding")[i].cast("double") for i in range(64)]

    def point(k: int):
        return F.struct(
            (F.lit(0.5) + c[4 * k] + shift).alias("x"), (F.lit(0.5) + c[4 * k + 1] + shift).alias("y"),
            c[4 * k + 2].alias("z"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.6) + c[4 * k + 3])).alias("vis"),
        )

    empty = F.struct(*[F.lit(v).alias(k) for k, v in (("x", 0.5), ("y", 0.5), ("z", 0.0), ("vis", 0.0))])
    lm = F.array(*[point(SLOT_POINT[s]) if s in SLOT_POINT else empty for s in range(33)])
    return e.select(
        F.col("label").cast("long").alias("video_id"), "vec_id", "pose_idx", "n",
        F.col("vec_id").alias("frame_index"),
        (F.col("pose_idx") * 100).alias("time_ms"), lm.alias("landmarks"),
    )


def frames_sql(engine: str = "a", name: str = "fr") -> str:
    """Flat view: columns x11, y11, z11, v11, ... per used slot."""
    shift = " + embedding[1]::DOUBLE / 10.0" if engine == "b" else ""
    where = " WHERE vec_id % 5 <> 0" if engine == "b" else ""
    cols = []
    for slot, k in SLOT_POINT.items():
        e = [f"embedding[{4 * k + j + 1}]::DOUBLE" for j in range(4)]
        cols += [f"0.5::DOUBLE + {e[0]}{shift} AS x{slot}", f"0.5::DOUBLE + {e[1]}{shift} AS y{slot}",
                 f"{e[2]} AS z{slot}", f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE + {e[3]})) AS v{slot}"]
    return f"""{name} AS (SELECT label::BIGINT AS video_id, vec_id, vec_id AS frame_index,
 row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pose_idx, count(*) OVER (PARTITION BY label) AS n,
 (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 100 AS time_ms, {', '.join(cols)} FROM embeddings{where})"""


# ---- SQL text of the geometry, for the DuckDB side ---------------------------------


def q_min(idx) -> str:
    return f"least({', '.join(f'v{i}' for i in idx)})"


def q_mean(idx) -> str:
    return f"(({' + '.join(f'v{i}' for i in idx)}) / {len(idx)}.0::DOUBLE)"


def q_best(sides) -> str:
    return f"greatest({', '.join(q_mean(s) for s in sides)})"


def q_dist(a: int, b: int) -> str:
    return f"sqrt((x{a}-x{b})*(x{a}-x{b}) + (y{a}-y{b})*(y{a}-y{b}))"


def q_angle(a: int, b: int, c: int) -> str:
    dot = f"((x{a}-x{b})*(x{c}-x{b}) + (y{a}-y{b})*(y{c}-y{b}))"
    den = f"({q_dist(a, b)} * {q_dist(c, b)})"
    return f"(CASE WHEN {den} >= 1e-8 THEN degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {dot} / {den})))) END)"


def q_both(a: str, b: str) -> str:
    return f"coalesce(({a} + {b}) / 2.0::DOUBLE, {a}, {b}, 180.0::DOUBLE)"


def q_bilateral(sides) -> str:
    return q_both(q_angle(*sides[0]), q_angle(*sides[1]))


TRUNK_DX = "((x11+x12)/2 - (x23+x24)/2)"
TRUNK_DY = "((y11+y12)/2 - (y23+y24)/2)"
Q_LEAN = f"degrees(atan2(abs({TRUNK_DX}), greatest(1e-6::DOUBLE, abs({TRUNK_DY}))))"
Q_TORSO = f"greatest(0.12::DOUBLE, sqrt({TRUNK_DX}*{TRUNK_DX} + {TRUNK_DY}*{TRUNK_DY}))"
