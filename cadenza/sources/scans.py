"""File scans and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.core.num import clamp, finite
from cadenza.functions.landmarks import SLOT

ISSUE = "struct<code:string,severity:string,title:string,observation:string,correction:string,confidence:double>"
JUDGMENT = "struct<timeMs:bigint,state:string>"
SEGMENT = "struct<startTimeMs:bigint,endTimeMs:bigint,state:string>"
VIDEO = (
    "struct<actionType:string,family:string,captureQuality:string,overallScore:double,safetyLevel:string,"
    f"issues:array<{ISSUE}>,frameJudgments:array<{JUDGMENT}>,judgmentSegments:array<{SEGMENT}>>"
)
# a bare video record, or one nested under result / analysis.videos / videos
RESULT = (
    f"ok boolean, error string, result {VIDEO}, analysis struct<videos:array<{VIDEO}>>, videos array<{VIDEO}>, actionType string, "
    "family string, captureQuality string, overallScore double, safetyLevel string, "
    f"issues array<{ISSUE}>, frameJudgments array<{JUDGMENT}>, judgmentSegments array<{SEGMENT}>"
)
JOB = (
    "id string, userKey string, mode string, title string, trainingDate string, bodyPart string, status string, "
    "progress double, createdAt string, updatedAt string, videos array<struct<id:string,actionType:string>>, _bad string"
)
CASE = (
    "struct<id:string,actionType:string,view:string,resultPath:string,"
    "consensusUnstableRangesMs:array<array<bigint>>,unstableRangesMs:array<array<bigint>>,ignoreRangesMs:array<array<bigint>>,"
    "annotators:array<struct<annotatorId:string,unstableRangesMs:array<array<bigint>>>>>"
)


def frame_step(source_fps: Column, sample_fps: float = 10.0) -> Column:
    """Sampling step that brings the source rate down to the configured one."""
    wanted = min(15.0, max(4.0, sample_fps))
    rate = F.least(F.lit(wanted), F.greatest(F.lit(4.0), source_fps))
    return F.greatest(F.lit(1), F.bround(source_fps / rate).cast("int"))


def sample_frames(frames: DataFrame, source_fps: str = "source_fps", sample_fps: float = 10.0) -> DataFrame:
    """Keep every step-th source frame; adds the effective ``fps``."""
    step = frame_step(F.col(source_fps), sample_fps)
    return frames.where(F.col("frame_index") % step == 0).withColumn("fps", F.col(source_fps) / step)


def scan_frames(spark: SparkSession, path: str, sample_fps: float = 10.0) -> DataFrame:
    return sample_frames(spark.read.parquet(path), sample_fps=sample_fps)


def video_of(df: DataFrame) -> DataFrame:
    """Unwrap the result envelope to one ``video`` struct per record."""
    fields = [f.split(":")[0] for f in ("actionType", "family", "captureQuality", "overallScore", "safetyLevel", "issues", "frameJudgments", "judgmentSegments")]
    bare = F.when(F.col("frameJudgments").isNotNull() | F.col("actionType").isNotNull(), F.struct(*fields))
    first = lambda a: F.when(F.size(a) > 0, F.get(a, F.lit(0)))
    return df.withColumn("video", F.coalesce(bare, F.col("result"), first(F.col("analysis.videos")), first(F.col("videos"))))


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return video_of(raw.withColumn("file", F.col("_metadata.file_path"))).select("file", "ok", "error", "video")


def parse_results(df: DataFrame, column: str = "value") -> DataFrame:
    parsed = df.withColumn("_r", F.from_json(column, RESULT)).select(*[c for c in df.columns if c != column], "_r.*")
    return video_of(parsed)


def scan_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records of all users; a damaged file is skipped, not fatal."""
    raw = spark.read.schema(JOB).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return job_times(raw.where("_bad IS NULL AND id IS NOT NULL").drop("_bad"))


def parse_jobs(df: DataFrame, column: str = "value") -> DataFrame:
    parsed = df.select(F.from_json(column, JOB, {"columnNameOfCorruptRecord": "_bad"}).alias("j")).select("j.*")
    return job_times(parsed.where("_bad IS NULL AND id IS NOT NULL").drop("_bad"))


def job_times(df: DataFrame) -> DataFrame:
    return df.withColumn("createdAt", F.try_to_timestamp("createdAt")).withColumn("updatedAt", F.try_to_timestamp("updatedAt"))


def pairs(ranges: Column) -> Column:
    """[[start, end], ...] to sorted structs; short pairs are dropped."""
    from cadenza.operators.evaluation import normalize_ranges

    ok = F.filter(F.coalesce(ranges, F.array().cast("array<array<bigint>>")), lambda r: F.size(r) >= 2)
    return normalize_ranges(F.transform(ok, lambda r: F.struct(r[0].alias("start_ms"), r[1].alias("end_ms"))))


def manifest_cases(df: DataFrame, cases: str = "cases") -> DataFrame:
    c = df.select(F.explode(cases).alias("c"))
    note = lambda i: pairs(F.get(F.col("c.annotators"), F.lit(i))["unstableRangesMs"])
    return c.select(
        F.coalesce("c.id", F.lit("unknown")).alias("case_id"), F.coalesce("c.actionType", F.lit("unknown")).alias("action_type"),
        F.coalesce("c.view", F.lit("unknown")).alias("view"), F.col("c.resultPath").alias("result_path"),
        pairs(F.coalesce("c.consensusUnstableRangesMs", "c.unstableRangesMs")).alias("expected"), pairs(F.col("c.ignoreRangesMs")).alias("ignored"),
        F.when(F.size("c.annotators") >= 2, note(0)).alias("rater_a"), F.when(F.size("c.annotators") >= 2, note(1)).alias("rater_b"),
    )


def parse_manifest(df: DataFrame, column: str = "value") -> DataFrame:
    """Cases of manifests that are a record with ``cases`` or a bare list."""
    whole = F.when(F.trim(column).startswith("["), F.concat(F.lit('{"cases":'), F.col(column), F.lit("}"))).otherwise(F.col(column))
    return manifest_cases(df.select(F.from_json(whole, f"cases array<{CASE}>").alias("m")).select("m.cases"))


def normal_path(c: Column) -> Column:
    """Path without scheme, empty and ``.`` parts; ``..`` takes its parent away."""
    parts = F.filter(F.split(F.regexp_replace(c, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, none, step), "/")


def scan_eval_manifest(spark: SparkSession, path: str, results_path: str) -> DataFrame:
    """Manifest cases joined to their result files; a case names its file
    relative to ``results_path`` or by a full path."""
    cases = parse_manifest(spark.read.option("wholetext", True).text(path))
    results = scan_results(spark, results_path).select(normal_path(F.col("file")).alias("_path"), "video")
    full = F.when(F.col("result_path").startswith("/") | F.col("result_path").contains("://"), F.col("result_path"))
    named = F.coalesce(full, F.concat(F.lit(results_path.rstrip("/") + "/"), F.col("result_path")))
    return cases.withColumn("_path", normal_path(named)).join(results, "_path", "left").drop("_path")


# Short spellings of landmark names.
SHORT = {f"{s[0]}_{p}": f"{s}_{p}" for s in ("left", "right") for p in ("shoulder", "elbow", "wrist", "hip", "knee", "ankle")}


def parse_priors(df: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """Keypoint priors from JSON text: one object or a list, camel or snake case,
    points as objects or arrays.  One row per usable point."""
    body = "frameIndex string, frame_index string, timeMs string, time_ms string, source string, landmarks map<string,string>, keypoints map<string,string>"
    listed = F.when(F.trim(column).startswith("["), F.col(column)).otherwise(F.concat(F.lit("["), F.col(column), F.lit("]")))
    d = df.select(*keys, F.posexplode(F.from_json(listed, f"array<struct<{body.replace(' ', ':').replace(',:', ',')}>>")).alias("prior_no", "p"))
    points = F.when(F.size("p.landmarks") > 0, F.col("p.landmarks")).otherwise(F.col("p.keypoints"))
    d = d.select(*keys, "prior_no", F.coalesce("p.frameIndex", "p.frame_index").try_cast("double").cast("long").alias("frame_index"),
                 F.coalesce("p.timeMs", "p.time_ms").try_cast("double").cast("long").alias("time_ms"), F.coalesce("p.source", F.lit("vision_prior")).alias("source"),
                 F.explode(points).alias("name", "body"))
    name = F.lower(F.trim(F.regexp_replace("name", "[- ]", "_")))
    full = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    slots = F.create_map(*[F.lit(x) for kv in SLOT.items() for x in kv])
    slot = F.try_element_at(slots, F.coalesce(F.try_element_at(full, name), name))
    obj = F.from_json("body", "x string, y string, z string, confidence string")
    arr = F.from_json("body", "array<string>")
    is_arr = F.trim("body").startswith("[")
    get = lambda i, f: F.when(is_arr, F.get(arr, F.lit(i))).otherwise(obj[f])
    num = lambda i, f, dflt: F.when(get(i, f).isNull(), F.lit(dflt)).otherwise(get(i, f).try_cast("double"))
    x, y = get(0, "x").try_cast("double"), get(1, "y").try_cast("double")
    z, conf = num(2, "z", 0.0), num(3, "confidence", 1.0)
    d = d.select(*keys, "prior_no", "frame_index", "time_ms", "source", slot.alias("slot"), clamp(x).alias("x"), clamp(y).alias("y"), z.alias("z"),
                 F.greatest(F.lit(0.75), clamp(conf)).alias("conf"), (x.isNotNull() & y.isNotNull() & z.isNotNull() & conf.isNotNull()).alias("_ok"))
    return d.where("_ok AND slot IS NOT NULL").drop("_ok")


def result_record(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One JSON record per row; non-finite numbers become null."""
    kinds = dict(df.dtypes)
    safe = [(finite(F.col(f)) if kinds[f] in ("double", "float") else F.col(f)).alias(f) for f in fields]
    return df.select(*keys, F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("record"))


def write_results(df: DataFrame, path: str, partition: str = "action_type") -> None:
    """Parquet result table, one folder per action; Spark's commit protocol makes
    the write atomic and safe to repeat."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)
