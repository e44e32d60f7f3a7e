"""Shards by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.session import materialise

DIGITS = 3  # hex digits of the shuffle key that make one bucket: 4,096 buckets a stratum
SLICES = 16**DIGITS


def _position(rows: DataFrame, strata: list[str], bucket: str, order: list[str], rank: str, n: str) -> DataFrame:
    """0-based position and row count per stratum in the order of (bucket,
    order).  Rows are ranked inside a bucket; a stratum of any size only brings
    one summary row per bucket together."""
    sizes = rows.groupBy(*strata, bucket).agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*strata) if strata else Window.partitionBy()
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*strata, bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias(n))
    inside = F.row_number().over(Window.partitionBy(*strata, bucket).orderBy(*order))
    ranked = rows.withColumn("_inside", inside).join(materialise(sizes), [*strata, bucket])
    return ranked.withColumn(rank, F.col("_before") + F.col("_inside") - 1).drop("_before", "_inside", bucket)


def interleaved_shards(
    docs: DataFrame, shards: int = 40, seed: int = 7, doc_id: str = "doc_id", text: str = "text", stratum: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, stratum, size, text_crc32, shard, slot.

    Rows of a stratum are shuffled by a seeded digest of (doc_id, text crc),
    row r of n gets the fraction (2 r + 1) / 2 n, and all rows in the order of
    their fractions are cut into ``shards`` runs whose lengths differ by one at
    most.  Any run then holds the strata in the proportions of the whole.
    ``size`` is the UTF-8 length of the text plus 16.  A null text has 0 bytes
    and crc 0; a null stratum is a stratum of its own; repeated rows stay and
    take neighbouring places; with fewer rows than shards some shards stay
    empty; an empty table gives an empty result.  Other columns are not read."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("null")).alias("stratum"),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string")))
    rows = materialise(rows.withColumn("mark", mark).withColumn("bucket", F.substring("mark", 1, DIGITS)))
    ranked = _position(rows, ["stratum"], "bucket", ["mark", "size"], "rank", "n")
    fraction = (F.col("rank") * 2 + 1).cast("double") / (F.col("n") * 2).cast("double")
    mixed = ranked.withColumn("fraction", fraction).drop("rank", "n")
    mixed = materialise(mixed.withColumn("slice", F.floor(F.col("fraction") * SLICES).cast("int")))
    placed = _position(mixed, [], "slice", ["fraction", "mark", "size", "stratum"], "place", "n")
    shard = F.expr(f"(place * {shards}) div n")
    slot = F.col("place") - F.expr(f"(shard * n + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("doc_id", "stratum", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 7, doc_id: str = "doc_id", text: str = "text", stratum: str = "source") -> None:
    """Writes one folder ``shard=K`` per shard, rows in slot order.  Rows meet
    their place by (doc_id, text crc); copies equal in both take the places of
    that pair in any order."""
    plan = interleaved_shards(docs, shards, seed, doc_id, text, stratum).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    crc: Column = F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    keys = ["_id", "_crc"]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_id"), crc.alias("_crc"))
    own = own.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    plan = plan.withColumn("_id", F.coalesce("_id", F.lit(-(2**63)))).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("shard", "slot")))
    joined = own.join(plan, [*keys, "_nth"]).select("_row", "shard", "slot")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
