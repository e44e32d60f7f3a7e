"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Identity of a row: its id and a hash of its text.  Rows equal in both
    are the same document; ids that repeat with other texts stay apart."""
    return [F.col(doc_id).cast("long").alias("k_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k_text")]


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def whole_row(df: DataFrame, alias: str = "row") -> Column:
    """All columns of ``df`` as one struct, safe against clashing names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(alias)


def row_and(df: DataFrame, more: str, row: str = "row") -> StructType:
    """Schema of the struct column ``row`` of ``df`` followed by the columns ``more`` (DDL)."""
    return StructType([df.schema[row], *StructType.fromDDL(more).fields])


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train: Column, most: int, doc_id: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """At most ``most`` labelled training documents per class (label, text and
    the columns ``more`` beside it), in the order of a hash of the id.  ``train``
    is a condition on the column k_id.  The chosen ids are bounded, so they may
    be broadcast; the texts of one id count once."""
    marks = labels.select(F.col(doc_id).cast("long").alias("k_id"), F.col(target).cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & F.col("k_id").isNotNull() & train).groupBy("k_id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(doc_id).cast("long").alias("k_id"), F.struct(F.col(text).cast("string").alias("text"), *more).alias("r"))
    chosen = None
    for label in (1, 0):
        part = marks.where(F.col("label") == label).orderBy(F.xxhash64("k_id"), "k_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    found = rows.join(F.broadcast(chosen), "k_id")
    least = F.min(F.when(F.col("r.text").isNotNull(), F.col("r"))).alias("r")
    return found.groupBy("k_id", "label").agg(least).select("k_id", "label", "r.text", *[F.col(f"r.{c}") for c in more])


def passing(df: DataFrame, text: str) -> tuple[DataFrame, int]:
    """``df`` as one struct column ``row`` that passes through Python, and the
    place of its text in there: the text travels once."""
    if dict(df.dtypes)[text] != "string":
        df = df.withColumn(text, F.col(f"`{text}`").cast("string"))
    return df.select(whole_row(df)), df.columns.index(text)


def inner(batch: pa.RecordBatch, k: int) -> pa.Array:
    """Field number ``k`` of the struct column ``row``."""
    return pc.struct_field(batch.column("row"), [k])
