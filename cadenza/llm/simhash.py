"""Near-duplicate documents by SimHash and anchor-point covering.

Two 64-bit fingerprints link when they differ in at most three bits.  The bits
are read as two halves, so linked fingerprints differ in at most one bit of
some half (three differences over two halves).  31 bits of each half are
covered by the perfect Hamming code [31, 26]: every word lies within radius one
of exactly one code word, its anchor.  A fingerprint goes to its own anchor as
*home* and, as *visitor*, to every anchor within radius + threshold = 1 + 1
bits: sixteen code words at most.  Whatever is within one bit of a fingerprint
in that half therefore visits its home anchor, and only rows of one anchor are
compared.  The bit of a half that the code leaves out may differ freely, which
only adds candidates; the comparison itself counts all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.session import materialise
from cadenza.llm.common import doc_key, whole_row
from cadenza.llm.graph import connected_components

BLOCK = 1 << 15  # shingles hashed at a time
SEED = 42


def _bits(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """Fingerprint of one text as a signed 64-bit number; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        last = min(n, at + BLOCK)
        part = words[at : last + 2]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = [0, *ends[:-1].tolist()]
        stops = (ends[min(2, len(part) - 1) :] - 1).tolist()
        ones += _bits([xxhash.xxh64_intdigest(joined[s:t], SEED) for s, t in zip(starts, stops)])
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits = pa.array([fingerprint(t) for t in b.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("k_id"), b.column("k_text"), bits], ["k_id", "k_text", "bits"])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k_id, k_text, bits) per row of ``docs``; no shuffle."""
    return docs.select(*doc_key(doc_id, text), F.col(text).cast("string").alias("text")).mapInArrow(
        _fingerprints, "k_id long, k_text long, bits long"
    )


def anchor_flips() -> list[list[int]]:
    """Per syndrome 0..31 the masks that turn a word into the code words within
    two bits of it, the nearest first."""
    bit = lambda i: 1 << (i - 1)  # noqa: E731  position i of 1..31 adds i to the syndrome
    out = [[0]]
    for s in range(1, 32):
        out.append([bit(s)] + [bit(i) | bit(i ^ s) for i in range(1, 32) if i < i ^ s and i != s])
    return out


def _syndrome(word: Column) -> Column:
    """XOR of the positions of the set bits, one parity per syndrome bit."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        out = out + (F.bit_count(word.bitwiseAND(F.lit(mask))) % 2) * (1 << k)
    return out


def links(bits: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) of different values of the column ``bits`` that differ in at
    most ``most`` (0 to 3) bits.  ``bits`` holds each value once.  Pairs are
    tested inside one anchor only; a hot anchor is a skewed equi-join that the
    adaptive planner splits."""
    flips = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in anchor_flips()])
    halves = F.array(*[F.struct(F.lit(h).alias("half"), F.shiftrightunsigned(F.col("bits"), 32 * h).bitwiseAND(F.lit(0x7FFFFFFF)).alias("word")) for h in (0, 1)])
    words = bits.select("bits", F.explode(halves).alias("h")).select("bits", "h.half", "h.word")
    placed = words.withColumn("near", F.element_at(flips, _syndrome(F.col("word")) + 1))
    anchor = (F.col("word").bitwiseXOR(F.col("near")[0]) * 2 + F.col("half")).alias("anchor")
    home = placed.select(anchor, F.col("bits").alias("a"))
    visit = placed.select("bits", "half", "word", F.explode("near").alias("flip")).select(
        (F.col("word").bitwiseXOR(F.col("flip")) * 2 + F.col("half")).alias("anchor"), F.col("bits").alias("b")
    )
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return home.join(visit, "anchor").where(close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """One row (doc_id, bits, component_id) per row of ``docs``.

    component_id is the least doc_id reachable over links.  Null and empty
    texts have fingerprint 0 and link like any other; repeated rows stay, each
    with the same component; an empty table gives an empty result; a null
    doc_id takes part but is never the least one unless it is alone.  Other
    columns of ``docs`` are not read.  Copies are grouped by fingerprint before
    any search, so a group of any size is one row there."""
    marked = materialise(with_fingerprints(docs, doc_id, text))
    rooted = _rooted(marked, F.min("k_id"), most)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(rooted.join(least, "root").select("bits", "component_id"))
    return marked.join(classes, "bits").select(F.col("k_id").alias("doc_id"), "bits", "component_id")


def _rooted(marked: DataFrame, least: Column, most: int, more: DataFrame | None = None) -> DataFrame:
    """(bits, root, least) per different fingerprint."""
    groups = materialise(marked.groupBy("bits").agg(least.alias("least")))
    near = links(groups.select("bits"), most)
    near = near if more is None else near.union(more.select("a", "b"))
    roots = materialise(connected_components(near).select(F.col("node").alias("bits"), "root"))
    return materialise(groups.join(roots, "bits", "left").select("bits", F.coalesce("root", "bits").alias("root"), "least"))


def hex_bits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 3, more: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` of which one stays per component: the one with the
    least doc_id (a null id last, then the least text hash; of rows equal in
    both, the one with the least hash of all columns).  Null and empty texts
    are one component; an empty table gives an empty result.  ``more`` holds
    further links (a, b) between fingerprints.  All columns are kept."""
    marked = materialise(with_fingerprints(docs, doc_id, text))
    order = F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_text")
    stay = _rooted(marked, F.min(order), most, more).groupBy("root").agg(F.min("least").alias("s"))
    stay = materialise(stay.select(F.coalesce("s.k_id", F.lit(0)).alias("s_id"), "s.none", F.col("s.k_text").alias("s_text")))
    packed = docs.select(whole_row(docs), *doc_key(doc_id, text))
    kept = packed.join(stay, (F.coalesce("k_id", F.lit(0)) == F.col("s_id")) & (F.col("k_id").isNull() == F.col("none")) & (F.col("k_text") == F.col("s_text")))
    nth = F.row_number().over(Window.partitionBy("s_id", "none", "s_text").orderBy(F.xxhash64("row")))
    return kept.withColumn("nth", nth).where("nth = 1").select("row.*")
