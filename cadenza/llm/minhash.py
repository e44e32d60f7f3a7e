"""Pairs of texts whose sets of five-word shingles are alike (Jaccard >= 0.8).

160 minima per text (MinHash) are read as 32 bands of five; texts that agree in
some band are candidates, and every candidate is decided by its exact Jaccard
index.  A pair at exactly 0.8 is no candidate with a chance of (1 - 0.8^5)^32,
three in a million, one at 0.85 with seven in a billion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.session import materialise
from cadenza.llm.common import doc_key
from cadenza.llm.graph import connected_components
from cadenza.llm.simhash import fingerprint

SHINGLE, BANDS, ROWS = 5, 32, 5
BLOCK = 1 << 12  # shingles per step of the minima
_R = np.random.default_rng(20)
PLACE = _R.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
TIMES = _R.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
PLUS = _R.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
BAND = _R.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Different hashes of the five-word shingles, sorted; a text of fewer words
    is one shingle, a text without words has none."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), len(words))], np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    n = len(h) - SHINGLE + 1
    return np.unique(_mix(sum(h[k : k + n] * PLACE[k] for k in range(SHINGLE))))


def bands(grams: np.ndarray) -> np.ndarray:
    """Band keys of a set of shingles that is not empty."""
    low = np.full((BANDS * ROWS, 1), 0xFFFFFFFF, np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), BLOCK):
        low = np.minimum(low, (short[at : at + BLOCK] * TIMES + PLUS).min(axis=1, keepdims=True))
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((rows * BAND).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * STEP).view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, size, keys = [], [], []
        for r, text in enumerate(b.column("text")):
            grams = shingles(text.as_py())
            if len(grams):
                keep.append(r)
                size.append(len(grams))
                keys.append(bands(grams))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(keys or [np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([b.column("k_text").take(pa.array(keep, pa.int64())), pa.array(size, pa.int32()), lists], ["k_text", "n", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            text = b.column("text")[r].as_py()
            grams = pa.array([shingles(text).view(np.int64)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("k_text").slice(r, 1), pa.array([fingerprint(text)], pa.int64()), grams], ["k_text", "bits", "grams"])


def _alike(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (s, t) of texts whose exact Jaccard index is 0.8 or more, with their fingerprints a and b."""
    left = sets.select(F.col("k_text").alias("s"), F.col("bits").alias("a"), F.col("grams").alias("g"))
    right = sets.select(F.col("k_text").alias("t"), F.col("bits").alias("b"), F.col("grams").alias("h"))
    both = pairs.join(left, "s").join(right, "t").withColumn("common", F.size(F.array_intersect("g", "h")))
    return both.where(5 * F.col("common") >= 4 * (F.size("g") + F.size("h") - F.col("common"))).select("s", "t", "a", "b")


def _shared(sets: DataFrame, some: DataFrame) -> DataFrame:
    """(k_text, held): how many shingles of each of ``some`` texts another one
    of them holds too.  A text that stands alone with more than a fifth of its
    shingles is near to none."""
    grams = sets.join(some.select("k_text").distinct(), "k_text").select("k_text", F.explode("grams").alias("gram"))
    twice = materialise(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("gram"))
    return materialise(grams.join(twice, "gram").groupBy("k_text").agg(F.count(F.lit(1)).alias("held")))


def _across(sets: DataFrame, rest: DataFrame) -> DataFrame:
    """Pairs (s, t) of ``rest`` (hub, k_text, n, root) with one hub and two
    roots that may have a Jaccard index of 0.8; none that has is left out.

    With D the shingles in which a text differs from its hub, two texts of n
    and m shingles are near if and only if their D have at least
    (9 |D| + 9 |D'| - n - m) / 18 shingles in common.  Of two classes one text
    is not near the hub (9 |D| > n + size of the hub), which makes that number
    positive and gives each text alone a least number.  So near pairs share
    one of the rarest shingles of both D, and are looked up by these."""
    placed = rest.select("hub", "k_text", "n", "root").distinct()
    hubs = sets.select(F.col("k_text").alias("hub"), F.col("grams").alias("g"))
    differ = F.concat(F.array_except("grams", "g"), F.array_except("g", "grams"))
    sided = placed.join(hubs, "hub").join(sets.select("k_text", "grams"), "k_text").select("hub", "k_text", "n", "root", F.size("g").alias("of"), differ.alias("d"))
    sided = sided.withColumn("size", F.size("d")).withColumn("over", 9 * F.col("size") - F.col("n") - F.col("of"))
    rows = materialise(sided.select("hub", "k_text", "n", "root", "size", "over", F.explode("d").alias("gram")))
    seen = rows.groupBy("hub", "gram").agg(F.count(F.lit(1)).alias("texts"), F.max("over").alias("most")).where("texts > 1 and most > 0").select("hub", "gram", "texts")
    own = Window.partitionBy("hub", "k_text")
    rows = rows.join(seen, ["hub", "gram"]).withColumn("at", F.row_number().over(own.orderBy("texts", "gram"))).withColumn("after", F.count(F.lit(1)).over(own) - F.col("at") + 1)
    rows = materialise(rows.select("hub", "gram", "k_text", "n", "root", "size", "over", "after"))
    alone = F.ceil(F.col("over") / 10)  # |D'| is at least the common part, m at most the hub and D'
    beside = F.greatest(alone, F.ceil((8 * F.col("size") + 1) / 18))  # next to a text that is not near the hub
    far = rows.where((F.col("over") > 0) & (F.col("after") >= alone)).select("hub", "gram", "k_text", "n", "root", "size", "after")
    other = rows.where(F.col("after") >= beside).select("hub", "gram", *[F.col(c).alias(f"{c}_") for c in ("k_text", "n", "root", "size", "after")])
    enough = 18 * F.least("after", "after_") >= 9 * (F.col("size") + F.col("size_")) - F.col("n") - F.col("n_")
    pairs = far.join(other, ["hub", "gram"]).where((F.col("root") != F.col("root_")) & enough)
    return pairs.select(F.least("k_text", "k_text_").alias("s"), F.greatest("k_text", "k_text_").alias("t")).distinct()


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (a, b) of different fingerprints (``simhash.fingerprint``) that
    connect all texts with Jaccard >= 0.8: two such texts are linked or stand
    in one class of links.

    No group lists its pairs.  In every band each text meets only the text of
    its group that meets most others, and the links found make classes.  Groups
    that still hold several classes compare their texts across classes alone,
    so what one class holds is never paired again, and only texts that share
    enough of their shingles with any other come into question; of these a
    text meets those that differ from the central text in the same rare
    shingles as itself (``_across``).  Equal texts
    are one text to the search, so copies in any number make no pairs; null
    texts and texts without words have none; an empty table gives an empty
    result.  The sizes of two sets alone rule out most false candidates before
    any text is fetched."""
    texts = docs.select(doc_key(doc_id, text)[1], F.col(text).cast("string").alias("text"))
    banded = texts.mapInArrow(_banded, "k_text long, n int, keys array<long>").dropDuplicates(["k_text"])
    rows = materialise(banded.select("k_text", "n", F.explode("keys").alias("key")))
    sized = 5 * F.least("n", "m") >= 4 * F.greatest("n", "m")
    shared = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"))
    grouped = materialise(rows.join(shared, "key"))
    met = grouped.groupBy("k_text").agg(F.sum("texts").alias("met"))  # how often a text meets others: greatest at the centre of a group
    centre = grouped.join(materialise(met), "k_text").groupBy("key").agg(F.max(F.struct("met", "k_text", "n")).alias("c"))
    grouped = materialise(grouped.drop("texts").join(materialise(centre.select("key", F.col("c.k_text").alias("hub"), F.col("c.n").alias("m"))), "key"))
    pair = [F.least("hub", "k_text").alias("s"), F.greatest("hub", "k_text").alias("t")]
    star = materialise(grouped.where(sized & (F.col("k_text") != F.col("hub"))).select(*pair).distinct())
    asked = grouped.select("k_text").distinct()
    once = texts.dropDuplicates(["k_text"]).join(asked, "k_text")  # copies go before the join, which deals them to one task
    sets = materialise(once.select("k_text", "text").mapInArrow(_sets, "k_text long, bits long, grams array<long>"))
    near = materialise(_alike(sets, star))
    roots = materialise(connected_components(near.select(F.col("s").alias("a"), F.col("t").alias("b"))))
    classed = materialise(grouped.join(roots, F.col("k_text") == F.col("node"), "left").select("key", "k_text", "n", "hub", F.coalesce("root", "k_text").alias("root")))
    mixed = materialise(classed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key"))
    rest = materialise(classed.join(mixed, "key").select("hub", "k_text", "n", "root").distinct())
    rest = materialise(rest.join(_shared(sets, rest), "k_text").where("5 * held >= 4 * n"))
    across = materialise(_across(sets, rest).join(star, ["s", "t"], "left_anti"))
    every = near.union(_alike(sets, across))
    return every.where("a != b").select("a", "b").distinct()
