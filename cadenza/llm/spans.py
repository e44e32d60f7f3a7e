"""Substring dedup over sliding runs of consecutive sentences.

A text is cut into units: sentences (ended by . ! ? and white space) and
lines, and inside them after every word whose hash is the least of the NEAR
words before and after it, so that equal wording is cut alike wherever it
stands and however long its sentence is.  Units that find no such word (a few
words over and over) are cut by length.  From every unit starts one run, and at
every unit ends one: the fewest units, RUN at least, that hold WORDS words.
Together they cover every unit of a repeated passage that holds such a run.
Runs with equal hashes anywhere in the corpus are repeats; the first in the
order (doc_id, text hash, unit) stays, and units covered by any other go.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.session import materialise, stored
from cadenza.llm.common import doc_key, inner, row_and, whole_row

RUN, WORDS, NEAR, LONG, STEP = 3, 15, 3, 24, 12
SMALL = 256  # rows cut at a time
PART = 20_000  # runs of one hash that one task compares with their owner
CUT = "left string, n_units long, n_removed long, words_removed long"
WORD = re.compile(r"\S+")


def _bounds(words: list[str], line_ends: list[int]) -> np.ndarray:
    """Ends of the units, as numbers of words; ``words`` in lower case."""
    n = len(words)
    last = np.fromiter((w[-1] in ".!?" for w in words), bool, n)
    last[np.array(line_ends, np.int64) - 1] = True
    last[-1:] = True
    cut = last.copy()
    if n > 2 * NEAR:
        v = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, n)
        m = n - 2 * NEAR
        mid, least = v[NEAR : NEAR + m], np.ones(m, bool)
        for k in range(NEAR):
            least &= (mid < v[k : k + m]) & (mid <= v[NEAR + 1 + k : NEAR + 1 + k + m])
        ended = np.concatenate(([0], np.cumsum(last)))
        cut[NEAR : NEAR + m] |= least & (ended[2 * NEAR : 2 * NEAR + m] == ended[:m])
    ends = np.flatnonzero(cut) + 1
    size = np.diff(ends, prepend=0)
    if n and size.max() > LONG:
        forced = [np.arange(e - c + STEP, e, STEP) for e, c in zip(ends[size > LONG].tolist(), size[size > LONG].tolist())]
        ends = np.sort(np.concatenate([ends, *forced]))
    return ends


def _units(text: str) -> tuple[np.ndarray, list[int]]:
    """Ends (in words) and hashes of the units of a text, in order."""
    words: list[str] = []
    line_ends = []
    for line in text.lower().split("\n"):
        if part := line.split():
            words += part
            line_ends.append(len(words))
    ends = _bounds(words, line_ends)
    at, hashes = 0, []
    for e in ends.tolist():
        hashes.append(xxhash.xxh64_intdigest(" ".join(words[at:e]).encode("utf-8", "surrogatepass")))
        at = e
    return ends, hashes


def units(text: str) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Spans, word counts and hashes of the units of a text, in order."""
    ends, hashes = _units(text)
    places = [m.span() for m in WORD.finditer(text)]
    spans: list[tuple[int, int]] = []
    first = 0
    for e in ends.tolist():
        start = places[first][0]
        if spans and text[places[first - 1][1] - 1] not in ".!?" and "\n" not in text[spans[-1][1] : start]:
            start = spans[-1][1]
        spans.append((start, places[e - 1][1]))
        first = e
    return spans, np.diff(ends, prepend=0).tolist(), hashes


def runs(counts: list[int], hashes: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(first unit, units) and hash of the runs that start or end at each unit;
    where too few units are left there is none."""
    raw, n = np.array(hashes, dtype=np.uint64).tobytes(), len(counts)
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    ends = np.maximum(np.searchsorted(total, total[:-1] + WORDS), np.arange(n) + RUN)
    starts = np.minimum(np.searchsorted(total, total[1:] - WORDS, side="right") - 1, np.arange(1, n + 1) - RUN)
    on, back = ends <= n, starts >= 0
    both = np.concatenate((np.arange(n)[on] * (n + 1) + ends[on], starts[back] * (n + 1) + np.arange(1, n + 1)[back]))
    found = [divmod(x, n + 1) for x in np.unique(both).tolist()]
    return [(i, e - i) for i, e in found], [xxhash.xxh64_intdigest(raw[8 * i : 8 * e]) for i, e in found]


def _only_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys: list[int] = []
        for text in b.column("text"):
            ends, hashes = _units(text.as_py() or "")
            keys += runs(np.diff(ends, prepend=0), hashes)[1]
            if len(keys) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))], ["h"])
                keys = []
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))], ["h"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k_id, k_text = b.column("k_id"), b.column("k_text")
        size, at, rows, keys, held = [], [], [], [], 0

        def flush():
            take = pa.array(np.concatenate([np.full(len(n), r, np.int64) for r, n in zip(rows, size)]) if rows else np.zeros(0, np.int64))
            cols = [k_id.take(take), k_text.take(take), pa.array(np.concatenate(at or [[]]).astype(np.int64) << 32 | np.concatenate(size or [[]]).astype(np.int64)), pa.array(np.concatenate(keys or [[]]).astype(np.uint64).view(np.int64))]
            return pa.RecordBatch.from_arrays(cols, ["k_id", "k_text", "span", "h"])

        for r, text in enumerate(b.column("text")):
            ends, hashes = _units(text.as_py() or "")
            found, h = runs(np.diff(ends, prepend=0), hashes)
            if found:
                rows.append(r)
                at.append([i for i, _ in found])
                size.append([n for _, n in found])
                keys.append(np.array(h, np.uint64))
                held += len(h)
            if held > 200_000:
                yield flush()
                size, at, rows, keys, held = [], [], [], [], 0
        if rows:
            yield flush()


def _all_runs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(*doc_key(doc_id, text), F.col(text).cast("string").alias("text")).mapInArrow(_spread, "k_id long, k_text long, span long, h long")


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every run that is not the first of its hash: (k_id, k_text, at, n,
    first_id); ``at`` and ``n`` count units.

    The runs are made twice from the text instead of being stored: counting
    needs one partial aggregate of bare hashes, and the repeated hashes,
    written once, meet the runs in an equi-join.  Only runs that are repeats
    are compared by owner: a hash of many copies is dealt to parts of about
    PART rows, and its owner, found by a partial aggregate, goes to every part.
    ``at`` and ``n`` travel as one number."""
    hashes = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_only_hashes, "h long")
    parts = F.ceil(F.col("copies") / PART).cast("int")
    again = stored(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("h").alias("key"), parts.alias("parts")))
    found = stored(_all_runs(docs, doc_id, text).join(again, F.col("h") == F.col("key")).drop("key"))
    owner = F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_text", "span")
    first = found.groupBy(F.col("h").alias("key")).agg(F.min(owner).alias("first"), F.max("parts").alias("parts"))
    first = first.select("key", "first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("f_part"))
    part = F.pmod(F.hash("k_id", "k_text", "span"), F.col("parts"))
    later = ~(F.col("k_id").eqNullSafe(F.col("first.k_id")) & (F.col("k_text") == F.col("first.k_text")) & (F.col("span") == F.col("first.span")))
    at, n = F.shiftright("span", 32).cast("int"), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return found.withColumn("part", part).join(first, (F.col("h") == F.col("key")) & (F.col("part") == F.col("f_part"))).where(later).select("k_id", "k_text", at.alias("at"), n.alias("n"), F.col("first.k_id").alias("first_id"))


def _cutter(k: int):
    """Batches of (row, spans, ...) with the text as field ``k`` of row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SMALL):
                yield _cut(b.slice(at, SMALL), k)

    return run


def _cut(b: pa.RecordBatch, k: int) -> pa.RecordBatch:
    left, whole, gone, lost = [], [], [], []
    for text, spans in zip(inner(b, k), b.column("spans")):
        text, spans = text.as_py(), spans.as_py()
        if not spans:
            left.append(text)
            whole.append(None)
            gone.append(0)
            lost.append(0)
            continue
        at, counts, _ = units(text)
        out = np.zeros(len(at), bool)
        for s in spans:
            out[s["at"] : s["at"] + s["n"]] = True
        keep, last = [], 0
        starts = [*[s for s, _ in at], len(text)]
        for u in np.flatnonzero(out).tolist():
            keep.append(text[last : starts[u]])
            last = starts[u + 1]
        left.append("".join([*keep, text[last:]]).strip() if out.any() else text)
        whole.append(len(at))
        gone.append(int(out.sum()))
        lost.append(int(np.array(counts)[out].sum()))
    cols = [b.column("row"), pa.array(left, pa.string()), pa.array(whole, pa.int64()), pa.array(gone, pa.int64()), pa.array(lost, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["row", "left", "n_units", "n_removed", "words_removed"])


def _covered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    found = repeated_runs(docs, doc_id, text).groupBy("k_id", "k_text").agg(F.collect_list(F.struct("at", "n")).alias("spans"), F.sort_array(F.collect_set("first_id")).alias("first_ids"))
    return materialise(found.select(F.coalesce("k_id", F.lit(0)).alias("f_id"), F.col("k_id").isNull().alias("f_none"), F.col("k_text").alias("f_text"), "spans", "first_ids"))


def _meets():
    return (F.coalesce("k_id", F.lit(0)) == F.col("f_id")) & (F.col("k_id").isNull() == F.col("f_none")) & (F.col("k_text") == F.col("f_text"))


def affected(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` that loses sentences: doc_id, first_ids (the
    documents that keep the repeats), n_units, n_removed, words_removed, text
    (what is left)."""
    rows = docs.select(*doc_key(doc_id, text), F.col(text).cast("string").alias("text")).join(_covered(docs, doc_id, text), _meets())
    packed = rows.select(F.struct("k_id", "first_ids", "text").alias("row"), "spans")
    out = packed.mapInArrow(_cutter(2), row_and(packed, CUT))
    return out.select(F.col("row.k_id").alias("doc_id"), F.col("row.first_ids").alias("first_ids"), "n_units", "n_removed", "words_removed", F.col("left").alias("text"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, repeated runs cut out of the text.

    A null or empty text has no units and stays as it is, and so does a text
    too short for one run.  Rows equal in id and text are one document to the
    search: their repeats are those of that document, so both keep the same
    text.  A text that only repeats earlier ones becomes empty.  An empty
    table gives an empty result; columns of any name pass through."""
    if dict(docs.dtypes)[text] != "string":
        docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    packed = docs.select(whole_row(docs), *doc_key(doc_id, text)).join(_covered(docs, doc_id, text), _meets(), "left").select("row", "spans")
    out = packed.mapInArrow(_cutter(docs.columns.index(text)), row_and(packed, CUT))
    return out.select(*[F.col("left").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
