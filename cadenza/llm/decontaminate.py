"""Benchmark decontamination: a BM25 index of test items, asked by every training passage.

Weights are BM25 impacts of a term in an item, divided by the item's own total,
so a passage that holds all of an item scores 1 for it.  A text is read in
passages of 2 * STRIDE words that overlap by half; an item longer than STRIDE
words is indexed in parts, so every indexed part that a text holds lies whole
in one passage.

Search has two bounds.  Per item its rarest terms, up to all but half of the
threshold in weight, form short *heavy* postings; only passages whose heavy
weight for some item could still reach the threshold go on.  These ask the
inverted index by block-max WAND: the pivot is found with the terms' largest
weights, tested with the largest weights of the blocks it falls in, and blocks
that cannot reach the threshold are skipped.  All items at or above the
threshold come back; none is capped.

A hit counts when five-word shingles of the item's question and of its answer
(the last sentence, or the last third of a single sentence) are found around
the passage: 0.8 of all of them, and half of each side.  An item of fewer than
WHOLE words counts where its words stand there as a whole, in order.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import doc_key, inner, passing

STRIDE, BLOCK, SHINGLE = 64, 32, 5
WHOLE = 8  # shorter items need a full contiguous match
K1, B = 1.2, 0.75
GROUP_BYTES = 32 << 20  # item text in one broadcast index; more items make more indexes
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def sides(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words of an item."""
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


@dataclass
class Item:
    item_id: int
    words: list[str]
    question: list[tuple[str, ...]]
    answer: list[tuple[str, ...]]


class Index:
    """Inverted index over the parts of a bounded group of items."""

    def __init__(self, items: list[tuple[int, str]], n: int, mean: float, df: dict[str, int], threshold: float):
        self.threshold = threshold
        self.items: list[Item] = []
        self.of: list[int] = []  # item of each part
        parts: list[Counter] = []
        for item_id, text in sorted(items):
            q, a = sides(text)
            words = q + a
            self.items.append(Item(item_id, words, shingles(q), shingles(a)))
            count = max(1, math.ceil(len(words) / STRIDE))
            size = math.ceil(len(words) / count)
            for k in range(0, len(words), size):
                parts.append(Counter(words[k : k + size]))
                self.of.append(len(self.items) - 1)
        idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        weights: list[dict[str, float]] = []
        for p in parts:
            norm = K1 * (1 - B + B * sum(p.values()) / max(mean, 1.0))
            w = {t: idf.get(t, math.log(1 + n)) * c * (K1 + 1) / (c + norm) for t, c in p.items()}
            total = sum(w.values())
            weights.append({t: x / total for t, x in w.items()})
        names = sorted({t for w in weights for t in w})
        self.term = {t: k for k, t in enumerate(names)}
        lists: list[list[tuple[int, float]]] = [[] for _ in names]
        heavy: list[list[tuple[int, float]]] = [[] for _ in names]
        self.light = np.zeros(len(parts))
        for part, w in enumerate(weights):
            rest = 1.0
            for t in sorted(w, key=lambda t: (df.get(t, 0), t)):
                lists[self.term[t]].append((part, w[t]))
                if rest > threshold / 2:
                    heavy[self.term[t]].append((part, w[t]))
                    rest -= w[t]
            self.light[part] = max(rest, 0.0)
        self.lists = [([p for p, _ in x], [w for _, w in x]) for x in lists]
        self.most = [max(w) for _, w in self.lists]
        self.blocks = [[(p[min(k + BLOCK, len(p)) - 1], max(w[k : k + BLOCK])) for k in range(0, len(p), BLOCK)] for p, w in self.lists]
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in heavy]))).astype(np.int64)
        self.heavy_part = np.array([p for x in heavy for p, _ in x], np.int64)
        self.heavy_weight = np.array([w for x in heavy for _, w in x])

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all parts whose weight over the distinct ``terms``
        reaches the threshold, with that weight."""
        need = self.threshold - 1e-9
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]  # part, place, term
        out: list[tuple[int, float]] = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                total += self.most[t]
                if total >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            part = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == part:
                pivot += 1
            bound, upto = 0.0, math.inf
            for _, place, t in cursors[: pivot + 1]:
                block = bisect_left(self.blocks[t], (part, 0.0))
                if block < len(self.blocks[t]):
                    end, high = self.blocks[t][block]
                    bound += high
                    upto = min(upto, end)
            if bound < need:  # no part up to the nearest block end can reach it
                after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
                goal = min(upto + 1, after)
                if goal <= part:
                    goal = part + 1
            elif cursors[0][0] == part:
                score = sum(self.lists[t][1][place] for _, place, t in cursors[: pivot + 1])
                if score >= need:
                    out.append((part, score))
                goal = part + 1
            else:
                goal = part
            moved = []
            for k, (at, place, t) in enumerate(cursors):
                if k <= pivot and at < goal:
                    parts = self.lists[t][0]
                    place = len(parts) if goal == math.inf else bisect_left(parts, goal, place)
                    if place < len(parts):
                        moved.append([parts[place], place, t])
                else:
                    moved.append([at, place, t])
            cursors = moved
        return out

    def candidates(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Passages (doc, k) that may reach the threshold for some part.
        ``terms``: term or -1 per word of all texts of a batch; ``starts``: the
        first word of each text, and the end.  Passage k of a text begins at
        word k * STRIDE."""
        at = np.flatnonzero(terms >= 0)
        doc = np.searchsorted(starts, at, side="right") - 1
        k = (at - starts[doc]) // STRIDE
        base = np.concatenate(([0], np.cumsum((np.diff(starts) + STRIDE - 1) // STRIDE)))
        own = base[doc] + k
        first = k > 0
        pairs = np.unique(np.concatenate((own, own[first] - 1)) * len(self.term) + np.concatenate((terms[at], terms[at][first])))
        passage, term = np.divmod(pairs, len(self.term))
        n = self.start[term + 1] - self.start[term]
        place = np.repeat(self.start[term] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        key = np.repeat(passage, n) * len(self.of) + self.heavy_part[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        if not len(key):
            return np.zeros((0, 2), np.int64)
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total = np.add.reduceat(self.heavy_weight[place][order], heads)
        passage, part = np.divmod(key[heads], len(self.of))
        good = np.unique(passage[total + self.light[part] >= self.threshold - 1e-9])
        doc = np.searchsorted(base, good, side="right") - 1
        return np.stack((doc, good - base[doc]), axis=1)

    def verify(self, item: Item, words: list[str], first: int, last: int) -> tuple[float, float] | None:
        """Question and answer overlap around words first..last, or None when too low."""
        reach = len(item.words)
        around = words[max(0, first - reach) : last + reach]
        if reach < WHOLE:
            return (1.0, 1.0) if reach and tuple(item.words) in set(zip(*[around[i:] for i in range(reach)])) else None
        seen = {n: set(zip(*[around[i:] for i in range(n)])) for n in {len(s) for s in (item.question[:1] + item.answer[:1])}}
        hit = [sum(s in seen[len(s)] for s in side) for side in (item.question, item.answer)]
        size = [len(item.question), len(item.answer)]
        if not sum(size) or sum(hit) < 0.8 * sum(size) or any(2 * h < n for h, n in zip(hit, size)):
            return None
        return tuple(h / n if n else 1.0 for h, n in zip(hit, size))

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(text number, item_id, score, question and answer overlap, first word) of every verified hit."""
        get = self.term.get
        words = [words_of(t) if t else [] for t in texts]
        terms = [np.array([get(w, -1) for w in x], np.int64) for x in words]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in words])))
        found: dict[tuple[int, int], list] = {}
        for doc, k in self.candidates(np.concatenate([*terms, np.zeros(0, np.int64)]), starts).tolist():
            own = terms[doc][k * STRIDE : (k + 2) * STRIDE]
            for part, score in self.search(np.unique(own[own >= 0]).tolist()):
                hit = found.setdefault((doc, self.of[part]), [k, k, 0.0])
                hit[1], hit[2] = k, max(hit[2], score)
        for (doc, item), (lo, hi, score) in found.items():
            ok = self.verify(self.items[item], words[doc], lo * STRIDE, (hi + 2) * STRIDE)
            if ok:
                yield doc, self.items[item].item_id, score, *ok, lo * STRIDE


def build_indexes(items: DataFrame, threshold: float = 0.6, item_id: str = "item_id", text: str = "text") -> list[Index]:
    """Indexes over all items that hold a word.  Statistics are those of all
    items; item text is cut into groups of at most GROUP_BYTES
    (measured), one index each."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / GROUP_BYTES))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([len(w) for w in found], pa.int64()), pa.array([sorted(set(w)) for w in found], pa.list_(pa.string()))], ["item_id", "n", "terms"])

    counted = rows.mapInArrow(terms, "item_id long, n long, terms array<string>")
    n, mean = counted.agg(F.count(F.lit(1)), F.avg("n")).first()
    df = counted.select("item_id", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    out = []
    for g in range(groups):
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) if groups > 1 else rows
        texts = [tuple(r) for r in mine.toLocalIterator() if words_of(r["text"])]
        if texts:
            own = {t for _, x in texts for t in words_of(x)}
            known = df if groups == 1 else df.join(mine.mapInArrow(terms, "item_id long, n long, terms array<string>").select(F.explode("terms").alias("term")).distinct(), "term")
            out.append(Index(texts, n, mean or 1.0, {r["term"]: r["df"] for r in known.toLocalIterator() if r["term"] in own}, threshold))
    return out


SMALL = 256  # texts searched together


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and test item it holds: doc_id, item_id, score,
    question_overlap, answer_overlap, first_word (of the first passage that hit).

    Null and empty texts hold nothing; repeated rows give repeated rows; null
    item ids or texts, and items without a word, are not searched; items of
    fewer than WHOLE words need a full contiguous match;
    an empty table on either side gives an empty result; other columns are not
    read.  One pass over the texts per index, without a shuffle."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    rows = docs.select(doc_key(doc_id, text)[0], F.col(text).cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    out = None
    for index in build_indexes(items, threshold):
        shared = sc.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, SMALL):
                    part = b.slice(at, SMALL)
                    got = list(shared.value.matches(part.column("text").to_pylist()))
                    ids = part.column("k_id").take(pa.array([g[0] for g in got], pa.int64()))
                    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array([g[k + 1] for g in got], kind) for k, kind in enumerate(kinds)]], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        hits = rows.mapInArrow(find, schema)
        out = hits if out is None else out.union(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns kept; no shuffle."""
    names = docs.columns
    for index in build_indexes(items, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, SMALL):
                    part = b.slice(at, SMALL)
                    gone = {g[0] for g in shared.value.matches(inner(part, place).to_pylist())}
                    yield part.filter(pa.array([k not in gone for k in range(part.num_rows)], pa.bool_()))

        packed, place = passing(docs, text)
        docs = packed.mapInArrow(keep, packed.schema).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
    return docs
