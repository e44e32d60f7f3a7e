"""Document quality by a factorisation machine.

A text becomes one sparse row: hashed lower-case words with damped counts of
unit length, structure statistics between 0 and 1, and metadata (length class;
a mark where the stored length differs from the text's, another where none is
stored).  Features that no training row has weigh nothing.  Every feature has a weight and a
vector of FACTORS numbers; the score adds, for every pair of features, the
product of their values times the inner product of their vectors.  The pair sum
is taken in linear time as half of (square of sums - sum of squares).
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import fold_of, labelled_sample
from cadenza.llm.lattice import Bounded

WORDS, SHAPES, SIZES, FACTORS = 1 << 15, 16, 16, 8
WIDTH = WORDS + SHAPES + SIZES + 2
SAMPLE = 2500  # labelled documents per class that the machine is fitted on
EPOCHS, BATCH, RATE, DECAY = 15, 64, 0.02, 1e-4

_kind = np.full(256, 6, np.uint8)  # letters beyond ASCII
for _chars, _k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t\n\r\v\f", 3), (b".,;:?'\"()-", 4)):
    _kind[list(_chars)] = _k
for _c in range(128):
    if _kind[_c] == 6:
        _kind[_c] = 5  # other signs


def shapes(text: str, words: list[str], counts: Counter) -> list[float]:
    """SHAPES statistics of a text, each between 0 and 1."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    total = max(1, len(raw))
    share = np.bincount(_kind[raw], minlength=7) / total
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = sum(map(operator.eq, words, words[1:])) / n
    return [
        *share.tolist(), share[1] / max(1e-9, share[0] + share[1]), len(counts) / n, max(counts.values(), default=0) / n, repeated,
        1 - len(set(lines)) / max(1, len(lines)), min(1.0, sum(map(len, words)) / n / 16), text.count("!") / n if n else 0.0,
        min(1.0, text.count("|") / n), min(1.0, len(lines) / n * 4),
    ]


def row_of(text: str | None, n_chars: int | None, bucket: Bounded) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one text."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    values = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
    values /= max(1e-9, np.sqrt((values * values).sum()))
    index = [*map(bucket.__getitem__, counts), *range(WORDS, WORDS + SHAPES)]
    size = len(text)
    meta = [WORDS + SHAPES + min(SIZES - 1, size.bit_length())]
    if n_chars != size:
        meta.append(WORDS + SHAPES + SIZES + int(n_chars is None))
    index += meta
    shape = np.clip(np.nan_to_num(np.array(shapes(text, text.split(), counts))), 0, 1)
    return np.array(index, np.int32), np.concatenate((values, shape, np.ones(len(meta)))).astype(np.float32)


def new_buckets() -> Bounded:
    return Bounded(lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS, 300_000)


class Machine:
    def __init__(self, seed: int = 5):
        self.bias = 0.0
        self.w = np.zeros(WIDTH)
        self.v = np.random.default_rng(seed).standard_normal((WIDTH, FACTORS)) * 0.02

    def parts(self, index: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and factor sums of rows laid end to end; a row is never empty."""
        xv = self.v[index] * values[:, None]
        sums = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat((xv * xv).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[index] * values, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.concatenate(([0], np.cumsum([len(i) for i, _ in rows])[:-1]))
        logit, _ = self.parts(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(sample: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 5) -> Machine | None:
    """Logistic loss by Adam over (label, index, values); None without both labels."""
    label = np.array([y for y, _, _ in sample], float)
    if len(set(label.tolist())) < 2:
        return None
    m, rng, step = Machine(seed), np.random.default_rng(seed), 0
    unmet = np.ones(WIDTH, bool)
    unmet[np.concatenate([i for _, i, _ in sample])] = False
    m.v[unmet] = 0
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.w, m.v)]
    bias = [0.0, 0.0]
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(sample))
        rate = RATE * (1 - 0.9 * epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            size = np.array([len(sample[k][1]) for k in pick])
            index, values = np.concatenate([sample[k][1] for k in pick]), np.concatenate([sample[k][2] for k in pick])
            starts = np.cumsum(size) - size
            logit, sums = m.parts(index, values, starts)
            d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[pick]) * weight[pick] / len(pick)
            each = np.repeat(d, size) * values
            used, inverse = np.unique(index, return_inverse=True)
            pair = each[:, None] * (np.repeat(sums, size, axis=0) - m.v[index] * values[:, None])
            gw = np.bincount(inverse, each, len(used)) + DECAY * m.w[used]
            gv = np.stack([np.bincount(inverse, pair[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * m.v[used]
            step += 1
            grow, flat = 1 - 0.9 ** min(step, 500), 1 - 0.999**step
            for p, g, (a, b) in ((m.w, gw, moments[0]), (m.v, gv, moments[1])):
                a[used] += 0.1 * (g - a[used])
                b[used] += 0.001 * (g * g - b[used])
                p[used] -= rate * a[used] / grow / (np.sqrt(b[used] / flat) + 1e-8)
            g = d.sum()
            bias[0] += 0.1 * (g - bias[0])
            bias[1] += 0.001 * (g * g - bias[1])
            m.bias -= rate * bias[0] / grow / (np.sqrt(bias[1] / flat) + 1e-8)
    return m


def _stored_length(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long").alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """Fits on at most ``sample`` labelled documents per class outside the held-out fold (crc32 mod 5 = 0)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = new_buckets()
        for b in batches:
            rows = [row_of(t, n, bucket) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("k_id"), b.column("label"), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())], ["k_id", "label", "i", "x"])

    chosen = labelled_sample(docs.withColumn("n_chars", _stored_length(docs)), labels, "quality", fold_of(F.col("k_id"), 5) != 0, sample, more=("n_chars",))
    rows = chosen.mapInArrow(cut, "k_id long, label int, i binary, x binary").orderBy("k_id").collect()
    return fit([(r["label"], np.frombuffer(r["i"], np.int32), np.frombuffer(r["x"], np.float32)) for r in rows])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are rows without words and get the score of their
    statistics; repeated rows score alike; without labels of both classes every
    score is 0; an empty table gives an empty result; only text and n_chars are
    inputs of a score.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, bucket = shared.value, new_buckets()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [row_of(t, n, bucket) for t, n in zip(part.column("text").to_pylist(), part.column("n_chars").to_pylist())]
                got = machine.score(rows) if machine else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(got, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id").cast("long"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"), _stored_length(docs))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
