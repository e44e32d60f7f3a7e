"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of two learned views: an embedding of the hashed word
and the mean embedding of its hashed character trigrams (with word borders).
Two gated recurrent layers read a window in both directions, attention pools
the states, and a linear layer gives the window's logit.  A text is scored over
all its windows of WINDOW words, each STEP words further, the last one flush
with the end; the highest window counts.  Forward and backward passes are
written in numpy; training picks the highest window of every document, since a
label marks the document and not the place.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import fold_of, inner, labelled_sample, passing, row_and

WINDOW, STEP = 48, 36
HIDDEN, DIM, POOL = 8, 8, 8
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 13
SAMPLE = 2500  # labelled documents per class that the network is fitted on
LONGEST = 1 << 19  # characters of a document that may be chosen for fitting; all its windows take part
CHARS = 32 << 20  # characters of all documents together that the network is fitted on
COMMON = 4  # training documents that must hold a word before it has a view of its own
EPOCHS, STEPS, BATCH, RATE = 10, 600, 64, 0.01  # passes over the sample, more where they make fewer than STEPS updates
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def window_starts(n: int) -> list[int]:
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STEP), n - WINDOW]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, first trigram and trigram buckets per word."""
    crc = zlib.crc32
    raw = [f"^{w}$".encode("utf-8", "surrogatepass") for w in words]
    buckets = np.array([crc(w) % WORD_BUCKETS for w in raw], np.int64)
    grams = [[crc(w[i : i + 3]) for i in range(max(1, len(w) - 2))] for w in raw]
    starts = np.concatenate(([0], np.cumsum([len(g) for g in grams])))[:-1].astype(np.int64)
    return buckets, starts, np.array([g for x in grams for g in x], np.int64) % GRAM_BUCKETS


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters are float32 arrays; leading axis 2 = forward, backward."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "word": draw(WORD_BUCKETS, DIM, scale=0.1), "gram": draw(GRAM_BUCKETS, DIM, scale=0.1),
            "w": draw(2, 2 * DIM, 3 * HIDDEN, scale=(2 * DIM) ** -0.5), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "u": draw(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "a": draw(2 * HIDDEN, POOL, scale=(2 * HIDDEN) ** -0.5), "v": draw(POOL, scale=POOL**-0.5),
            "o": draw(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), "c": np.zeros(1, np.float32),
        }
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, buckets, starts, grams) -> tuple[np.ndarray, np.ndarray]:
        """Word views (n, 2 DIM) and trigram counts per word."""
        count = np.diff(np.append(starts, len(grams)))
        mean = np.add.reduceat(self.p["gram"][grams], starts, axis=0) / count[:, None]
        return np.concatenate((self.p["word"][buckets], mean), axis=1).astype(np.float32), count

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input part of all gates (2, n, 3 HIDDEN)."""
        return np.matmul(x[None], self.p["w"]) + self.p["b"]

    def states(self, table: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Hidden states (T, B, 2 HIDDEN); row 0 of ``table`` is padding."""
        n, width = ids.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((width, n, 2 * HIDDEN), np.float32)
        u, kept = self.p["u"], []
        for t in range(width):
            g = np.stack((table[0][ids[:, t]], table[1][ids[:, width - 1 - t]]))
            q = np.matmul(h, u)
            zr = 1.0 / (1.0 + np.exp(-(g[..., : 2 * HIDDEN] + q[..., : 2 * HIDDEN])))
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            new = np.tanh(g[..., 2 * HIDDEN :] + r * q[..., 2 * HIDDEN :])
            if keep:
                kept.append((h, z, r, new, q[..., 2 * HIDDEN :]))
            h = new + z * (h - new)
            out[t, :, :HIDDEN] = h[0]
            out[width - 1 - t, :, HIDDEN:] = h[1]
        return (out, kept) if keep else out

    def pool(self, out: np.ndarray, mask: np.ndarray):
        """Attention weights, pooled states and logits; ``mask`` is (T, B)."""
        m = np.tanh(out @ self.p["a"])
        e = np.where(mask, m @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        pooled = (out * w[..., None]).sum(axis=0)
        return m, w, pooled, pooled @ self.p["o"] + self.p["c"][0]

    def logits(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.pool(self.states(table, ids), (ids > 0).T)[3]

    def gradient(self, ids: np.ndarray, label: np.ndarray, weight: np.ndarray, feats) -> dict[str, np.ndarray]:
        """Gradient of the weighted mean log loss over windows."""
        p = self.p
        buckets, starts, grams = feats
        x, count = self.inputs(buckets, starts, grams)
        table = np.concatenate((np.zeros((2, 1, 3 * HIDDEN), np.float32), self.gates(x)), axis=1)
        out, kept = self.states(table, ids, keep=True)
        mask = (ids > 0).T
        m, w, pooled, logit = self.pool(out, mask)
        d = ((sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g = {"o": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["o"]
        d_out = w[..., None] * d_pooled
        d_w = (out * d_pooled).sum(axis=2)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["v"] = np.einsum("tbk,tb->k", m, d_e)
        d_m = d_e[..., None] * p["v"] * (1 - m * m)
        g["a"] = np.einsum("tbh,tbk->hk", out, d_m)
        d_out += d_m @ p["a"].T
        width, n = mask.shape
        d_table = np.zeros((width, 2, n, 3 * HIDDEN), np.float32)
        g["u"] = np.zeros_like(p["u"])
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        for t in range(width - 1, -1, -1):
            h, z, r, new, q = kept[t]
            d_h = d_h + np.stack((d_out[t, :, :HIDDEN], d_out[width - 1 - t, :, HIDDEN:]))
            d_new = d_h * (1 - z) * (1 - new * new)
            d_z = d_h * (h - new) * z * (1 - z)
            d_r = d_new * q * r * (1 - r)
            d_table[t] = np.concatenate((d_z, d_r, d_new), axis=2)
            d_q = np.concatenate((d_z, d_r, d_new * r), axis=2)
            g["u"] += np.matmul(h.transpose(0, 2, 1), d_q)
            d_h = d_h * z + np.matmul(d_q, p["u"].transpose(0, 2, 1))
        rows = len(x) + 1
        d_gate = np.zeros((2, rows, 3 * HIDDEN), np.float32)
        for side, order in ((0, ids.T), (1, ids.T[::-1])):
            flat, values = order.ravel(), d_table[:, side].reshape(-1, 3 * HIDDEN)
            d_gate[side] = np.stack([np.bincount(flat, values[:, k], rows) for k in range(3 * HIDDEN)], axis=1)
        d_gate = d_gate[:, 1:]
        g["b"] = d_gate.sum(axis=1, keepdims=True)
        g["w"] = np.matmul(x.T[None], d_gate)
        d_x = np.matmul(d_gate, p["w"].transpose(0, 2, 1)).sum(axis=0)
        g["word"] = np.stack([np.bincount(buckets, d_x[:, k], WORD_BUCKETS) for k in range(DIM)], axis=1)
        spread = np.repeat(d_x[:, DIM:] / count[:, None], count, axis=0)
        g["gram"] = np.stack([np.bincount(grams, spread[:, k], GRAM_BUCKETS) for k in range(DIM)], axis=1)
        return g


class Table:
    """Gate inputs of the words met so far; started anew when full, so bounded."""

    def __init__(self, net: Network, most: int = 200_000):
        self.net, self.most = net, most
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.gates = np.zeros((2, 1, 3 * HIDDEN), np.float32)

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.row) > self.most:
            self.reset()
        get = self.row.get
        out = [[get(w) for w in x] for x in texts]
        new = {w: None for x, r in zip(texts, out) if None in r for w, k in zip(x, r) if k is None}
        if new:
            at = len(self.row) + 1
            self.row.update((w, at + k) for k, w in enumerate(new))
            self.gates = np.concatenate((self.gates, self.net.gates(self.net.inputs(*features(list(new)))[0])), axis=1)
            out = [[get(w) for w in x] if None in r else r for x, r in zip(texts, out)]
        return [np.array(r, np.int32) for r in out]


def windows_of(ids: np.ndarray, starts: list[int]) -> np.ndarray:
    if len(ids) <= WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)))[None]
    return ids[np.array(starts)[:, None] + np.arange(WINDOW)]


def score_texts(net: Network | None, table: Table | None, texts: list[str | None]) -> np.ndarray:
    """Score per text: the highest window; 0 for texts without words or without a network."""
    best = np.full(len(texts), -np.inf)
    if net is not None:
        ids = table.ids([words_of(t) for t in texts])
        owner = [k for k, x in enumerate(ids) for _ in window_starts(len(x))]
        parts = [windows_of(x, window_starts(len(x))) for x in ids if len(x)]
        if parts:
            every = np.concatenate(parts)
            logit = np.concatenate([net.logits(table.gates, every[k : k + 1024]) for k in range(0, len(every), 1024)])
            np.maximum.at(best, np.array(owner), logit)
    return np.where(np.isfinite(best), sigmoid((net.slope if net else 1.0) * np.where(np.isfinite(best), best, 0.0) + (net.shift if net else 0.0)), 0.0)


def fit(sample: Iterable[tuple[int, list[str]]], seed: int = 11) -> Network | None:
    """Fits on all windows of (label, words) per document, held as word numbers; None without both labels."""
    row: dict[str, int] = {}
    texts = [(y, np.array([row.setdefault(w, len(row) + 1) for w in words], np.int32)) for y, words in sample if words]
    if len({y for y, _ in texts}) < 2:
        return None
    net, rng = Network(seed), np.random.default_rng(seed)
    names = list(row)
    buckets, starts, grams = features(names)
    ends = np.append(starts, len(grams))
    own = [windows_of(x, window_starts(len(x))) for _, x in texts]
    windows = np.concatenate(own)
    owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
    del own
    label = np.array([y for y, _ in texts], np.float32)
    spread = np.bincount(np.concatenate([np.unique(x) for _, x in texts]), minlength=len(names) + 1)[1:]
    known = np.zeros(WORD_BUCKETS, bool)
    known[buckets[spread >= COMMON]] = True
    net.p["word"][~known] = 0  # words of few documents are read by their characters alone
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0

    def subset(used: np.ndarray):
        n = ends[used + 1] - ends[used]
        at = np.cumsum(n) - n
        return buckets[used], at, grams[np.repeat(ends[used] - at, n) + np.arange(n.sum())]

    epochs = max(EPOCHS, -(-STEPS * BATCH // (2 * len(label))))
    for epoch in range(epochs):
        if epoch == 0:
            pick = np.arange(len(windows))
            pick = pick[rng.random(len(pick)) < min(1.0, 4 * len(label) / len(pick))]
        else:
            gates = np.concatenate((np.zeros((2, 1, 3 * HIDDEN), np.float32), net.gates(net.inputs(buckets, starts, grams)[0])), axis=1)
            logit = np.concatenate([net.logits(gates, windows[k : k + 1024]) for k in range(0, len(windows), 1024)])
            order = np.lexsort((-logit, owner))
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            pick = order[rank < np.where(label[owner[order]] == 1, 1, 2)]
        rng.shuffle(pick)
        for k in range(0, len(pick), BATCH):
            chosen = pick[k : k + BATCH]
            used, ids = np.unique(windows[chosen], return_inverse=True)
            ids = ids.reshape(len(chosen), WINDOW)
            if used[0] == 0:
                used = used[1:]
            else:
                ids = ids + 1
            y = label[owner[chosen]]
            g = net.gradient(ids, y, np.ones(len(chosen)), subset(used - 1))
            g["word"][~known] = 0
            step += 1
            rate = RATE * min(1.0, step / 20) * (1 - 0.9 * epoch / epochs)
            for name, value in g.items():
                first[name] += 0.1 * (value - first[name])
                second[name] += 0.001 * (value * value - second[name])
                net.p[name] -= (rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    gates = np.concatenate((np.zeros((2, 1, 3 * HIDDEN), np.float32), net.gates(net.inputs(buckets, starts, grams)[0])), axis=1)
    best = np.full(len(label), -np.inf)
    np.maximum.at(best, owner, np.concatenate([net.logits(gates, windows[k : k + 1024]) for k in range(0, len(windows), 1024)]))
    net.slope, net.shift = _scale(best, label)
    return net


def _scale(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of document labels on highest logits, kept soft by a prior."""
    a, b = 1.0, 0.0
    up, down = (label.sum() + 1) / (label.sum() + 2), 1 / (len(label) - label.sum() + 2)
    y = np.where(label == 1, up, down)
    x = np.clip(logit, -20, 20)
    for _ in range(200):
        q = sigmoid(a * x + b)
        h = q * (1 - q) + 1e-6
        ga, gb = ((q - y) * x).sum() + 0.01 * (a - 1), (q - y).sum() + 0.01 * b
        haa, hab, hbb = (h * x * x).sum() + 0.01, (h * x).sum(), h.sum() + 0.01
        det = haa * hbb - hab * hab
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    return max(float(a), 0.05), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Fits on at most ``sample`` labelled documents per class outside the held-out
    fold (crc32 mod 3 = 1), in the order of a hash of the id, until they hold
    CHARS characters; documents of more than LONGEST characters are not chosen.
    Every window of a chosen document takes part.  One task fits on these bounded
    rows, so a lost executor fits again; the driver receives the parameters only."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [" ".join(words_of(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k_id"), b.column("label"), pa.array(found, pa.string())], ["k_id", "label", "words"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = fit((y.as_py(), w.as_py().split()) for b in batches for y, w in zip(b.column("label"), b.column("words")))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    chosen = labelled_sample(docs, labels, "toxic", fold_of(F.col("k_id"), 3) != 1, sample)
    rows = chosen.where(F.length("text") <= LONGEST).mapInArrow(cut, "k_id long, label int, words string")
    held = F.sum(F.length("words")).over(Window.orderBy(F.xxhash64("k_id"), "k_id"))
    row = rows.withColumn("held", held).where(F.col("held") <= CHARS).select("label", "words").mapInArrow(learn, "net binary").first()
    return pickle.loads(row["net"]) if row else None


def with_scores(docs: DataFrame, net: Network | None, text: str = "text", score: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``score``; all columns pass through; no shuffle.
    A null text or one without words scores 0."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        table = Table(net) if net else None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = score_texts(net, table, inner(part, k).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(got, pa.float64())], ["row", "score"])

    packed, k = passing(docs, text)
    out = packed.mapInArrow(run, row_and(packed, "score double"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != score], F.col("score").alias(score))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts score 0; repeated rows score alike; without labels of
    both classes every score is 0; an empty table gives an empty result; only
    the text is an input of a score."""
    net = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    scored = with_scores(packed, net, score="score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
