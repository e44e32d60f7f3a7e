"""Exact top-k inner products by MaxScore over sharded inverted lists.

Every dimension and sign is a term, every vector a document that holds the
terms of its components, and a query asks for the terms whose sign agrees with
its own: only those add to a score, all others take away.  Vectors are dealt to
shards, shards to blocks of rows; a term's postings in a block are rows and
sizes.  Per query, terms are sorted by their bound (query weight times largest
size in the shard); the longest run of the smallest bounds that cannot reach
the k-th best score so far is non-essential.  Essential postings are traversed;
rows that could still get there are probed in the other terms, largest bound
first, and dropped as soon as they cannot; what survives gets its negative part
and so its exact score.  The best of all shards are merged per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.session import materialise

SHARD, BLOCK = 8192, 1024
QUERIES = 4096  # queries that meet a shard in one task


class Shard:
    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.copies, self.x = ids[order], copies[order], x[order]
        self.width = x.shape[1]
        size = np.concatenate((np.maximum(self.x, 0), np.maximum(-self.x, 0)), axis=1)  # term d, and d + width for negative
        self.most = size.max(axis=0)
        self.blocks = []
        for at in range(0, len(ids), BLOCK):
            part = size[at : at + BLOCK]
            lists = []
            for t in range(2 * self.width):
                rows = np.flatnonzero(part[:, t])
                lists.append((rows, part[rows, t].astype(float)))
            self.blocks.append((at, len(part), lists))
        self.size = size

    def place(self, own: int, copy: int, q: np.ndarray) -> int:
        """Where the row of this id, vector and copy number is, or -1."""
        lo, hi = np.searchsorted(self.ids, own, side="left"), np.searchsorted(self.ids, own, side="right")
        same = np.flatnonzero((self.copies[lo:hi] == copy) & (self.x[lo:hi] == q).all(axis=1))
        return int(lo + same[0]) if len(same) else -1

    def top(self, own: int, copy: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows other than the query's own, ties to the smaller id."""
        mine = self.place(own, copy, q)
        dims = np.flatnonzero(q)
        terms = np.where(q[dims] > 0, dims, dims + self.width)
        weight = np.abs(q[dims])
        bound = weight * self.most[terms]
        order = np.argsort(bound, kind="stable")
        terms, weight, bound = terms[order], weight[order], bound[order]
        below = np.cumsum(bound)
        best: list[tuple[int, int]] = []  # (-score, id)
        for at, n, lists in self.blocks:
            full = len(best) == k
            least = -best[-1][0] if full else None
            if full and least > 0:
                cut = int(np.searchsorted(below, least, side="left"))  # terms before it sum to less than the k-th best
                essential = [lists[t] for t in terms[cut:]]
                if not essential:
                    continue
                rows = np.concatenate([r for r, _ in essential])
                adds = np.concatenate([x * w for (_, x), w in zip(essential, weight[cut:])])
                partial = np.bincount(rows, adds, n)
                rest = float(below[cut - 1]) if cut else 0.0
                alive = np.flatnonzero((partial > 0) & (partial + rest >= least))
                partial = partial[alive]
                for j in range(cut - 1, -1, -1):
                    if not len(alive):
                        break
                    partial = partial + self.size[at + alive, terms[j]] * weight[j]
                    stay = partial + (float(below[j - 1]) if j else 0.0) >= least
                    alive, partial = alive[stay], partial[stay]
            else:
                alive = np.arange(n)
            if not len(alive):
                continue
            score = self.x[at + alive] @ q
            found = [(-s, i) for s, i, p in zip(score.tolist(), self.ids[at + alive].tolist(), (at + alive).tolist()) if p != mine and (not full or s >= least)]
            best = sorted(best + found)[:k]
        return [(i, -s) for s, i in best]


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, q, copy): floor(scale * component) of every whole finite vector;
    rows equal in both are told apart by a copy number; null ids take no part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(~bad)
    rows = rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("q"))
    counted = rows.groupBy("vec_id", "q").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("vec_id", "q", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))


def _pack(df: pd.DataFrame) -> tuple[bytes, bytes, bytes, int]:
    width = max(map(len, df["q"]))
    x = np.zeros((len(df), width), np.int64)
    for k, v in enumerate(df["q"]):
        x[k, : len(v)] = v
    return df["vec_id"].to_numpy(np.int64).tobytes(), df["copy"].to_numpy(np.int64).tobytes(), x.tobytes(), width


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.copies, np.int64), np.frombuffer(row.x, np.int64).reshape(len(ids), row.width)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank (from 1),
    vec_id, score of its k best other rows (all, if fewer), ties to the smaller
    vec_id.

    Vectors that are null or hold null or non-finite components, and null ids,
    take no part; rows that repeat an id are queries and candidates of their
    own; vectors of unequal length
    are padded with zeros; an empty table gives an empty result; other columns
    are not read.  A task holds one shard of SHARD vectors and QUERIES queries
    at most, whatever the sizes of the tables."""
    rows = materialise(quantised(vectors, vec_id, embedding))
    n = rows.count()
    asked = rows.where(F.col("vec_id") % every == 0)
    n_asked = asked.count()
    shards, groups = max(1, math.ceil(n / SHARD)), max(1, math.ceil(n_asked / QUERIES))

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        ids, copies, x, width = _pack(df)
        return pd.DataFrame({"part": [int(df["part"].iloc[0])], "ids": [ids], "copies": [copies], "x": [x], "width": [width]})

    packed = "part long, ids binary, copies binary, x binary, width long"
    held = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "q", "copy"), F.lit(shards))).groupBy("part").applyInPandas(pack, packed)
    held = materialise(held).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    ask = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "q", "copy", F.lit(1)), F.lit(groups))).groupBy("part").applyInPandas(pack, packed)
    ask = materialise(ask).withColumnRenamed("part", "group").withColumn("group", F.col("group").cast("int"))
    ask = ask.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("part", F.col("part").cast("long"))

    def meet(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(queries):
            ids, copies, x = _unpack(shard.iloc[0])
            own, copy, q = _unpack(queries.iloc[0])
            group = int(queries["group"].iloc[0])
            width = max(x.shape[1], q.shape[1])
            s = Shard(ids, copies, np.pad(x, ((0, 0), (0, width - x.shape[1]))))
            for n, (i, c, v) in enumerate(zip(own.tolist(), copy.tolist(), np.pad(q, ((0, 0), (0, width - q.shape[1]))))):
                out += [(group, n, i, j, score) for j, score in s.top(i, c, v, k)]
        return pd.DataFrame(out, columns=["group", "place", "query_id", "vec_id", "score"]).astype("int64")

    met = held.groupBy("part", "group").cogroup(ask.groupBy("part", "group")).applyInPandas(meet, "group long, place long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("group", "place").orderBy(F.col("score").desc(), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
