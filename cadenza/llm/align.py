"""Alignment of two tokenizers over the same bytes.

Every token has an end, its offset in the bytes of the text.  Where both
tokenizers end a token, the text is cut into groups.  Most groups hold one
token on either side, so at a fixed shift between the two indexes the end
arrays agree over stretches: probes of doubling length jump these, and probes
of halving length find where the agreement ends.  The group there is resolved
locally, token by token, which also gives its overlapping pairs and the new
shift.

Counts of token pairs are corpus-wide.  Documents are worked off in blocks of
bounded bytes; a block stores its distinct pairs once and per link a place in
that list, so the join with the counts meets a pair once per block (never once
per occurrence), and no pair is a hot key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.session import materialise

BLOCK = 1 << 21  # bytes of text per block; a longer text is a block of its own
PIECE = 1 << 18  # bytes handed to a tokenizer at once
SHIFT = 32  # a pair is the number A id * 2^32 + B id


def irregular(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int, int, int]], list[int], list[int]]:
    """``a``, ``b``: rising ends, the last ones equal.  Returns the groups that
    are not one token to one, as (from, to, from, to) indexes, and the pairs of
    overlapping tokens inside them, as two lists of indexes."""
    groups, left, right = [], [], []
    x, y, n = a.tolist(), b.tolist(), len(a)
    i = shift = 0
    while i < n:
        step = 1
        while i < n and x[i : i + step] == y[i + shift : i + shift + step]:
            i += step
            step *= 2
        while i < n and step > 1:
            step //= 2
            if x[i : i + step] == y[i + shift : i + shift + step]:
                i += step
        if i >= n:
            break
        i0, j0 = i, i + shift
        j, p, q = j0, x[i], y[j0]
        while True:
            left.append(i)
            right.append(j)
            if p < q:
                i += 1
                p = x[i]
            elif q < p:
                j += 1
                q = y[j]
            else:
                break
        i += 1
        shift = j + 1 - i
        groups.append((i0, i, j0, j + 1))
    return groups, left, right


class Vocabulary:
    """Bytes of every id, laid end to end."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        stop = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)].tobytes()


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable
    Latin-1 signs stand for themselves, the other bytes for U+0100 and on in their order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Library:
    """``encode``: ids of each text by the library that reads the file; ``spelling``: bytes of the ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], spelled: list[bytes]):
        self.encode, self.spelling = encode, Vocabulary(spelled)


class ByteLevel:
    """Ids of a byte-level ``.json`` file.  Where its merges stand in the order
    of the ids, tiktoken gives the same ids several times faster than
    tokenizers, as long as both sort the signs of a text alike: every sign is
    put to both once, and texts with a sign on which they differ go to tokenizers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow, signs = Tokenizer.from_file(path), _byte_signs()
        self.slow.encode_special_tokens = True
        names = {k: s for s, k in self.slow.get_vocab(with_added_tokens=True).items()}
        self.spelled = [bytes(signs[c] for c in names[k]) if k in names else b"" for k in range(max(names) + 1)]
        self.fast = self._ranked(path)
        self.alike: set[str] = set()
        self.odd: set[str] = set()

    def _ranked(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        vocab, added = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        ranks = {self.spelled[k]: k for t, k in vocab.items() if t not in added}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]

    def _sorted_out(self, new: set[str]) -> None:
        probes = [f"a{c}1{c}.{c} {c}a {c}{c}\n{c}" for c in new]
        for c, p, ids in zip(new, probes, self._slow(probes)):
            (self.alike if self.fast.encode_ordinary(p) == ids else self.odd).add(c)

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + x for x in texts]
        if self.fast is None:
            return self._slow(texts)
        met = set().union(*texts)
        if new := met - self.alike - self.odd:
            self._sorted_out(new)
        if not met & self.odd:
            return [self.fast.encode_ordinary(x) for x in texts]
        return [self.fast.encode_ordinary(x) if self.odd.isdisjoint(x) else self._slow([x])[0] for x in texts]


@lru_cache(maxsize=4)
def load(path: str) -> Library:
    """A byte-level ``.json`` file, or a ``.model`` file, which is read by
    sentencepiece; that puts the space before the text by itself."""
    if path.endswith(".json"):
        t = ByteLevel(path)
        return Library(t.encode, t.spelled)
    from sentencepiece import SentencePieceProcessor

    s = SentencePieceProcessor(model_file=path)
    piece = lambda k: bytes([int(s.id_to_piece(k)[3:5], 16)]) if s.is_byte(k) else s.id_to_piece(k).replace("▁", " ").encode()
    return Library(lambda texts: s.encode(texts, num_threads=1), [piece(k) for k in range(s.get_piece_size())])


def _encoded(lib: Library, texts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids end to end, their number per text, and whether they spell the text."""
    ids, count = [], []
    at = 0
    while at < len(texts):
        to, size = at + 1, len(raw[at])
        while to < len(texts) and size + len(raw[to]) <= PIECE:
            size += len(raw[to])
            to += 1
        lists = lib.encode(texts[at:to])
        count += [len(x) for x in lists]
        ids.append(np.concatenate([np.asarray(x, np.int32) for x in lists]))
        at = to
    flat, count = np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(count, np.int64)
    spelled, size = lib.spelling.spell(flat), lib.spelling.size[flat]
    upto = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))].tolist()
    return flat, count, np.array([spelled[u:v] == r for u, v, r in zip(upto, upto[1:], raw)], bool)


def _kept(flat: np.ndarray, count: np.ndarray, ok: np.ndarray) -> np.ndarray:
    return flat if ok.all() else flat[np.repeat(ok, count)]


class _Digits:
    """Decimal spelling of ids, each with a place for one sign behind it."""

    def __init__(self, most: int):
        width = len(str(most))
        self.text = np.zeros((most + 1, width + 1), np.uint8)
        self.size = np.char.str_len(np.arange(most + 1).astype(str))
        spelled = np.frombuffer(np.char.ljust(np.arange(most + 1).astype(f"S{width}"), width).tobytes(), np.uint8).reshape(most + 1, width)
        self.text[:, :width] = spelled
        self.shown = np.arange(width + 1) <= self.size[:, None]

    def join(self, ids: np.ndarray, signs: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All ids, each followed by its sign, and where each of them ends."""
        cells = self.text[ids]
        size = self.size[ids]
        cells[np.arange(len(ids)), size] = signs
        return cells[self.shown[ids]].tobytes(), np.cumsum(size + 1)


@lru_cache(maxsize=1)
def _digits(most: int) -> _Digits:
    return _Digits(most)


class Aligned:
    """Groups and links of the texts of a block."""

    def __init__(self, a: Library, b: Library, texts: list[str | None]):
        some = [k for k, t in enumerate(texts) if t]
        full = [texts[k] for k in some]
        raw = [b" " + t.encode() for t in full]
        (ids_a, n_a, ok_a), (ids_b, n_b, ok_b) = (_encoded(lib, full, raw) for lib in (a, b))
        ok = ok_a & ok_b
        self.ids_a, self.ids_b = _kept(ids_a, n_a, ok), _kept(ids_b, n_b, ok)
        self.rows = len(texts)
        self.place = np.array(some, np.int64)[ok]  # the row of each text that has tokens
        self.n_a, self.n_b = n_a[ok], n_b[ok]
        ends_a, ends_b = (np.cumsum(lib.spelling.size[ids]) for lib, ids in ((a, self.ids_a), (b, self.ids_b)))
        groups, left, right = irregular(ends_a, ends_b)
        g = np.array(groups, np.int64).reshape(-1, 4)
        self.last_a, single_a = self._flags(len(ends_a), g[:, 0], g[:, 1])
        self.last_b, single_b = self._flags(len(ends_b), g[:, 2], g[:, 3])
        self.link_a = np.concatenate([np.flatnonzero(single_a), np.array(left, np.int64)])
        self.link_b = np.concatenate([np.flatnonzero(single_b), np.array(right, np.int64)])
        self.text_a = np.repeat(np.arange(len(self.n_a)), self.n_a)  # the text of each A token
        self.most = max(len(a.spelling.size), len(b.spelling.size))

    @staticmethod
    def _flags(n: int, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that end a group, and tokens that are alone on their side of a one-to-one group."""
        change = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(stop, minlength=n + 1)[: n + 1]
        inside = np.cumsum(change)[:n] > 0
        last = ~inside
        last[stop - 1] = True
        return last, ~inside

    def per_row(self, of_text: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows, np.int64)
        out[self.place] = of_text
        return out

    def counts(self) -> tuple[np.ndarray, ...]:
        """n_a, n_b, n_groups and n_links per row."""
        n = len(self.n_a)
        groups = np.bincount(self.text_a, self.last_a, n).astype(np.int64)
        return tuple(map(self.per_row, (self.n_a, self.n_b, groups, np.bincount(self.text_a[self.link_a], minlength=n))))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, how often each is linked, and per link, in the order of the rows, the place of its pair."""
        order = np.argsort(self.text_a[self.link_a], kind="stable")
        keys = (self.ids_a[self.link_a[order]].astype(np.int64) << SHIFT) + self.ids_b[self.link_b[order]]
        pairs, place, times = np.unique(keys, return_inverse=True, return_counts=True)
        return pairs, times, place.astype(np.int32)

    def groups(self) -> list[bytes]:
        """Per row the groups as ``a1,a2|b1;a3|b2,b3``, without tokens empty."""
        out = [b""] * self.rows
        group_a = np.cumsum(self.last_a) - self.last_a
        group_b = np.cumsum(self.last_b) - self.last_b
        upto_a = np.append(0, np.flatnonzero(self.last_a) + 1)
        upto_b = np.append(0, np.flatnonzero(self.last_b) + 1)
        at_a = np.arange(len(self.ids_a)) + upto_b[group_a]
        at_b = np.arange(len(self.ids_b)) + upto_a[group_b + 1]
        ids, signs = np.zeros(len(at_a) + len(at_b), np.int64), np.zeros(len(at_a) + len(at_b), np.uint8)
        ids[at_a], ids[at_b] = self.ids_a, self.ids_b
        signs[at_a], signs[at_b] = np.where(self.last_a, ord("|"), ord(",")), np.where(self.last_b, ord(";"), ord(","))
        text, stop = _digits(self.most).join(ids, signs)
        cut = np.append(0, stop)[np.append(0, np.cumsum(self.n_a + self.n_b))].tolist()
        for row, u, v in zip(self.place.tolist(), cut, cut[1:]):
            out[row] = text[u : v - 1]
        return out


BLOCK_SCHEMA = (
    "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "shapes array<string>, pairs array<long>, times array<long>, places binary"
)


def blocks(docs: DataFrame, a: str, b: str, shape: Callable[[bytes], str], doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """One row per block of documents with what alignment found, written to the shared folder."""

    def lists(columns: list) -> list[pa.Array]:
        return [pa.array([c], kind) for c, kind in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib_a, lib_b = load(a), load(b)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            size = [t or 0 for t in pa.compute.binary_length(batch.column("text")).to_pylist()]
            at = 0
            while at < batch.num_rows:
                to, total = at + 1, size[at]
                while to < batch.num_rows and total + size[to] <= block_bytes:
                    total += size[to]
                    to += 1
                part = batch.slice(at, to - at)
                found = Aligned(lib_a, lib_b, part.column("text").to_pylist())
                pairs, times, places = found.links()
                ints = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), pa.array([part.column("id").to_pylist()], ints), *lists([(c, ints) for c in found.counts()]),
                        *lists([([shape(g) for g in found.groups()], pa.list_(pa.string())), (pairs, ints), (times, ints)]),
                        pa.array([pa.compress(places.tobytes(), "zstd", asbytes=True)], pa.binary()),
                    ],
                    ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "shapes", "pairs", "times", "places"],
                )
                number += 1
                at = to

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, BLOCK_SCHEMA))


def _uses(aligned: DataFrame) -> DataFrame:
    """(block, place, pair, n): how often a block links a pair."""
    zipped = F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "use")
    return aligned.select("block", zipped).select("block", "place", F.col("use.pairs").alias("pair"), F.col("use.times").alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Corpus-wide links of every pair of ids: pair, a_id, b_id, total, best
    (no pair of this B id has more).  The table of best counts has at most one
    row per id of the second vocabulary, so it is broadcast."""
    totals = materialise(_uses(aligned).groupBy("pair").agg(F.sum("n").alias("total")))
    totals = totals.select("pair", F.shiftright("pair", SHIFT).alias("a_id"), F.expr(f"pair & {(1 << SHIFT) - 1}").alias("b_id"), "total")
    top = totals.groupBy("b_id").agg(F.max("total").alias("top"))
    return totals.join(F.broadcast(top), "b_id").select("pair", "a_id", "b_id", "total", (F.col("total") == F.col("top")).alias("best"))


def alignments(docs: DataFrame, a: str, b: str, shape: Callable[[bytes], str] = bytes.decode, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum and groups (the text ``a1,a2|b1;...``, or what ``shape`` makes of it).

    ``a`` and ``b``: paths of the vocabulary files on the executors.  A null or
    empty text, and one that a tokenizer does not give back byte by byte, has
    no tokens: zeros and an empty text of groups.  Repeated rows and null ids
    stay; other columns are not passed on; an empty table gives an empty
    result.  Groups of the last step are blocks, whose size is bounded."""
    aligned = blocks(docs, a, b, shape, doc_id, text, block_bytes)
    known = materialise(pair_counts(aligned).select("pair", "total", "best"))
    looked = _uses(aligned).join(known, "pair").select(F.col("block").alias("of_block"), "place", "total", F.col("best").cast("long").alias("best"))
    ints = ["ids", "n_a", "n_b", "n_groups", "n_links"]

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        row = {c: block.column(c).combine_chunks().flatten() for c in [*ints, "shapes"]}
        total, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        at = found.column("place").to_numpy()
        total[at], best[at] = found.column("total").to_numpy(), found.column("best").to_numpy()
        n = row["n_links"].to_numpy()
        size = int(n.sum())
        places = np.frombuffer(pa.decompress(block.column("places")[0].as_py(), 4 * size, "zstd", asbytes=True), np.int32)
        stop = np.cumsum(n)
        sums = [np.diff(np.concatenate(([0], np.cumsum(v[places])))[np.concatenate(([0], stop))]) for v in (best, total)]
        return pa.table([*[row[c] for c in ints], *map(pa.array, sums), row["shapes"]], ["doc_id", *ints[1:], "n_best", "count_sum", "groups"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    kept = aligned.select("block", *ints, "shapes", "places")
    return kept.groupBy("block").cogroup(looked.groupBy("of_block")).applyInArrow(finish, schema)
