"""SentencePiece encoding and decoding with a merge (BPE) vocabulary.

Encoding is a streaming Viterbi over the lattice of pieces.  With this model
kind a path is not scored by a sum: of all paths to a position exactly one
survives, the one whose neighbouring pieces stay apart under the merges
(``lattice``).  Backpointers are kept for a window of the longest piece, and
ids are committed whenever the surviving paths meet in one boundary.  Where no
piece spans a boundary (before a space mark, between letters and other signs;
checked against the vocabulary) the paths are known to meet, so the window is
committed there at the latest.  What stands between two such boundaries is a
fragment: the ids that the window committed for it are kept and used again, in
a memo of bounded size.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cadenza.llm.common import inner, passing, row_and, whole_row
from cadenza.llm.lattice import Lattice, Recent, Stream

MARK = "▁"
SHORT = 48  # fragments up to this length are kept
SMALL = 256  # rows worked off at a time


class Spelling:
    """Bytes of every id.  ``vocabulary``: (piece, score, kind) per id with kind
    normal, byte, control or unknown."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        spell = {"byte": lambda p: bytes([int(p[3:5], 16)]), "normal": lambda p: p.replace(MARK, " ").encode(), "control": lambda p: b"", "unknown": lambda p: " \u2047 ".encode()}
        raw = [spell[kind](p) for p, _, kind in vocabulary]
        self.size = np.array([len(b) for b in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of rows of ids laid end to end; ``ends`` has one end more than rows, from 0."""
        size = self.size[ids]
        stop = np.concatenate(([0], np.cumsum(size)))
        raw = self.flat[np.repeat(self.start[ids] - stop[:-1], size) + np.arange(stop[-1])].tobytes()
        cuts = stop[ends].tolist()
        # the mark that encoding put in front is taken off again
        return [raw[a + 1 if raw[a : a + 1] == b" " else a : b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0]


class Pieces:
    """Encoder over the same vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float, str]], memo: int = 600_000):
        ids = {p: k for k, (p, _, kind) in enumerate(vocabulary) if kind == "normal"}
        score = {p: -s for p, s, kind in vocabulary if kind == "normal"}
        self.byte = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        self.unknown = next((k for k, v in enumerate(vocabulary) if v[2] == "unknown"), 0)
        self.lattice = Lattice(ids, lambda a, b: score.get(a + b), list, memo)
        self.raw_of = [b"", *(array("i", [k]).tobytes() for k in ids.values())]
        self.kept = Recent(self._stream, memo)
        self.commits = 0
        mixed = self._mixed(ids)
        self.fragment = re.compile(rf"{MARK}*[^\W\d_{mixed}]+|{MARK}*(?:[^\w{MARK}]|[\d_{mixed}])+|{MARK}+")
        whole = re.compile(rf"{MARK}*(?:[^\W\d_{mixed}]+|(?:[^\w{MARK}]|[\d_{mixed}])+)?")
        assert all(whole.fullmatch(p) for p in ids), "a piece spans two fragments"

    @staticmethod
    def _mixed(pieces) -> str:
        """Letters that some piece joins to other signs; they are cut like signs."""
        letter = re.compile(r"[^\W\d_]")
        out: set[str] = set()
        while True:
            sign = lambda c: c in out or not letter.match(c)
            more = {c for p in pieces for q in [p.lstrip(MARK)] if any(map(sign, q)) for c in q if not sign(c)}
            if not more:
                return re.escape("".join(sorted(out)))
            out |= more

    def _ids(self, text: str, numbers: list[int]) -> bytes:
        raw_of = self.raw_of
        if 0 not in numbers:
            return b"".join([raw_of[k] for k in numbers])
        raw: list[bytes] = []
        for k, t in zip(numbers, self.lattice.spelled(text, numbers)):
            if k:
                raw.append(raw_of[k])
            elif self.byte:
                raw.append(array("i", [self.byte[b] for b in t.encode("utf-8", "surrogatepass")]).tobytes())
            else:
                raw.append(array("i", [self.unknown]).tobytes())
        return b"".join(raw)

    def _stream(self, fragment: str) -> bytes:
        """Ids of a fragment as the window commits them."""
        one = self.lattice.whole(fragment)
        if one:
            self.commits += 1
            return self.raw_of[one]
        stream = Stream(self.lattice)
        numbers = [*stream.feed(fragment), *stream.finish()]
        self.commits += stream.commits
        return self._ids(fragment, numbers)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        fragments = self.fragment.findall(MARK + text.replace(" ", MARK))
        if max(map(len, fragments)) <= SHORT:
            return np.frombuffer(b"".join(map(self.kept.__getitem__, fragments)), np.int32)
        return np.frombuffer(b"".join(self.kept[f] if len(f) <= SHORT else self._stream(f) for f in fragments), np.int32)


def read_vocabulary(path: str) -> list[tuple[str, float, str]]:
    """Pieces of a model file; the library only parses the file."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    kind = lambda k: "byte" if p.is_byte(k) else "control" if p.is_control(k) else "unknown" if p.is_unknown(k) else "normal"
    return [(p.id_to_piece(k), p.get_score(k), kind(k)) for k in range(p.get_piece_size())]


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(read_vocabulary(path))


@lru_cache(maxsize=2)
def load_spelling(path: str) -> Spelling:
    return Spelling(read_vocabulary(path))


def _unpacked(out: DataFrame, names: list[str], *more: str) -> DataFrame:
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names if c not in more], *more)


def _encoded(p: Pieces, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts end to end, and where each text ends, from 0."""
    ids = [p.encode(t or "") for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), ends


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with the columns ids (array of int) and n_ids.

    A null or empty text has no ids; repeated rows stay; an empty table gives
    an empty result; other columns pass through, but one that is called ids or
    n_ids is replaced.  ``model`` is the path of the model file on the
    executors.  No shuffle."""
    return _coded(docs, model, text, None)


def encode_and_decode(docs: DataFrame, model: str, text: str = "text", into: str = "decoded") -> DataFrame:
    """``encode`` and, in the same worker, the column ``into``: the text that
    is read back from the ids.  ``into`` may be the text itself; a null text
    is read back as empty."""
    return _coded(docs, model, text, into)


def _coded(docs: DataFrame, model: str, text: str, into: str | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, back = load_pieces(model), load_spelling(model) if into else None
        for b in batches:
            for at in range(0, b.num_rows, SMALL):
                part = b.slice(at, SMALL)
                ids, ends = _encoded(p, inner(part, k).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                if not into:
                    yield pa.RecordBatch.from_arrays([part.column("row"), lists], ["row", "ids"])
                    continue
                texts = pa.array(back.decode_all(ids.astype(np.int64), ends), pa.string())
                fields = [c for c in part.column("row").type]
                kept = [(c.name, inner(part, j)) for j, c in enumerate(fields) if not (j == k and into == text)]
                row = pa.StructArray.from_arrays([v for _, v in kept], [n for n, _ in kept]) if kept else pa.nulls(part.num_rows, pa.struct([]))
                yield pa.RecordBatch.from_arrays([row, lists, texts], ["row", "ids", "out"])

    rows, k = passing(docs, text)
    names = [c for c in docs.columns if c not in ("ids", "n_ids", into)]
    more = "ids array<int>" + (", out string" if into else "")
    schema = row_and(rows, more)
    if into == text:
        schema = StructType([StructField("row", StructType([f for f in rows.schema["row"].dataType if f.name != text])), *schema.fields[1:]])
    out = rows.mapInArrow(run, schema).withColumn("n_ids", F.size("ids").cast("long"))
    own = [F.col("out").alias(c) if c == into else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c == into or c in names]
    return out.select(*own, *([F.col("out").alias(into)] if into and into not in docs.columns else []), "ids", "n_ids")


def decode(encoded: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``into``: the text that the ids stand for.
    Bytes that are not UTF-8 become U+FFFD; a literal U+2581 of a text comes
    back as a space; null ids give a null text; repeated rows stay; an empty
    table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load_spelling(model)
        for b in batches:
            for at in range(0, b.num_rows, SMALL):
                part = b.slice(at, SMALL)
                lists = inner(part, k)
                ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
                texts = p.decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends)
                out = pa.array([t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), out], ["row", "out"])

    rows, k = encoded.select(whole_row(encoded)), encoded.columns.index(ids)
    out = rows.mapInArrow(run, row_and(rows, "out string")).withColumnRenamed("out", into)
    return _unpacked(out, encoded.columns, into)
