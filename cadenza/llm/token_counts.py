"""Token counts by a compiled transducer instead of a tokenizer call.

Two transducers run in series.  The outer one reads normalised text and cuts
pre-tokens (contractions, letter runs, single digits, other runs); white space
always returns it to its start state.  The inner one reads a pre-token and is
determinised as the data visits it: its state is the row of last tokens that a
longest token can still reach (``lattice``), a transition carries the change in
the number of emitted tokens, and the whole path from the start over one
pre-token back to the start is kept as one compiled transition annotated with
its count.

A chunk of text is a map from entry state to (exit state, count).  White space
resets both transducers, so a map is written as (head, count, tail): the run up
to the first white space waits for what stood before the chunk, the run after
the last one waits for what follows.  Maps compose associatively, and a
parallel prefix scan (pairwise rounds) gives the count before every chunk.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.lattice import Bounded, Lattice, Stream

END = "\n"  # stands for the vocabulary's end-of-word mark
CHUNK = 1 << 16
# White space and the pre-token pattern of the vocabulary file.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
WIDE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
# The same for texts below U+0250 without control characters, where the number signs are known.
SIGNS = "\xb2\xb3\xb9\xbc\xbd\xbe"
NARROW = re.compile(rf"'(?:[stmd]|re|ve|ll)|[^\W\d_{SIGNS}]+|[\d{SIGNS}]|(?:[^\w{SPACE}]|_)+")
ODD = re.compile(r"[^\x00-\x1b\x20-ɏ]")
GAP = re.compile(rf"[{SPACE}]")


def _byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies use for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Transducer:
    def __init__(self, path: str, memo: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark = model["end_of_word_suffix"]
        own = lambda t: t[: -len(mark)] + END if t.endswith(mark) else t
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        ranks = {(own(a), own(b)): k for k, (a, b) in enumerate(pairs)}
        self.signs = _byte_signs()
        self.lattice = Lattice(map(own, model["vocab"]), lambda a, b: ranks.get((a, b)), self._symbols, memo)
        added = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(added)) if added else None
        self.count = Bounded(self._count, memo)

    @staticmethod
    def _symbols(text: str) -> list[str]:
        out = list(text)
        if out[-1] == END and len(out) > 1:
            out[-2:] = [out[-2] + END]
        return out

    def _count(self, word: str) -> int:
        """Runs the inner transducer over one pre-token: its count when the word ends there."""
        text = "".join([self.signs[b] for b in word.encode("utf-8", "surrogatepass")])
        lattice = self.lattice
        if lattice.whole(text + END):
            return 1
        emitted, held, ends, state = 0, text, [0], 0
        if len(text) > 8 * lattice.longest:  # a long run: committed tokens are only counted
            stream = Stream(lattice)
            emitted = sum(1 for _ in stream.feed(text[:-1]))
            held, ends, state = stream.text + text[-1], stream.ends, stream.state
        else:
            state = lattice.grow(held, ends, len(held) - 1)
        size = lattice.size
        at = len(held) + 1 - size[lattice.closing(held, ends, END, state)]
        while at:
            emitted += 1
            at -= size[ends[at]]
        return emitted + 1

    def words(self, run: str) -> list[str]:
        """Pre-tokens of normalised text."""
        return (WIDE if ODD.search(run) else NARROW).findall(run)

    def plain(self, text: str) -> int:
        """Count of a text without special tokens that starts and ends at white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.count.__getitem__, self.words(text.lower())))

    def closed(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, count, tail); count is None where no white space resets the state."""
        first = GAP.search(chunk)
        if first is None:
            return chunk, None, ""
        last = max(chunk.rfind(m) for m in set(GAP.findall(chunk)))
        return chunk[: first.start()], self.closed(chunk[first.start() : last + 1]), chunk[last + 1 :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.closed(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix compositions: pairs first, then the gaps between them."""
        if len(maps) < 2:
            return maps
        whole = self.scan([self.compose(*maps[k : k + 2]) for k in range(0, len(maps) - 1, 2)])
        return [maps[0]] + [whole[k // 2] if k % 2 else self.compose(whole[k // 2 - 1], maps[k]) for k in range(1, len(maps))]

    def tokens(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.closed(text)
        maps = [self.chunk_map(text[k : k + CHUNK]) for k in range(0, len(text), CHUNK)]
        head, count, tail = self._fold(maps)
        return self.closed(head) if count is None else self.closed(head) + count + self.closed(tail)

    def _fold(self, maps: list[tuple]) -> tuple:
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit);
    repeated rows stay; an empty table gives an empty result; other columns are
    not read.  ``vocabulary`` is the path of the tokenizer's JSON file on the
    executors.  No shuffle; every worker builds its part of the automaton."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in batches:
            n = [t.tokens(x) if x else 0 for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
