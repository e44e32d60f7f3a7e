"""Fill-in-middle transformation.

A text is cut into units (lines or code points) and two cut points, drawn from
a hash of the row's id, part it in prefix, middle and suffix, which are put in
an order that lets a model see both sides first.

The texts of a batch lie end to end as UTF-8 and are read as 64-bit words, so
eight bytes are looked at together: arithmetic marks the bytes that end a unit
(the highest bit of each such byte), one population count per word and a
cumulative sum give the units before each word.  A cut after the k-th unit is
a search for its word in the sums and a select inside the word: a product puts
running counts in all eight bytes, and a subtraction tells in how many of them
the k-th mark is still to come.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import inner, passing, row_and

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
SENTINELS = ("<P>", "<S>", "<M>")
PART = 1 << 22  # bytes of text that are looked at together; a longer text goes alone


def as_words(raw: bytes) -> np.ndarray:
    """The bytes as little-endian words, filled up with zero bytes and one more zero word."""
    return np.frombuffer(raw + bytes(16 - len(raw) % 8), "<u8")


def newline_marks(words: np.ndarray) -> np.ndarray:
    rest = words ^ (ONES * np.uint64(10))
    return ~(((rest & LOW) + LOW) | rest | LOW)


def lead_marks(words: np.ndarray) -> np.ndarray:
    """Marks of the bytes that begin a code point."""
    return ~(words & ~(words << np.uint64(1))) & HIGH


def last_marks(words: np.ndarray) -> np.ndarray:
    """Marks of the bytes that end a code point: the next byte begins one."""
    lead = lead_marks(words)
    return (lead >> np.uint64(8)) | (np.append(lead[1:], HIGH) << np.uint64(56))


class Marked:
    """Rank and select over marks; marks are the highest bits of bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def before(self, at: np.ndarray) -> np.ndarray:
        """Number of marks before each byte position."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1)
        return self.upto[word] + np.bitwise_count(self.marks[word] & below)

    def after(self, k: np.ndarray) -> np.ndarray:
        """Byte position behind the k-th mark, counted from 1."""
        word = np.searchsorted(self.upto, k, "left") - 1
        left = (k - self.upto[word] - 1).astype(np.uint64)
        running = (self.marks[word] >> np.uint64(7)) * ONES
        open_bytes = ((left * ONES) | HIGH) - running & HIGH
        return (word << 3) + np.bitwise_count(open_bytes) + 1


def unit_marks(words: np.ndarray, unit: str, ends: np.ndarray) -> np.ndarray:
    """Marks of the bytes that end a unit; ``ends``: where each non-empty text
    ends, which ends a unit too."""
    if unit == "char":
        return last_marks(words)
    if unit != "line":
        raise ValueError(f"unit {unit!r}: line or char")
    marks = newline_marks(words)
    marks.view(np.uint8)[ends - 1] |= np.uint8(0x80)
    return marks


def cuts(texts: list[bytes], h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Per text: units, byte length of prefix and of prefix with middle, code points of prefix and middle."""
    size = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(size)
    start = stop - size
    words = as_words(b"".join(texts))
    units, leads = Marked(unit_marks(words, unit, stop[size > 0])), Marked(lead_marks(words))
    base = units.before(start)
    n = units.before(stop) - base
    one, two = h1 % (n + 1), h2 % (n + 1)
    a, b = np.minimum(one, two), np.maximum(one, two)
    first, second = start.copy(), start.copy()
    for k, at in ((a, first), (b, second)):
        at[k > 0] = units.after((base + k)[k > 0])
    at, mid, end = leads.before(start), leads.before(first), leads.before(second)
    return n, first - start, second - start, mid - at, end - mid


def _draws(row_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits per row; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _parts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most PART bytes, or of one row."""
    at, total = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > at and total + n > PART:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(size):
        yield at, len(size)


def fill_in_middle(
    docs: DataFrame, seed: int = 7, percent: int = 100, percent_spm: int = 50, unit: str = "line",
    sentinels: tuple[str, str, str] = SENTINELS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` with the columns n_units, form (plain, psm or spm), prefix_chars,
    middle_chars (null if plain) and output.

    ``percent`` of the rows are transformed, ``percent_spm`` of these suffix
    first.  A text that is empty or holds a sentinel stays plain.  A null text
    counts as empty; rows with the same id are cut at the same shares; a null
    id counts as an empty one; repeated rows stay; an empty table gives an
    empty result; other columns pass through, but those with the names of the
    new ones are replaced.  No shuffle; a batch is worked off in parts of
    ``PART`` bytes."""
    marks = [s.encode() for s in sentinels]
    pre, suf, mid = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = inner(batch, k).cast(pa.binary())
            size = np.array([0 if t is None else t for t in pa.compute.binary_length(all_texts).to_pylist()], np.int64)
            for at, to in _parts(size):
                part = batch.slice(at, to - at)
                texts = [t or b"" for t in all_texts.slice(at, to - at).to_pylist()]
                h1, h2, h3, h4 = (part.column(f"h{j}").to_numpy() for j in range(1, 5))
                n, one, two, left, held = cuts(texts, h1, h2, unit)
                plain = [not t or x or any(m in t for m in marks) for t, x in zip(texts, (h3 % 100 >= percent).tolist())]
                spm = (h4 % 100 < percent_spm).tolist()
                forms, outs = [], []
                for t, p, s, a, b in zip(texts, plain, spm, one.tolist(), two.tolist()):
                    forms.append("plain" if p else "spm" if s else "psm")
                    outs.append(t if p else suf + t[b:] + pre + t[:a] + mid + t[a:b] if s else pre + t[:a] + suf + t[b:] + mid + t[a:b])
                none = np.array(plain, bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(n), pa.array(forms, pa.string()), pa.array(left, mask=none), pa.array(held, mask=none), pa.array(outs, pa.binary()).cast(pa.string())],
                    ["row", "n_units", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows, k = passing(docs, text)
    drawn = rows.select("row", *_draws(F.col("row")[doc_id], seed))
    new = ["n_units", "form", "prefix_chars", "middle_chars", "output"]
    out = drawn.mapInArrow(run, row_and(rows, "n_units long, form string, prefix_chars long, middle_chars long, output string"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *new)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made from.  Sentinels stand in no transformed
    text and have no common ends, so the three in the output are those put in."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels))
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
