import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import infill

UNITS = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "char": re.compile(r"(?s).")}


def slow(doc_id, text, unit, percent, spm):
    t, x = text or "", hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS[unit].findall(t)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not t or any(m in t for m in infill.SENTINELS) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, t
    out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < spm else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return len(units), out[0], len(pre), len(mid), out[1]


def texts():
    r = random.Random(5)
    odd = [None, "", "\n", "\n\n\n", "a", "a\n", "no end\nof line", "<P> in here\n", "x<S", "é\nß\n日本\n😀😀\nend", "\u0000\n\u0000", "\x8a\x0a\x0b\u010a", "<\n<S\n<M\n>\n", "long\n" * 9000]
    return odd + ["".join(r.choice("ab\n\né日😀<SPM>") for _ in range(r.randint(0, 90))) for _ in range(700)]


@pytest.mark.parametrize("unit, percent, spm", [("line", 100, 50), ("char", 100, 50), ("line", 40, 0), ("char", 70, 100)])
def test_cuts_equal_the_slow_way(spark, unit, percent, spm, monkeypatch):
    rows = [(k, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, (None, "a\nb\nc"), (3, "a second row\nof id 3")], "doc_id long, text string").repartition(3)
    made = infill.fill_in_middle(docs, percent=percent, percent_spm=spm, unit=unit)
    for r in made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect():
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == slow(r["doc_id"], r["text"], unit, percent, spm)
        assert r["back"] == (r["text"] or "")


def test_rank_and_select():
    r = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 64, 1000):
        raw = r.choice([10, 65, 0x8A, 0xC3, 0x0B], n).astype(np.uint8).tobytes()
        m = infill.Marked(infill.newline_marks(infill.as_words(raw)))
        ends = [k + 1 for k, c in enumerate(raw) if c == 10]
        assert m.before(np.arange(n + 1)).tolist() == [sum(e <= k for e in ends) for k in range(n + 1)]
        assert m.after(np.arange(1, len(ends) + 1)).tolist() == ends


def test_small_parts_and_other_sentinels(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts()[:40])], "doc_id long, text string")
    marks = ("|.*|", "[+", "(?")
    made = infill.fill_in_middle(docs, sentinels=marks).withColumn("back", infill.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r["back"] == (r["text"] or "") for r in made) and len({r["form"] for r in made}) == 3
    assert list(infill._parts(np.array([3, 0, infill.PART, 1, infill.PART + 9, 2]))) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)]


def test_odd_and_empty_tables(odd_docs, no_docs):
    made = infill.fill_in_middle(odd_docs.withColumn("form", F.lit("own")).withColumn("h1", F.lit("mine")))
    rows = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == 10 and all(r["back"] == (r["text"] or "") and r["a.b"] == "dot" and r["h1"] == "mine" for r in rows)
    assert {r["form"] for r in rows if r["doc_id"] in (2, 3)} == {"plain"}
    assert infill.fill_in_middle(no_docs).count() == 0
    with pytest.raises(Exception, match="line or char"):
        infill.fill_in_middle(odd_docs, unit="word").count()
