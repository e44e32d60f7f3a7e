import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from sentencepiece import SentencePieceProcessor

from cadenza.llm import align

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def slow_links(a, b):
    """All pairs of overlapping tokens, and the groups, by comparing every token with every other."""
    span = lambda ends: list(zip([0, *ends], ends))
    links = [(i, j) for i, (s, e) in enumerate(span(a)) for j, (u, v) in enumerate(span(b)) if s < v and u < e]
    cuts = sorted(set(a) & set(b))
    groups = [([i for i, e in enumerate(a) if lo < e <= hi], [j for j, e in enumerate(b) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
    return links, groups


def test_runs_equal_the_slow_way():
    r = random.Random(3)
    for n in (1, 2, 9, 40, 200):
        for odd in (0.0, 0.05, 0.5, 1.0):
            a = sorted({n, *(k for k in range(1, n) if r.random() < 0.6)})
            b = sorted({n, *(k for k in range(1, n) if (k in a) != (r.random() < odd))})
            groups, left, right = align.irregular(np.array(a), np.array(b))
            links, want = slow_links(a, b)
            odd_ones = [(x[0], x[-1] + 1, y[0], y[-1] + 1) for x, y in want if len(x) > 1 or len(y) > 1]
            assert groups == odd_ones
            inside = [(i, j) for i, j in links if any(g[0] <= i < g[1] for g in groups)]
            assert sorted(zip(left, right)) == sorted(inside)


def brute(texts):
    """The whole query by the libraries and the slow way."""
    t, s = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    signs, names = align._byte_signs(), {k: v for v, k in t.get_vocab().items()}
    bytes_a = lambda k: bytes(signs[c] for c in names[k])
    bytes_b = lambda k: bytes([int(s.id_to_piece(k)[3:5], 16)]) if s.is_byte(k) else s.id_to_piece(k).replace("▁", " ").encode()
    found, total = [], Counter()
    for text in texts:
        ids_a, ids_b = (t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        raw_a, raw_b = [bytes_a(k) for k in ids_a], [bytes_b(k) for k in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            found.append(([], [], [], []))
            continue
        links, groups = slow_links(*(np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b)))
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        total.update(pairs)
        found.append((ids_a, ids_b, groups, pairs))
    top = Counter()
    for (_, b), n in total.items():
        top[b] = max(top[b], n)
    out = []
    for ids_a, ids_b, groups, pairs in found:
        text = ";".join(",".join(str(ids_a[i]) for i in x) + "|" + ",".join(str(ids_b[j]) for j in y) for x, y in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(pairs), sum(total[p] == top[p[1]] for p in pairs), sum(total[p] for p in pairs), text))
    return out


ODD = [None, "", " ", "a", "▁ mark", "x▁y", "<|endoftext|> <s> </s> <0x0A> <unk>", "日本語 😀👍 ünïcode\n\n\ttabs  two", "a\u0000b \u200b ﷽", "don't won't I'll", "word " * 400, "x" * 900]


def test_alignments_equal_brute_force(spark):
    some = [r["text"][:600] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts = [*ODD, *some, *some[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute(texts)
    for block in (1, 500, align.BLOCK):
        rows = {r["doc_id"]: tuple(r)[1:] for r in align.alignments(docs, A, B, block_bytes=block).collect()}
        assert [rows[k] for k in range(len(texts))] == want
    shaped = align.alignments(docs, A, B, shape=lambda g: hashlib.sha256(g).hexdigest()).collect()
    assert {r["doc_id"]: r["groups"] for r in shaped} == {k: hashlib.sha256(w[-1].encode()).hexdigest() for k, w in enumerate(want)}


def test_pair_counts_add_up(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = align.blocks(docs, A, B, bytes.decode)
    pairs = align.pair_counts(found)
    links = sum(sum(r["n_links"]) for r in found.collect())
    assert pairs.agg({"total": "sum"}).first()[0] == links > 0
    assert pairs.groupBy("b_id").agg({"total": "max"}).count() == pairs.where("best").select("b_id").distinct().count()


def test_odd_and_empty_tables(odd_docs, no_docs):
    rows = align.alignments(odd_docs, A, B).collect()
    assert len(rows) == 10 and {(r["n_a"], r["n_links"], r["groups"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, 0, "")}
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in rows)
    assert all(r["n_a"] > 0 for r in rows if r["doc_id"] in (1, 4, 5, 6, None)) and {r["n_a"] for r in rows if r["doc_id"] == 7} == {0}
    assert align.alignments(no_docs, A, B).count() == 0


def test_byte_level_ids_equal_the_library():
    r = random.Random(9)
    t, own = Tokenizer.from_file(A), align.ByteLevel(A)
    t.encode_special_tokens = True
    signs = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070), 0x3042, 0x4E00, 0x1F600, 0x0301, 0xFEFF, 0x1C, 0x85, 0x180E, 0x2028, 0xE000, 0x10FFFF, 0x0378, 0x1E900, 0x16FF0)]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(2000)] + [x for x in ODD if x]
    assert own.fast is not None and own.encode(texts) == [e.ids for e in t.encode_batch([" " + x for x in texts], add_special_tokens=False)]
    own.odd |= {"a", "é"}
    assert own.encode(texts) == [e.ids for e in t.encode_batch([" " + x for x in texts], add_special_tokens=False)]
