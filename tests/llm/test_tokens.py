import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import pieces, token_counts
from cadenza.llm.lattice import Lattice, Stream, merged

ODD = [
    "", "'street 's 're re's !'s don't DON'T", "İstanbul ΑΣΣ Σ", "<|endoftext|>a<|startoftext|>", "<|ENDOFTEXT|>", "a\x1cb\x1f c", "²³ ½ x² ٣٤ 三百 日本語テキスト",
    "é é ́", "👩‍👩‍👧 😀😀", "a" * 900, "_a_b__ 'll'", "Ǆ ǅ ß ẞ", "a\u0000b", "  double  spaces   here ", "\t\n \n", "▁▁ x▁y", "<s> </s> <0x0A> <unk>", "ﬁ①", "q'" * 300, "x　y z w",
]


def mixed(seed, n):
    r = random.Random(seed)
    alphabet = "abcdehinotrs'éèß ,.!-_0912\n\t ’Σ日👍▁²<|>"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return ODD + mixed(1, 1500) + [r["text"] for r in docs.select("text").collect()]


def test_counts_equal_the_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, t = Tokenizer.from_file(path), token_counts.Transducer(path)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t.tokens(x) for x in texts] == want


def test_chunk_maps_compose(monkeypatch, texts):
    t = token_counts.Transducer(public_tokenizers.path("word_bpe_49k.json"))
    whole = {x: t.tokens(x) for x in texts[:400]}
    for size in (1, 3, 17):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert {x: t.tokens(x) for x in whole} == whole
    maps = [t.chunk_map(c) for c in ("ab c", "d", "e f", " g", "hi'", "s x")]
    scanned = t.scan(maps)
    assert len(scanned) == len(maps) and scanned[-1] == t._fold(maps)
    assert scanned[2] == t.compose(t.compose(maps[0], maps[1]), maps[2]) == t.compose(maps[0], t.compose(maps[1], maps[2]))


def test_small_memo_gives_the_same_counts(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    a, b = token_counts.Transducer(path), token_counts.Transducer(path, memo=7)
    assert [a.tokens(x) for x in texts[:200]] == [b.tokens(x) for x in texts[:200]]


def test_count_rows(odd_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_counts.token_counts(odd_docs, path).collect()
    assert len(rows) == 10 and {(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, 0, False)}
    assert {r["n_tokens"]: r["over_limit"] for r in rows if r["doc_id"] == 5} == {30_000: True}
    assert token_counts.token_counts(no_docs, path).count() == 0


def test_ids_and_texts_equal_the_library(texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, p, back = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load_pieces(path), pieces.load_spelling(path)
    for x in texts:
        ids = p.encode(x).tolist()
        assert ids == library.encode(x)
        assert back.decode(ids) == library.decode(ids)


def test_stream_commits_and_equals_merging():
    r = random.Random(4)
    rank = {("a", "b"): 0, ("b", "a"): 1, ("ab", "ab"): 2, ("a", "a"): 3, ("aa", "b"): 4, ("abab", "a"): 5, ("b", "b"): 6}
    lattice = Lattice(["a", "b", *map("".join, rank)], lambda x, y: rank.get((x, y)))
    for n in (1, 2, 7, 40, 400):
        for _ in range(30):
            text = "".join(r.choice("aabbc") for _ in range(n))
            stream, out, longest = Stream(lattice), [], 0
            for at in range(0, n, 5):
                out += stream.feed(text[at : at + 5])
                longest = max(longest, len(stream.text))
            out += stream.finish()
            assert out == lattice.numbers(text)
            assert list(lattice.spelled(text, out)) == merged(list(text), lattice.rank)
            assert longest <= 3 * 8 * lattice.longest


def test_encode_rows(odd_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(odd_docs, path)
    assert set(coded.columns) == {*odd_docs.columns, "n_ids"}
    back = pieces.decode(coded, path).select("doc_id", "text", "decoded", "n_ids", "`a.b`").collect()
    assert len(back) == 10
    for r in back:
        assert r["decoded"] == (r["text"] or "").replace("▁", " ") and (r["n_ids"] > 0) == bool(r["text"])
    assert pieces.decode(pieces.encode(no_docs, path), path).count() == 0
    both = pieces.encode_and_decode(odd_docs, path)
    assert {(r["doc_id"], r["decoded"]) for r in both.collect()} == {(r["doc_id"], r["decoded"] or "") for r in back}
    inside = pieces.encode_and_decode(odd_docs, path, into="text")
    assert set(inside.columns) == {*odd_docs.columns, "n_ids"} and {r["text"] for r in inside.collect()} == {r["decoded"] or "" for r in back}
    assert pieces.encode_and_decode(no_docs, path).count() == 0
    assert pieces.decode(coded.withColumn("ids", F.lit(None).cast("array<int>")), path).where("decoded is not null").count() == 0


def test_every_fragment_is_committed_by_the_window(texts):
    p = pieces.Pieces(pieces.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")), memo=40)
    some = [t for t in texts if t][:60]
    n = len({f for t in some for f in p.fragment.findall(pieces.MARK + t.replace(" ", pieces.MARK))})
    before = p.commits
    for t in some:
        p.encode(t)
    assert p.commits - before >= n
    assert max(len(d) for d in (p.kept, p.lattice.apart, p.lattice.fallen)) <= 40


def test_frequent_fragments_stay_in_the_memo():
    """Fragments that come up once push out one another, not those that come up all the time."""
    p = pieces.Pieces(pieces.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")), memo=40)
    made, make = [], p.kept.make
    p.kept.make = lambda f: (made.append(f), make(f))[1]
    for k in range(300):
        p.encode(f"often z{chr(97 + k // 26)}{chr(97 + k % 26)}q and often")
    assert made.count(pieces.MARK + "often") == made.count(pieces.MARK + "and") == 1 and len(made) > 300
    assert len(p.kept) + len(p.kept.older) <= 40
