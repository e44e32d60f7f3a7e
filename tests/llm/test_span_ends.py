import random

from cadenza.llm import spans
from test_spans import sentence


def test_runs_reach_the_last_units():
    at, hashes = spans.runs([5, 5, 5, 1, 1, 1], [1, 2, 3, 4, 5, 6])
    assert {u for i, n in at for u in range(i, i + n)} == set(range(6)) and len(hashes) == len(at)


def test_passages_inside_sentences_go(spark):
    r = random.Random(8)
    docs, passages, words = [], [], lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    for k in range(150):
        passage = words(r.randint(51, 90))
        for i in range(r.randint(4, 25), len(passage), r.randint(6, 30)):
            passage[i] += r.choice(".!?")
        passages.append(passage)
        for copy in (k, 1000 + k):
            parts = [sentence(r), *words(r.randint(1, 20)), *passage, *words(r.randint(1, 20)), sentence(r)]
            docs.append((copy, " ".join(parts)))
    left = {x["doc_id"]: x["text"].split() for x in spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    before = {k: t.split() for k, t in docs}
    assert all(left[k] == before[k] for k in range(150))
    gone = [(len(before[1000 + k]) - len(left[1000 + k])) / len(p) for k, p in enumerate(passages)]
    assert min(gone) > 0.2 and sum(gone) / len(gone) > 0.7 and max(gone) <= 1


def test_last_short_sentences_of_a_copy_go(spark):
    text = "A b c d e. F g h i j. K l m n o. P! Q! R!"
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert [x["text"] for x in spans.affected(docs).collect()] == [""]


def test_text_without_cut_words_is_cut_by_length():
    at, counts, _ = spans.units("word " * 300)
    assert max(counts) <= spans.LONG and sum(counts) == 300 and len(at) == len(counts)
