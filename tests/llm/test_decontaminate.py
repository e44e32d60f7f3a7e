import random
import re

import numpy as np

from cadenza.llm import decontaminate as dec


def vocabulary(r):
    return [f"c{k}" for k in range(30)] * 4 + [f"r{k}" for k in range(2000)]


def items(r, n):
    v = vocabulary(r)
    return [(k, " ".join(r.choice(v) for _ in range(r.randint(8, 150))) + ". " + " ".join(r.choice(v) for _ in range(r.randint(3, 12))) + ".") for k in range(n)]


def index_of(rows, threshold=0.6):
    terms = [dec.words_of(t) for _, t in rows]
    df = {}
    for x in terms:
        for w in set(x):
            df[w] = df.get(w, 0) + 1
    return dec.Index(rows, len(rows), float(np.mean([len(x) for x in terms])), df, threshold)


def test_wand_equals_full_scoring():
    r = random.Random(1)
    for threshold in (0.1, 0.3, 0.6):
        index = index_of(items(r, 120), threshold)
        back = {p: {} for p in range(len(index.of))}
        for t, (parts, weights) in enumerate(index.lists):
            for p, w in zip(parts, weights):
                back[p][t] = w
        for _ in range(150):
            if r.random() < 0.5:
                own = back[r.randrange(len(back))]
                terms = sorted(set(r.sample(sorted(own), max(1, len(own) * 2 // 3))) | set(r.sample(range(len(index.term)), 20)))
            else:
                terms = sorted(set(r.sample(range(len(index.term)), 80)))
            want = {p: s for p, w in back.items() if (s := sum(w.get(t, 0.0) for t in terms)) >= threshold - 1e-9}
            got = dict(index.search(terms))
            assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_candidates_lose_no_passage():
    r = random.Random(2)
    rows = items(r, 80)
    index, v = index_of(rows), vocabulary(r)
    texts = []
    for _ in range(120):
        words = [r.choice(v) for _ in range(r.randint(0, 400))]
        if r.random() < 0.6:
            at = r.randint(0, len(words))
            words[at:at] = dec.words_of(r.choice(rows)[1])[: r.randint(5, 200)]
        texts.append(words)
    terms = [np.array([index.term.get(w, -1) for w in x], np.int64) for x in texts]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    got = {tuple(x) for x in index.candidates(np.concatenate(terms), starts).tolist()}
    for d, x in enumerate(terms):
        for k in range((len(x) + dec.STRIDE - 1) // dec.STRIDE):
            own = x[k * dec.STRIDE : (k + 2) * dec.STRIDE]
            if index.search(np.unique(own[own >= 0]).tolist()):
                assert (d, k) in got


def test_planted_items_are_found_and_clean_rows_left(spark):
    r = random.Random(3)
    rows, v = items(r, 60), vocabulary(random.Random(3))
    docs, want = [], set()
    for d in range(150):
        words = [r.choice(v) for _ in range(r.randint(0, 500))]
        if d % 3 == 0:
            k, text = r.choice(rows)
            at = r.randint(0, len(words))
            words[at:at] = text.upper().split()
            want.add((d, k))
        docs.append((d, " ".join(words)))
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in dec.contaminated(docs_df, bench).collect()}
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    assert want <= got == {(d, k) for d, t in docs for k, x in rows if plain(x) in plain(t)}
    assert {x["doc_id"] for x in dec.drop_contaminated(docs_df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_groups_give_the_same_hits(spark, monkeypatch):
    r = random.Random(4)
    rows = items(r, 40)
    docs = spark.createDataFrame([(k, "lead " + t) for k, t in rows[::2]], "doc_id long, text string")
    bench = spark.createDataFrame(rows, "item_id long, text string")
    key = lambda df: sorted((x["doc_id"], x["item_id"], round(x["score"], 6)) for x in df.collect())
    whole = key(dec.contaminated(docs, bench))
    monkeypatch.setattr(dec, "GROUP_BYTES", 4000)
    assert len(dec.build_indexes(bench)) > 2 and key(dec.contaminated(docs, bench)) == whole


def test_short_items_need_a_full_match(spark):
    bench = spark.createDataFrame([(1, "Capital of Peru? Lima."), (2, "Zwölf mal zwölf?"), (3, "日本の首都は。東京"), (4, "a")], "item_id long, text string")
    texts = ["x " * 200 + "the CAPITAL of Peru: lima indeed", "capital of Lima, Peru", "the capital of peru", "zwölf - MAL - zwölf", "q 日本の首都は 東京 q", "日本の首都は", "x a y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["question_overlap"]) for r in dec.contaminated(docs, bench).collect()) == [(0, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0), (6, 4, 1.0)]
    assert sorted(r["doc_id"] for r in dec.drop_contaminated(docs, bench).collect()) == [1, 2, 5]


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (None, "a b c d e f g h i"), (2, ""), (3, "too short"), (6, "..."), (7, "three one two"), (4, "no such words are in any of these texts at all")], "item_id long, text string")
    assert dec.contaminated(odd_docs, bench).count() == 0
    assert dec.drop_contaminated(odd_docs, bench).count() == 10 and dec.drop_contaminated(odd_docs, bench).columns == odd_docs.columns
    assert dec.contaminated(odd_docs, bench.limit(0)).count() == 0 and dec.drop_contaminated(odd_docs, bench.limit(0)).count() == 10
    assert dec.contaminated(no_docs, bench).count() == 0 and dec.drop_contaminated(no_docs, bench).count() == 0
    twice = spark.createDataFrame([(5, "One two three four. Five six seven eight nine! Ten eleven twelve thirteen fourteen fifteen sixteen?")], "item_id long, text string")
    assert [x["doc_id"] for x in dec.contaminated(odd_docs, twice).collect()] == [1, 1]
