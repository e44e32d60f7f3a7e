import random

from cadenza.llm import spans


def slow(docs):
    """Units to remove per document, by the definition: least runs from every start and back from every end."""
    seen, out = {}, {}
    for key, text in sorted(docs):
        _, counts, hashes = spans.units(text or "")
        gone = set()
        enough = {(i, e) for i in range(len(counts)) for e in range(i + spans.RUN, len(counts) + 1) if sum(counts[i:e]) >= spans.WORDS}
        least = {(i, e) for i, e in enough if (i, e - 1) not in enough or (i + 1, e) not in enough}
        for i, e in sorted(least):
            run = tuple(hashes[i:e])
            if seen.setdefault(run, (key, i)) != (key, i):
                gone.update(range(i, e))
        out[key] = gone
    return out


def sentence(r):
    return " ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(1, 60))).capitalize() + r.choice(".!?")


def test_removed_units_match_brute_force(spark):
    r = random.Random(2)
    shared = [" ".join(sentence(r) for _ in range(4)) for _ in range(5)]
    docs = []
    for k in range(60):
        parts = [sentence(r) for _ in range(r.randint(0, 8))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        docs.append((k, r.choice([" ", "\n", "  \n "]).join(parts)))
    want = {k: v for k, v in slow([((k,), t) for k, t in docs]).items() if v}
    rows = {r["doc_id"]: r for r in spans.affected(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {(k,): r["n_removed"] for k, r in rows.items()} == {k: len(v) for k, v in want.items()} and len(rows) > 10
    texts = dict(docs)
    for k, r in rows.items():
        at, _, _ = spans.units(texts[k])
        kept = [texts[k][s:e] for i, (s, e) in enumerate(at) if i not in want[(k,)]]
        assert r["text"].split() == " ".join(kept).split() and min(r["first_ids"]) <= k


def test_units_cover_the_text_and_resynchronise():
    r = random.Random(5)
    long = " ".join(f"v{r.randrange(999)}" for _ in range(300))
    a, b = spans.units("lead in words " + long)[2], spans.units("quite another start of it " + long)[2]
    assert len(a) > 10 and len(set(a) & set(b)) >= len(a) - 2
    at, counts, _ = spans.units("A b.  C d!\n\n e f? g")
    assert ["A b.  C d!\n\n e f? g"[s:e] for s, e in at] == ["A b.", "C d!", "e f?", "g"] and counts == [2, 2, 2, 1]
    assert spans.units("") == ([], [], []) and spans.runs([], []) == ([], [])


def test_odd_rows(spark, odd_docs, no_docs):
    out = spans.remove_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert len(rows) == 10
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[2] is None and texts[3] == "" and texts[6] == "x" * 40_000 and texts[None] == "no id here"
    assert len([r for r in rows if r["doc_id"] == 1 and r["text"].startswith("One two")]) == 2
    assert spans.remove_repeats(no_docs).count() == 0 and spans.affected(no_docs).count() == 0
    copy = spark.createDataFrame([(9, "One two three four. Five six seven eight nine! Ten eleven twelve thirteen fourteen fifteen sixteen?")], "doc_id long, text string")
    gone = spans.affected(odd_docs.select("doc_id", "text").union(copy)).where("doc_id = 9").first()
    assert gone["text"] == "" and gone["first_ids"] == [1]
