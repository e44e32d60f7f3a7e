import random

import corpus_pipeline
from cadenza.llm import minhash, simhash
from test_pipeline import groups
from test_simhash import slow_components


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return bool(a) and 5 * len(a & b) >= 4 * len(a | b)


def near_copies():
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    texts = ["", "one two", "One  two", "a b c d e", "a b c d e f"]
    for n in (12, 40, 60, 120, 300, 900) * 2:
        base = [r.choice(words) for _ in range(n)]
        for _ in range(6):
            other = list(base)
            for _ in range(r.randint(0, max(1, n // 30))):
                other[r.randrange(n)] = r.choice(words)
            texts.append(" ".join(other))
    return texts + texts[:9]


def test_stage_groups_are_those_of_brute_force(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, bits = [grams(t) for t in texts], [simhash.fingerprint(t) for t in texts]
    near = lambda a, b: bin((bits[a] ^ bits[b]) & (1 << 64) - 1).count("1") <= 3
    want = slow_components(range(len(texts)), lambda a, b: near(a, b) or alike(sets[a], sets[b]))
    thin = slow_components(range(len(texts)), near)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(want.values()) < set(thin.values())


def test_given_near_copies_all_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bits, sets = {k: simhash.fingerprint(t) for k, t in texts.items()}, {k: grams(t) for k, t in texts.items()}
    close = lambda a, b: len(sets[a]) * 5 >= len(sets[b]) * 4 and len(sets[b]) * 5 >= len(sets[a]) * 4 and alike(sets[a], sets[b])
    ids = sorted(texts)
    pairs = [(bits[a], bits[b]) for i, a in enumerate(ids) for b in ids[i + 1 :] if bits[a] != bits[b] and close(a, b)]
    found = [tuple(r) for r in minhash.links(docs).collect()]
    assert groups({*bits.values()}, found) == groups({*bits.values()}, pairs) and len(pairs) >= 5


def test_a_large_group_makes_few_rows(spark, monkeypatch):
    """Thousands of near copies of one text: rows in proportion to the group, one class."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[:at] + [f"x{k}"] + base[at + 1 :]) for k in range(3000) for at in [r.randrange(200)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = []
    slow = minhash._alike
    monkeypatch.setattr(minhash, "_alike", lambda t, pairs: (sizes.append(pairs.count()), slow(t, pairs))[1])
    found = [tuple(x) for x in minhash.links(docs).collect()]
    assert sum(sizes) < 120_000 and len(found) < 120_000
    assert len(set(groups({simhash.fingerprint(t) for t in texts}, found).values())) == 1


def test_a_group_of_many_classes_makes_few_rows(spark, monkeypatch):
    """Near copies with so many changes that most are near to few others: the
    classes of brute force, without all pairs of the group."""
    r = random.Random(12)
    base, texts = [f"w{k}" for k in range(146)], set()
    while len(texts) < 900:
        words = list(base)
        for _ in range(r.randint(1, 6)):
            words[r.randrange(len(words))] = r.choice(["", "again", f"x{r.randrange(400)}"])
        texts.add(" ".join(words))
    texts = sorted(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, slow = [], minhash._alike
    monkeypatch.setattr(minhash, "_alike", lambda t, pairs: (sizes.append(pairs.count()), slow(t, pairs))[1])
    found = [tuple(x) for x in minhash.links(docs).collect()]
    bits, sets = [simhash.fingerprint(t) for t in texts], [grams(t) for t in texts]
    pairs = [(bits[a], bits[b]) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b])]
    assert groups(set(bits), found) == groups(set(bits), pairs)
    assert len(set(groups(set(bits), found).values())) > 50 and sum(sizes) < 20 * len(texts), sizes


def test_odd_rows(spark, odd_docs, no_docs):
    assert minhash.links(odd_docs).count() == 0 and minhash.links(no_docs).count() == 0
    assert simhash.keep_one(no_docs, more=minhash.links(no_docs)).count() == 0
    assert len(minhash.shingles(None)) == 0 and len(minhash.shingles("a B c d")) == 1
