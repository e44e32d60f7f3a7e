import random

import xxhash

from cadenza.llm import graph, simhash


def slow_bits(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def slow_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_of_texts():
    for text in ["", None, "A", "a b", "A b C", "a b c d", "É é   x", "w " * 70_000, "\x1f a\x0bb\x0cc d e"]:
        assert simhash.fingerprint(text) == slow_bits(text)


def test_anchor_flips_reach_exactly_the_near_code_words():
    syndrome = lambda w: [s := 0, [s := s ^ i for i in range(1, 32) if w >> (i - 1) & 1]][1][-1:] or [0]
    flips = simhash.anchor_flips()
    for s, masks in enumerate(flips):
        word = 1 << (s - 1) if s else 0
        near = {word ^ m for m in masks}
        assert all(syndrome(w) == [0] for w in near)
        balls = {0, *(1 << i for i in range(31)), *((1 << i) | (1 << j) for i in range(31) for j in range(i))}
        assert near == {word ^ m for m in balls if syndrome(word ^ m) == [0]}
        assert bin(masks[0]).count("1") <= 1


def test_links_are_all_pairs_within_three_bits(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    values = set(base)
    for b in base:
        for n in (1, 2, 3, 3, 4, 5):
            values.add(b ^ sum(1 << k for k in r.sample(range(64), n)))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(v,) for v in signed], "bits long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 201), (201, 200), (-5, 200)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, -5: -5, 200: -5, 201: -5}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in simhash.near_duplicates(odd_docs).collect()]
    assert len(rows) == 10
    component = {}
    for doc_id, bits, root in rows:
        component.setdefault(doc_id, set()).add((bits, root))
    assert component[2] == component[3] == component[4] == {(0, 2)}
    assert component[7] == component[8] and len(component[1]) == 1
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 5, 6, 7, None]
    assert simhash.keep_one(no_docs).count() == 0


def test_components_match_brute_force(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(200)]
        for _ in range(4):
            other = list(base)
            for _ in range(r.randint(0, 4)):
                other[r.randrange(200)] = r.choice(words)
            texts.append(" ".join(other))
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = {k: slow_bits(t) for k, t in enumerate(texts)}
    want = slow_components(bits, lambda a, b: bin((bits[a] ^ bits[b]) & (1 << 64) - 1).count("1") <= 3)
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs).collect()} == want
    assert len(set(want.values())) < len(texts)
