import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import quality, toxicity


def auc(rows):
    y, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]))


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def held_out(scored, labels, target):
    rows = scored.where("held_out").join(labels, "doc_id").select(target, "score", "predicted").collect()
    return [(r[0], r[1]) for r in rows], rows


def test_quality_on_the_held_out_fold(tables):
    docs, labels = tables
    scored = quality.quality(docs, labels)
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or predicted != cast(score >= 0.3 as int)").count() == 0
    pairs, _ = held_out(scored, labels, "quality")
    assert auc(pairs) > 0.97


def test_toxicity_on_the_held_out_fold(tables):
    docs, labels = tables
    scored = toxicity.toxicity(docs, labels)
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or predicted != cast(score >= 0.7 as int)").count() == 0
    pairs, rows = held_out(scored, labels, "toxic")
    assert auc(pairs) > 0.8 and sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.05 * len(rows)
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert sum(toxic) >= 0.6 * len(toxic)


def test_every_window_of_a_training_document_counts():
    r = np.random.default_rng(8)
    clean = lambda n: [f"w{r.integers(40)}" for _ in range(n)]
    sample = [(k % 2, clean(700) + ["vile"] * (k % 2) + clean(700)) for k in range(60)]
    net = toxicity.fit(sample)
    long = [" ".join(clean(3000)), " ".join(clean(1500) + ["vile"] + clean(1500))]
    clear, toxic = toxicity.score_texts(net, toxicity.Table(net), long)
    assert clear < 0.3 and toxic > 0.7


def test_pair_sum_equals_the_double_sum():
    m = quality.Machine()
    r = np.random.default_rng(1)
    m.w, m.v, m.bias = r.standard_normal(quality.WIDTH), r.standard_normal((quality.WIDTH, quality.FACTORS)), 0.3
    index, x = r.choice(quality.WIDTH, 12, replace=False), r.random(12)
    slow = m.bias + m.w[index] @ x + sum(m.v[index[i]] @ m.v[index[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert abs(m.parts(index, x, np.array([0]))[0][0] - slow) < 1e-9


def test_gradient_equals_differences():
    net = toxicity.Network(1)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64) * 3
    words = ["idiot", "the", "of", "x", "résumé"]
    feats = toxicity.features(words)
    r = np.random.default_rng(2)
    ids = np.where(np.arange(9) < 6, r.integers(1, 6, (4, 9)), 0)
    y, weight = np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        table = np.concatenate((np.zeros((2, 1, 3 * toxicity.HIDDEN)), net.gates(net.inputs(*feats)[0])), axis=1)
        q = toxicity.sigmoid(net.logits(table, ids))
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    g = net.gradient(ids, y, weight, feats)
    for name in net.p:
        flat, value = net.p[name].reshape(-1), g[name].reshape(-1)
        for at in np.argsort(-np.abs(value))[:3]:
            old, step = flat[at], 2e-3
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            down = loss()
            flat[at] = old
            assert abs((up - down) / (2 * step) - value[at]) < 2e-3 * max(1, abs(value[at])) + 2e-4, name


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 84, 85, 1000):
        starts = toxicity.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a <= toxicity.STEP for a, b in zip(starts, starts[1:]))


def test_batches_and_table_resets_do_not_change_scores():
    net, r = toxicity.Network(3), np.random.default_rng(4)
    texts = [None, "", "..."] + [" ".join(f"w{r.integers(60)}" for _ in range(n)) for n in (1, 47, 48, 49, 300)]
    whole = toxicity.score_texts(net, toxicity.Table(net), texts)
    one = toxicity.Table(net, most=5)
    assert np.allclose(whole, np.concatenate([toxicity.score_texts(net, one, [t]) for t in texts]), atol=1e-6)
    assert whole[:3].tolist() == [0, 0, 0]


@pytest.mark.parametrize("score", [quality.quality, toxicity.toxicity])
def test_odd_rows(spark, odd_docs, no_docs, score):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 1), (6, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = score(odd_docs, labels).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert {r["score"] for r in score(odd_docs, labels.limit(0)).collect()} == {0.0}
    assert score(no_docs, labels).count() == 0
    assert score(odd_docs.drop("n_chars").withColumn("label", F.lit("x")), labels).count() == 10


def test_a_stored_length_that_differs_is_learnt_and_weighs_nothing_unseen():
    bucket = quality.new_buckets()
    row = lambda text, n: quality.row_of(text, n, bucket)
    texts = [f"plain words number {k} in a row" for k in range(40)]
    seen = quality.fit([(k % 2, *row(t, len(t) + k % 2)) for k, t in enumerate(texts)])
    same, differs = seen.score([row(texts[0], len(texts[0])), row(texts[0], 1)])
    assert same < 0.5 < differs
    unseen = quality.fit([(k % 2, *row(t, len(t))) for k, t in enumerate(texts)])
    assert len(set(unseen.score([row(texts[0], n) for n in (len(texts[0]), 1, None)]).tolist())) == 1
