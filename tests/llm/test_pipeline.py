import corpus_pipeline
import __spark_entry__ as entry
from cadenza.llm import decontaminate, minhash, simhash


def test_stages_keep_the_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, d)
        docs = docs.cache()
        seen[name] = docs.count()
        assert docs.columns[: len(columns)] == columns and (docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1)
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert seen["substring_dedup"] == seen["near_dedup"] < 200 and seen["decontamination"] == seen["sentencepiece"]
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert docs.where("n_ids != size(ids)").count() == 0


def groups(ids, pairs):
    """Least id of the component of every id."""
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def test_near_dedup_keeps_one_of_each_component(spark):
    """Against all pairs: fingerprints within three bits, or five-word Jaccard of 0.8."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bits = {k: simhash.fingerprint(t) for k, t in texts.items()}
    sets = {k: set(minhash.shingles(t).tolist()) for k, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]) > 0
    pairs = [(a, b) for a in texts for b in texts if a < b and (((bits[a] ^ bits[b]) & (1 << 64) - 1).bit_count() <= 3 or alike(a, b))]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(groups(texts, pairs).values()) and len(kept) < len(texts)


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    d = "/root/testdata/sf0.001"
    odd = odd_docs.withColumn("toxicity_score", odd_docs["source"]).repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, d)
        more = {"ids", "n_ids"} if name == "sentencepiece" else set()
        assert len(set(got.columns)) == len(got.columns) and set(got.columns) == {*odd.columns, *more}
        rows = got.collect()
        assert {r["a.b"] for r in rows} == {"dot"} and all(r["toxicity_score"] == r["source"] for r in rows)
        ids = [r["doc_id"] for r in rows]
        if name == "near_dedup":
            assert sorted(ids, key=str) == [1, 2, 5, 6, 7, None]
        elif name in ("decontamination", "sentencepiece"):
            assert len(ids) == 10
        assert stage(spark, no_docs, d).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
