import zlib
from collections import Counter

from cadenza.llm import sharding


def test_mixture_slots_and_digests(spark):
    rows = [(k, f"text {k} é", "hot" if k % 3 else f"s{k % 7}") for k in range(997)]
    out = sharding.interleaved_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=40).collect()
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    total, part = Counter(r["stratum"] for r in out), Counter((r["shard"], r["stratum"]) for r in out)
    for s in sizes:
        for x, n in total.items():
            assert abs(part[s, x] - n / 40) <= 1 + len(total) / 2
    for r in out:
        raw = f"text {r['doc_id']} é".encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


def test_odd_rows(odd_docs, no_docs):
    out = sharding.interleaved_shards(odd_docs, shards=3).collect()
    assert len(out) == 10 and sorted(Counter(r["shard"] for r in out).values()) == [3, 3, 4]
    assert {r["size"] for r in out if r["doc_id"] in (2, 3)} == {16} and {r["text_crc32"] for r in out if r["doc_id"] == 2} == {0}
    assert "null" in {r["stratum"] for r in out}
    assert sharding.interleaved_shards(no_docs).count() == 0
    assert sorted(r["shard"] for r in sharding.interleaved_shards(odd_docs, shards=40).collect()) == sorted({p * 40 // 10 for p in range(10)})


def test_order_of_rows_does_not_matter(odd_docs):
    again = odd_docs.orderBy("n_chars", "doc_id").repartition(3)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(sharding.interleaved_shards(odd_docs, shards=4)) == key(sharding.interleaved_shards(again, shards=4))


def test_written_shards(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs, str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 10 and Counter(r["shard"] for r in back.collect()) == Counter(r["shard"] for r in sharding.interleaved_shards(odd_docs, shards=3).collect())
