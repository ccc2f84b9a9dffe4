import random
from collections import Counter

import pytest

from facetry.llm.sharding import SHARDS, interleave, op3_sharding
from tests.llm import fixtures


@pytest.mark.parametrize("n", [1, 23, 500])
@pytest.mark.parametrize("bucket_rows", [7, 200_000])
def test_rows_law_and_mixture(spark, n, bucket_rows):
    rng = random.Random(n)
    sources = [rng.choice(["hot", "hot", "b", None, f"own{i}"]) for i in range(n)]
    df = fixtures.docs(spark, ["x"] * n, source=sources).select("doc_id", "source")
    out = interleave(df, ["doc_id"], "source", 5, bucket_rows=bucket_rows).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(n))
    per = Counter(r["shard"] for r in out)
    assert max(per.values()) - min([*per.values(), *([0] if len(per) < 5 else [])]) <= 1
    for s in per:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(per[s]))
    for source, total in Counter(sources).items():
        for s in per:
            got = sum(1 for r in out if r["shard"] == s and sources[r["doc_id"]] == source)
            assert abs(got - total / 5) <= 2


def test_same_result_for_any_bucket_size_and_partitioning(spark):
    df = fixtures.docs(spark, ["x"] * 300, source=[f"s{i % 4}" for i in range(300)]).select("doc_id", "source")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(interleave(df, ["doc_id"], "source", 7, bucket_rows=11)) == key(interleave(df.repartition(9), ["doc_id"], "source", 7, bucket_rows=11))


def test_nulls_repeats_and_empty(spark, tmp_path):
    df = fixtures.docs(spark, [None, "", "é", "é", "é"], ids=[None, 1, 2, 2, 2], source=[None, "a", "a", "a", "a"]).withColumnRenamed("n_chars", "size")
    got = op3_sharding(spark, fixtures.write(spark, tmp_path, documents=df)).collect()
    assert len(got) == 5 and len({(r["shard"], r["slot"]) for r in got}) == 5
    assert {(r["doc_id"], r["size"]) for r in got} == {(None, 8), (1, 8), (2, 10)}
    assert all(r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < SHARDS for r in got)
    empty = op3_sharding(spark, fixtures.write(spark, tmp_path / "e", documents=df.limit(0)))
    assert empty.count() == 0
