import numpy as np
import pytest

from facetry.llm.ann import nearest, op9_ann
from tests.llm import fixtures

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(ids, x, queries, k):
    x = np.asarray(x, dtype=np.float32).astype(float)
    out = {}
    for q in queries:
        score = x @ x[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))[:k]
        out[q] = [(ids[i], score[i]) for i in order]
    return out


def recall(spark, x, k=20, **how):
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, lambda i: i % 20 == 0, k=k, **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(ids, x, [i for i in ids if i % 20 == 0], k)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(found, found[1:]))
        x32 = np.asarray(x, dtype=np.float32).astype(float)
        assert all(abs(s - x32[q] @ x32[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("shape", ["spread", "clusters", "lengths"])
@pytest.mark.parametrize("array_rows", [20_000, 150])
def test_recall(spark, shape, array_rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32))
    if shape == "clusters":
        x = rng.normal(size=(15, 32))[rng.integers(0, 15, 1500)] + 0.15 * x
    if shape != "lengths":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x, array_rows=array_rows) >= 0.92


def test_driver_vectors(spark):
    got = op9_ann(spark, "/root/testdata/sf0.01").collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    want = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows], [r["vec_id"] for r in rows if r["vec_id"] % 20 == 0], 20)
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(found) == len(got) == sum(map(len, want.values()))
    assert len(found & {(q, v) for q, vs in want.items() for v, _ in vs}) / len(got) >= 0.92


def test_copies_ties_nulls_and_few_rows(spark, tmp_path):
    one, two, nan = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], float("nan")
    rows = [(i, one, 0) for i in range(60)] + [(100, two, 0), (None, one, 0), (101, None, 0), (102, [0.0] * 3, 0), (103, [nan, 1.0, 1.0], 0), (104, [None, 1.0, 1.0], 0), (105, [1.0], 0), (120, [0.5, -0.0, 0.0], 0), (120, [0.5, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "class")
    got = {}
    for r in op9_ann(spark, fixtures.write(spark, tmp_path, embeddings=df)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 100, 120}
    for q in (0, 20, 40):
        assert sorted(got[q]) == [(j + 1, i, 1.0) for j, i in enumerate([i for i in range(22) if i != q][:20])]
    few = spark.createDataFrame([(0, one, 0), (1, two, 0)], VECTORS)
    assert [tuple(r) for r in op9_ann(spark, fixtures.write(spark, tmp_path / "f", embeddings=few)).collect()] == [(0, 1, 1, 0.0)]
    assert op9_ann(spark, fixtures.write(spark, tmp_path / "e", embeddings=df.limit(0))).count() == 0


@pytest.mark.parametrize("array_rows", [20_000, 100])
def test_ties_between_different_vectors_go_to_smaller_ids(spark, array_rows):
    """Many different 0/1 vectors with one and the same inner product, ids dealt at random, some vectors with several ids."""
    rng = np.random.default_rng(8)
    x = (rng.random((1_200, 32)) < 0.4).astype(float)
    x[:, 0] = 1
    x[rng.integers(0, 1_200, 40)] = x[3]
    ids = rng.permutation(1_200).tolist()
    df = spark.createDataFrame([(i, row.tolist()) for i, row in zip(ids, x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, lambda i: i % 20 == 0, array_rows=array_rows, miss=1e-9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert {q: [(v, s) for _, v, s in sorted(rows)] for q, rows in got.items()} == want
