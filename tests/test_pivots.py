"""Pivot index against the plain scan: same matches whatever the pivots, the size of the target set or the shape of the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import pivots
from facetry.operators.pivots import build_index, choose_pivots, measured_share, pivot_match


def frame(spark, x):
    return spark.createDataFrame([(i % 7, i, float(i % 10) / 10, [float(v) for v in row]) for i, row in enumerate(x)], "protein_id long, vix long, score double, desc array<double>")


def sites(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "target long, t_desc array<double>")


def unit(rng, n, dim=16, clusters=0, noise=0.1):
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + noise * x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(x, t, r, least):
    d = np.sqrt(((x[:, None] - t[None]) ** 2).sum(axis=2))
    return {(int(i), int(j)): d[i, j] for i, j in np.argwhere(d < r) if least is None or (i % 10) / 10 > least}


def found(df):
    rows = df.collect()
    out = {(r["vix"], r["target"]): r["desc_dist"] for r in rows}
    assert len(out) == len(rows) and all(r["protein_id"] == r["vix"] % 7 for r in rows)
    return out


@pytest.mark.parametrize("clusters", [0, 12])
@pytest.mark.parametrize("large", [False, True])
def test_equals_the_plain_scan_on_unit_vectors(spark, monkeypatch, clusters, large):
    if large:
        monkeypatch.setattr(pivots, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(pivots, "PART_ROWS", 100)
        monkeypatch.setattr(pivots, "COLUMNS", 8)
    rng = np.random.default_rng(clusters)
    x = unit(rng, 900, clusters=clusters)
    x[10:60] = x[10]
    t = np.vstack([unit(rng, 20), x[:15], -x[5:8]])
    index = build_index(frame(spark, x), n=8)
    assert index.rows.filter("size(pivot_dists) = 8").count() == 900
    for r, least in ((0.35, None), (0.9, 0.45), (1.3, None)):
        got, want = found(pivot_match(index, sites(spark, t), r, least)), brute(x, t, r, least)
        assert set(got) == set(want)
        assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_bounds_leave_few_pairs_where_data_has_structure(spark):
    rng = np.random.default_rng(3)
    x = unit(rng, 2_000, clusters=20, noise=0.05)
    index, t = build_index(frame(spark, x), n=16), sites(spark, x[::100])
    share = measured_share(index, t, 0.3)
    assert share["pairs"] == 2_000 * 20 and share["matched"] <= share["measured"] <= share["visited"] < 0.3
    assert share["matched"] == pytest.approx(len(brute(x, x[::100], 0.3, None)) / share["pairs"])
    wide = measured_share(index, t, 2.5)
    assert wide["measured"] == 1.0  # nothing can be left out when everything matches


def test_pivots_lie_apart_and_any_pivots_give_the_same(spark):
    rng = np.random.default_rng(4)
    x = unit(rng, 300, clusters=6, noise=0.01)
    db = frame(spark, x)
    six = choose_pivots(db, 6)
    apart = np.sqrt(((six[:, None] - six[None]) ** 2).sum(axis=2))[np.triu_indices(6, 1)]
    assert apart.min() > 0.3  # one of each cluster
    t = sites(spark, x[:9])
    want = found(pivot_match(build_index(db, pivots=six), t, 0.5))
    assert want == found(pivot_match(build_index(db, pivots=rng.normal(size=(3, 16))), t, 0.5)) == found(pivot_match(build_index(db, pivots=six[:1]), t, 0.5))


def test_nulls_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    x = unit(rng, 30)
    db = frame(spark, x).withColumn("desc", F.when(F.col("vix") != 3, F.col("desc")))
    t = sites(spark, x[:5]).withColumn("t_desc", F.when(F.col("target") != 1, F.col("t_desc")))
    got = found(pivot_match(build_index(db), t, 0.1))
    assert set(got) == {(0, 0), (2, 2), (4, 4)}
    assert pivot_match(build_index(db.limit(0)), t, 0.1).count() == 0
    assert pivot_match(build_index(db), t.limit(0), 0.1).collect() == []


def test_partner_ranks_count_what_is_nearer(spark, monkeypatch):
    from facetry.operators import vector_search

    rng = np.random.default_rng(6)
    x, t = unit(rng, 210), unit(rng, 9)
    x[5], x[12], x[20] = t[0], t[0], t[0]
    sites = spark.createDataFrame([(i, i, [float(v) for v in row]) for i, row in enumerate(t)], "target long, t_vix long, t_desc array<double>")
    d = np.sqrt(((x[:, None] - t[None]) ** 2).sum(axis=2))
    want = {}
    for j in range(9):
        mine = [i for i in range(210) if i % 7 == j and i != j]
        want[j] = 1 + sum(d[i, j] < d[mine, j].min() for i in range(210) if i % 7 != j and i != j) if mine else None
    assert want[7] is None and want[8] is None
    for size in (1 << 20, 0):
        monkeypatch.setattr(vector_search, "BROADCAST_BYTES", size)
        monkeypatch.setattr(vector_search, "SALT_TARGETS", 4)
        got = vector_search.partner_ranks(frame(spark, x), sites, ("protein_id", "target"), F.col("vix") == F.col("t_vix"))
        assert {r["target"]: r["rank"] for r in got.collect()} == want


def test_matches_leave_in_blocks(monkeypatch):
    """Where everything matches, no more than a block of pairs is held at a time."""
    monkeypatch.setattr(pivots, "ROWS", 40)
    monkeypatch.setattr(pivots, "COLUMNS", 30)
    monkeypatch.setattr(pivots, "EXACT", 7)
    rng = np.random.default_rng(8)
    x, t, p = unit(rng, 100), unit(rng, 70), unit(rng, 3)
    xp, tp = (pivots.distances(v, p) for v in (x, t))
    blocks = pivots._met(x, xp, t, tp, 2.5)
    assert iter(blocks) is blocks  # nothing is measured before it is asked for
    seen = set()
    for i, j, d, measured in blocks:
        assert len(i) == len(j) == len(d) <= measured <= 40 * 30
        assert np.allclose(d, np.sqrt(((x[i] - t[j]) ** 2).sum(axis=1)))
        seen |= set(zip(i.tolist(), j.tolist()))
    assert len(seen) == 100 * 70
