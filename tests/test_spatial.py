"""Spatial joins and alignment against brute force, also with copies and dense clusters."""

import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetry.align.refine import refine
from facetry.align.superpose import identity_pose, place, plane_step, superpose, vote_poses
from facetry.functions.chem import contact_radius
from facetry.functions.vector import vec_dist
from facetry.operators import contact, spatial
from facetry.operators.patch import interpolate
from facetry.operators.vector_search import match_lists, rank_database, threshold_match
from facetry.plans import search
from facetry.session import materialize


def cloud(rng, n, hot=0.35):
    p = rng.normal(size=(n, 3)) * 15
    h = int(n * hot)
    p[:h] = 4 + rng.normal(size=(h, 3)) * 0.01  # a third of all points in one spot
    p[: h // 3] = p[0]  # and copies
    return p


def frame(spark, p, name, **extra):
    return spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")).assign(**{name: np.arange(len(p))}, **extra))


@pytest.mark.parametrize("k,within,on", [(1, None, False), (4, None, True), (1, 1.5, True)])
def test_nearest(spark, k, within, on):
    rng = np.random.default_rng(k)
    a, b = cloud(rng, 260), cloud(rng, 300)
    ga, gb = rng.integers(0, 2, 260), rng.integers(0, 2, 300)
    q, t = frame(spark, a, "i", g=ga), frame(spark, b, "vix", g=gb)
    got = spatial.nearest(q, t, "vix", ["g"] if on else [], k, within, closed=False, leaf=16).toPandas()
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    if on:
        d = np.where(ga[:, None] == gb[None], d, np.inf)
    want = {}
    for i in range(len(a)):
        order = np.lexsort((np.arange(len(b)), d[i]))[:k]
        want[i] = [j for j in order if d[i, j] < (np.inf if within is None else within)]
    have = got.sort_values("n_rank").groupby("i").n_vix.apply(list).to_dict()
    assert have == {i: w for i, w in want.items() if w}


def test_farthest(spark):
    rng = np.random.default_rng(5)
    a, b = cloud(rng, 150), cloud(rng, 200)
    got = spatial.nearest(frame(spark, a, "i"), frame(spark, b, "vix"), "vix", farthest=True, leaf=16).toPandas().set_index("i")
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert np.allclose(got.n_dist.sort_index(), d.max(1))


def test_no_targets(spark):
    q, t = frame(spark, np.zeros((3, 3)), "i"), frame(spark, np.zeros((1, 3)), "vix").filter("vix > 5")
    assert spatial.nearest(q, t, "vix").count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(r=st.floats(0.5, 6.0), seed=st.integers(0, 99), closed=st.booleans())
def test_radius_pairs(spark, r, seed, closed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(80, 3)) * 5, np.round(rng.normal(size=(90, 3)) * 5)
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    got = spatial.radius_pairs(frame(spark, a, "i"), frame(spark, b, "j"), r, closed=closed).toPandas()
    assert set(zip(got.i, got.n_j)) == set(zip(*np.where(d <= r if closed else d < r)))


def test_radius_pairs_in_a_crowd(spark):
    rng = np.random.default_rng(6)
    a, b = cloud(rng, 300), cloud(rng, 320)
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    got = spatial.radius_pairs(frame(spark, a, "i"), frame(spark, b, "j"), 2.0, block=20).toPandas()
    assert len(got) == (d < 2.0).sum() and set(zip(got.i, got.n_j)) == set(zip(*np.where(d < 2.0)))


def test_cutoff_edges(spark):
    q, t = frame(spark, np.array([[0.0, 0, 0]]), "i"), frame(spark, np.array([[2.0, 0, 0]]), "vix")
    assert spatial.exists_within(q, t, "vix", 2.0, closed=True).count() == 1
    assert spatial.exists_within(q, t, "vix", 2.0, closed=False).count() == 0
    assert spatial.radius_pairs(q, t.withColumnRenamed("vix", "j"), 2.0).count() == 0


def test_interpolation_exact_hit(spark):
    known = frame(spark, np.array([[0.0, 0, 0], [1, 0, 0], [0, 2, 0], [0, 0, 3], [9, 9, 9]]), "vix", c=[5.0, 1.0, 2.0, 3.0, 7.0])
    q = frame(spark, np.array([[0.0, 0, 0], [0.5, 0, 0]]), "i")
    got = interpolate(q, known, "vix", ["c"]).toPandas().set_index("i").c
    d2 = np.array([0.25, 0.25, 4.25, 9.25])
    assert got[0] == 5.0 and np.isclose(got[1], (np.array([5, 1, 2, 3.0]) / d2).sum() / (1 / d2).sum())


def test_contacts_by_element(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(120, 3)) * 5, rng.normal(size=(120, 3)) * 5
    ea, eb = rng.choice(["H", "C", "N", "O", "S", "Zn"], 120), rng.choice(["H", "C", "N", "O", "S", "Zn"], 120)
    fa, fb = frame(spark, a, "i", element=ea, design=rng.integers(0, 5, 120)), frame(spark, b, "vix", element=eb)
    got = contact.contact_counts(fa, fb, ["design"], "i", "vix").toPandas().set_index("design").contacts
    rad = lambda e: np.array([{"H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}.get(x, 1.2) for x in e])
    hit = (np.linalg.norm(a[:, None] - b[None], axis=2) < rad(ea)[:, None] + rad(eb)[None] + 0.2).any(1)
    want = fa.toPandas().assign(h=hit).groupby("design").h.sum()
    assert (got.sort_index() == want).all()
    assert fa.select(contact_radius(F.col("element")).alias("r")).filter("r is null").count() == 0


def test_exposed_area_of_two_spheres(spark):
    p = np.array([[0.0, 0, 0], [3.0, 0, 0], [50.0, 0, 0]])
    a = frame(spark, p, "serial", r=[1.6, 1.6, 1.6], s=["c", "c", "c"])
    got = contact.exposed_area(a, ["s"], "serial", "r", n_points=400, on=["s"]).toPandas().set_index("serial").area
    full = 4 * np.pi * 9.0
    assert np.isclose(got[2], full)
    # a cap of height R - d/2 is hidden
    assert np.allclose(got[[0, 1]], full - 2 * np.pi * 3.0 * 1.5, rtol=0.02)


def rotation(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def test_superpose_and_vote_recover_the_pose(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(3):
        p, n = rng.normal(size=(40, 3)) * 6, rng.normal(size=(40, 3))
        n /= np.linalg.norm(n, axis=1)[:, None]
        r, t = rotation(rng), rng.normal(size=3) * 10
        q, m = p @ r.T + t, n @ r.T
        q[:10] += rng.normal(size=(10, 3)) * 8  # a quarter of the links is wrong
        rows += [(g, i, *p[i], *n[i], *q[i], *m[i], i < 10) for i in range(40)]
    cols = ["g", "pos", "x", "y", "z", "nx", "ny", "nz", "qx", "qy", "qz", "qnx", "qny", "qnz", "wrong"]
    df = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in row) for row in rows], cols)
    good = df.filter("not wrong")
    for poses in (superpose(good, ["g"]), vote_poses(df, ["g"], rounds=200)):
        back = place(good, poses, ["g"], normals=False)
        worst = back.select(F.max(sum(F.abs(F.col(c) - F.col(f"q{c}")) for c in "xyz"))).first()[0]
        assert worst < 1e-8
    v = vote_poses(df, ["g"], rounds=200).toPandas()
    assert (v.inliers >= 30).all() and (v.fitness <= 1).all()
    assert plane_step(good, ["g"]).count() == 3


@pytest.mark.parametrize("salted", [False, True])
def test_threshold_match(spark, monkeypatch, salted):
    from facetry.operators import vector_search

    if salted:
        monkeypatch.setattr(vector_search, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(vector_search, "SALT_TARGETS", 10)
    rng = np.random.default_rng(2)
    d, t = rng.normal(size=(200, 8)) * rng.uniform(0.2, 3, (200, 1)), rng.normal(size=(12, 8))
    s = rng.random(200)
    db = spark.createDataFrame([(i % 7, i, d[i].tolist(), float(s[i])) for i in range(200)], "protein_id long, vix long, desc array<double>, score double")
    tg = spark.createDataFrame([(i, t[i].tolist()) for i in range(12)], "target long, t_desc array<double>")
    got = threshold_match(db, tg, 2.5, 0.3, pivots=[None, [1.0] * 8])
    dist = np.linalg.norm(d[:, None] - t[None], axis=2)
    want = {(j, i) for i, j in zip(*np.where(dist < 2.5)) if s[i] > 0.3}
    assert set(got.select("target", "vix").toPandas().itertuples(index=False, name=None)) == want
    lists = match_lists(got, ["target", "protein_id"], per_row=3, segment_rows=20).toPandas()
    assert lists.vix_list.map(len).sum() == len(want) and lists.vix_list.map(len).max() <= 3
    top = rank_database(db, tg, ["target"], 5, ["vix"]).toPandas().sort_values(["target", "rank"])
    assert (top.vix.values.reshape(12, 5) == np.argsort(dist, axis=0)[:5].T).all()


def test_threshold_match_of_equal_lengths_in_blocks(spark):
    """Unit vectors, which no pivot tells apart: all pairs are measured, but far faster than one expression per pair."""
    rng = np.random.default_rng(6)
    d = rng.normal(size=(20_000, 64))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    t = d[::10] + rng.normal(size=(2000, 64)) * 0.02
    db = materialize(spark.createDataFrame([(i, d[i].tolist(), 1.0) for i in range(len(d))], "vix long, desc array<double>, score double").repartition(8))
    tg = materialize(spark.createDataFrame([(i, t[i].tolist()) for i in range(len(t))], "target long, t_desc array<double>"))
    write = lambda df: df.write.format("noop").mode("overwrite").save()
    one = lambda: write(db.filter("vix % 20 = 0").join(F.broadcast(tg)).filter(vec_dist("desc", "t_desc") < 0.5))
    some = lambda: write(threshold_match(db, tg, 0.5))
    seconds = {}
    for f in (some, one, some, one):  # each once before it counts
        start = time.perf_counter()
        f()
        seconds[f] = time.perf_counter() - start
    assert seconds[some] < 8 * seconds[one]  # of 20 times as many pairs
    got = threshold_match(db, tg, 0.5).toPandas()
    want = {(j, i): np.linalg.norm(d[i] - t[j]) for j in range(0, 2000, 50) for i in np.nonzero(((d - t[j]) ** 2).sum(1) < 0.25)[0]}
    mine = {(r.target, r.vix): r.desc_dist for r in got.itertuples() if r.target % 50 == 0}
    assert len(got) >= 2000 and set(mine) == set(want) and all(abs(mine[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("salted", [False, True])
def test_threshold_match_of_odd_vectors(spark, monkeypatch, salted):
    """Copies, ties with the limit, other lengths, missing vectors and numbers, empty ones."""
    from facetry.operators import vector_search

    if salted:
        monkeypatch.setattr(vector_search, "BROADCAST_BYTES", 0)
    nan = float("nan")
    vectors = [[0.0, 0.0], [0.0, 0.0], [0.3, 0.4], [0.0, 0.499999999], None, [0.0, None], [0.0], [], [nan, 0.0], [1e160, 0.0], [1e160, 0.0], [3.0, 4.0]]
    db = spark.createDataFrame([(i, v, None if i == 1 else 1.0) for i, v in enumerate(vectors)], "vix long, desc array<double>, score double")
    tg = spark.createDataFrame([(i if i else None, v) for i, v in enumerate(vectors) if i not in (9, 10)], "target long, t_desc array<double>")
    got = threshold_match(db, tg, 0.5)
    pairs = sorted((-1 if r["target"] is None else r["target"], r["vix"]) for r in got.collect())
    spots = [(-1, 0), (-1, 1), (-1, 3), (1, 0), (1, 1), (1, 3), (2, 2), (2, 3), (3, 0), (3, 1), (3, 2), (3, 3), (6, 6), (7, 7), (11, 11)]
    assert pairs == spots and {"vix", "score", "target", "desc_dist"} == set(got.columns)
    assert {r["vix"] for r in threshold_match(db, tg, 0.5, 0.0).collect()} == {0, 2, 3, 6, 7, 11}


def test_correspondences_of_odd_vectors(spark, monkeypatch):
    """Ties go to the first vertex, a missing distance comes first and NaN last, whatever part of a site a vertex falls into."""
    monkeypatch.setattr(search, "PART_ROWS", 4, raising=False)
    rng = np.random.default_rng(8)
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0, None], [1.0], [], [nan, 0.0], [1e160, 0.0], [0.0, 0.0], [0.0, 0.0], [3.0, 4.0], [inf, 0.0]]
    vectors = lambda n, some: [rng.integers(0, 3, 2).astype(float).tolist() for _ in range(n)] + some
    sites = {(0, 0): (vectors(20, odd), vectors(6, [])), (0, 1): (vectors(3, odd), [[nan, 0.0], [inf, 0.0], [5.0, 5.0]]), (1, 0): (vectors(3, odd), [[nan, 1.0], [inf, 2.0]]), (2, 0): (vectors(9, []), [[0.0, 1.0], None, [1.0], []]), (3, 0): (vectors(5, odd), [])}
    source = [(*k, i % 2, v, i, pos, float(i), d) for k, (a, _) in sites.items() for i, d in enumerate(a) for v in (0, 1) for pos in (i,)]
    target = [(*k, i, *map(float, rng.normal(size=6)), d) for k, (_, b) in sites.items() for i, d in reversed([*enumerate(b)])] + [(9, 0, 0, *[0.0] * 6, [0.0, 0.0])]
    s = spark.createDataFrame(source, "target long, site_ix int, protein_id long, vix int, member_vix int, pos int, x double, desc array<double>")
    t = spark.createDataFrame(target, "target long, site_ix int, vix int, x double, y double, z double, nx double, ny double, nz double, desc array<double>")
    links = search.descriptor_correspondences(s, t)
    columns = ["target", "site_ix", "vix", "member_vix", "dd", "q_vix", "qx", "qnz"]
    got = sorted(map(repr, links.select(columns).toPandas().itertuples(index=False, name=None)))
    least = F.min(F.struct(vec_dist("desc", "t_desc").alias("dd"), F.col("q_vix"), F.col("qx"), F.col("qnz"))).alias("b")
    pairs = s.join(t.select("target", "site_ix", F.col("vix").alias("q_vix"), F.col("x").alias("qx"), F.col("nz").alias("qnz"), F.col("desc").alias("t_desc")), ["target", "site_ix"])
    want = pairs.groupBy("target", "site_ix", "vix", "member_vix").agg(least).select("target", "site_ix", "vix", "member_vix", "b.*")
    assert len(got) == 2 * (30 + 13 + 13 + 9) and got == sorted(map(repr, want.select(columns).toPandas().itertuples(index=False, name=None)))


@pytest.mark.parametrize("kind", ["far", "two scales", "plane", "line"])
def test_cells_stay_small_whatever_the_spread(spark, kind):
    rng = np.random.default_rng(4)
    p = rng.normal(0, 1, (4000, 3))
    if kind == "far":
        p[0] = 1e9
    elif kind == "two scales":
        p[:2000] *= 1e-6
        p[5] = -1e12
    elif kind == "plane":
        p[:, 2] = 7.0
    else:
        p[:, 1:] = 0.0
        p[0, 0] = 1e9
    points = frame(spark, p, "i")
    n, spread = spatial._spread(points)
    depth = spatial._depth(points, [], n, spread, 64)
    most = spatial._placed(points, spread).groupBy(*spatial._code(depth)).count().agg(F.max("count")).first()[0]
    assert n == 4000 and depth < spatial.MAX_DEPTH and most <= 64
    q = np.concatenate([p[:30], rng.normal(0, 2, (30, 3)), [[1e8, 0, 0]]])
    got = {r["j"]: (r["n_i"], r["n_dist"]) for r in spatial.nearest(frame(spark, q, "j"), points, "i", leaf=64).collect()}
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(2))
    assert len(got) == len(q) and all(abs(got[j][1] - d[j].min()) <= 1e-9 * max(1, d[j].min()) for j in range(len(q)))


def test_refinement_never_loses_partners(spark):
    """Six nearly coplanar points hardly fix a step along their plane; the pose that they start with is nearly right."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        p = np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (2, 0, 0), (0, 2, 0)], dtype=float) + rng.normal(size=(6, 3)) * [0, 0, 0.05]
        n = np.c_[rng.normal(size=(6, 2)) * 0.05, np.ones(6)]
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        rows += [(g, i, *map(float, p[i]), *map(float, n[i])) for i in range(6)]
    t = spark.createDataFrame(rows, "g long, vix long, x double, y double, z double, nx double, ny double, nz double")
    s = t.withColumnRenamed("vix", "pos").withColumns({"x": F.col("x") + 0.06 * F.rand(1), "y": F.col("y") + 0.06 * F.rand(2), "z": F.col("z") + 0.06 * F.rand(3)})
    s = materialize(s)
    start = t.select("g").distinct().withColumn("pose", identity_pose())
    end = refine(s, t, start, ["g"], ["g"], rounds=2)
    held = spatial.nearest(place(s, end, ["g"], normals=False), t, "vix", ["g"], 1, 1.0).groupBy("g").agg(F.count("*").alias("n"), F.sum(F.pow("n_dist", F.lit(2.0))).alias("e")).toPandas()
    assert len(held) == 40 and (held.n == 6).all() and (held.e < 6 * 3 * 0.06**2).all()


def test_farthest_looks_at_few_cells(spark, monkeypatch):
    """The outermost points bound the answer from the start, so few of the cells are written for the next level."""
    rng = np.random.default_rng(12)
    p = rng.normal(size=(3000, 3)) * 10
    sizes, write = [], spatial.materialize

    def counted(df):
        out = write(df)
        if "_ub" in out.columns and "_cx" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(spatial, "materialize", counted)
    got = spatial.nearest(frame(spark, p, "own"), frame(spark, p, "serial"), "serial", leaf=16, farthest=True).toPandas().set_index("own").sort_index()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    assert np.allclose(got.n_dist, d.max(axis=1))
    assert sizes and max(sizes) < 12 * len(p), sizes


@pytest.mark.parametrize("large", [False, True])
def test_ranking_keeps_no_pair_beyond_k(spark, monkeypatch, large):
    """Ties go to the smaller ids over batches and parts, distances are those of the expression, and no task sorts all pairs."""
    from facetry.functions.vector import vec_dist
    from facetry.operators import vector_search

    if large:
        monkeypatch.setattr(vector_search, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(vector_search, "PART_ROWS", 100, raising=False)
        monkeypatch.setattr(vector_search, "SALT_TARGETS", 10)
    monkeypatch.setattr(vector_search, "PAIRS", 500, raising=False)
    seen, real = [], vector_search.top_k
    monkeypatch.setattr(vector_search, "top_k", lambda df, *a: seen.append(materialize(df)) or real(seen[-1], *a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    rng = np.random.default_rng(3)
    d, t = rng.normal(size=(1000, 6)).round(1), rng.normal(size=(20, 6)).round(1)
    d[::3] = d[0]  # a third are copies
    t[0] = d[0]
    rows = [(i // 100, f"v{i % 100:02d}", d[i].tolist()) for i in rng.permutation(1000).tolist()]
    db = spark.createDataFrame([*rows, (3, "null", None), (3, "hole", [None] * 6), (3, "short", [0.0])], "protein_id long, vix string, desc array<double>")
    tg = spark.createDataFrame([(i, t[i].tolist()) for i in range(20)], "target long, t_desc array<double>")
    try:
        got = rank_database(db, tg, ["target"], 7, ["protein_id", "vix"])
        assert got.columns == ["protein_id", "vix", "target", "desc_dist", "rank"]
        got = {(r.target, r["rank"]): (r.desc_dist, r.protein_id, r.vix) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = db.filter("vix not in ('null', 'hole', 'short')").join(tg).select("target", vec_dist("desc", "t_desc").alias("dist"), "protein_id", "vix").collect()
    want = {}
    for j in range(20):
        for k, r in enumerate(sorted((p.dist, p.protein_id, p.vix) for p in pairs if p.target == j)[:7]):
            want[j, k + 1] = r
    assert got == want
    assert seen[0].count() <= 20 * 7 * 18  # k per target of a batch (of 100 rows, in up to 8 tasks) or part, of 1000 rows
