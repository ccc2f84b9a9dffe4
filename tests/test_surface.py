"""Meshes, geodesics and patches against NumPy restatements."""

import heapq
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetry.functions.chem import shape_index
from facetry.models.pooling import DescriptorWeights, PolarGrid, descriptors, patch_arrays, pool_patch, pool_relational
from facetry.operators import filters, geodesic, mesh, patch


def grid(spark, n, m, h=1.0, z=0.0, pid=0):
    v = [(pid, i * m + j, i * h, j * h, z) for i in range(n) for j in range(m)]
    f = []
    for i in range(n - 1):
        for j in range(m - 1):
            a = i * m + j
            f += [(a, a + m, a + 1), (a + 1, a + m, a + m + 1)]
    vd = spark.createDataFrame(v, "protein_id long, vix int, x double, y double, z double")
    fd = spark.createDataFrame([(pid, k, *t) for k, t in enumerate(f)], "protein_id long, fix int, v0 int, v1 int, v2 int")
    return vd, fd, np.array([r[2:] for r in v]), np.array(f)


def sphere(level=2):
    t = (1 + 5**0.5) / 2
    v = [(-1, t, 0), (1, t, 0), (-1, -t, 0), (1, -t, 0), (0, -1, t), (0, 1, t), (0, -1, -t), (0, 1, -t), (t, 0, -1), (t, 0, 1), (-t, 0, -1), (-t, 0, 1)]
    f = [(0, 11, 5), (0, 5, 1), (0, 1, 7), (0, 7, 10), (0, 10, 11), (1, 5, 9), (5, 11, 4), (11, 10, 2), (10, 7, 6), (7, 1, 8),
         (3, 9, 4), (3, 4, 2), (3, 2, 6), (3, 6, 8), (3, 8, 9), (4, 9, 5), (2, 4, 11), (6, 2, 10), (8, 6, 7), (9, 8, 1)]
    v = [np.array(p) / np.linalg.norm(p) for p in v]
    for _ in range(level):
        mid, out = {}, []

        def half(a, b):
            key = (min(a, b), max(a, b))
            if key not in mid:
                p = v[a] + v[b]
                v.append(p / np.linalg.norm(p))
                mid[key] = len(v) - 1
            return mid[key]

        for a, b, c in f:
            ab, bc, ca = half(a, b), half(b, c), half(c, a)
            out += [(a, ab, ca), (b, bc, ab), (c, ca, bc), (ab, bc, ca)]
        f = out
    return np.array(v), f


def dijkstra(pts, faces, cutoff):
    adj = {i: {} for i in range(len(pts))}
    for t in faces:
        for a in t:
            for b in t:
                if a != b:
                    adj[a][b] = float(np.linalg.norm(pts[a] - pts[b]))
    out = {}
    for s in adj:
        dist, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for w, l in adj[u].items():
                if d + l <= cutoff and d + l < dist.get(w, np.inf):
                    dist[w] = d + l
                    heapq.heappush(heap, (d + l, w))
        out.update({(s, k): d for k, d in dist.items()})
    return out


@pytest.fixture(scope="module")
def sheet(spark):
    rng = np.random.default_rng(0)
    v, f, pts, faces = grid(spark, 8, 8)
    pts = pts + rng.normal(size=pts.shape) * 0.15
    v = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(pts)], v.schema)
    v = v.join(mesh.vertex_normals(v, f), ["protein_id", "vix"])
    geo = geodesic.geodesics(mesh.edges(v, f), 3.0, v.select("protein_id", F.col("vix").alias("src")))
    return v, f, pts, faces, geo


def test_geodesics(sheet):
    v, f, pts, faces, geo = sheet
    want = dijkstra(pts, faces, 3.0)
    got = {(r.src, r.v): r.d for r in geo.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
    assert all(abs(got[(b, a)] - d) < 1e-9 for (a, b), d in got.items())
    assert all(d <= got[(a, c)] + got[(c, b)] + 1e-9 for (a, b), d in list(got.items())[:300] for c in range(64) if (a, c) in got and (c, b) in got)


@pytest.mark.parametrize("extra", [0, -1])
def test_patch_limit_exact_and_one_more(sheet, extra):
    geo = sheet[4]
    full = geo.groupBy("src").count().agg(F.max("count")).first()[0]
    m = geodesic.patches(geo, full + extra)
    assert m.groupBy("center_vix").count().agg(F.max("count")).first()[0] == full + extra
    first = m.filter("pos = 0").toPandas()
    assert (first.center_vix == first.member_vix).all() and (first.rho == 1e-8).all()


def test_shrink(sheet):
    geo = sheet[4]
    got = geodesic.shrink_to_fit(geo, 3.0, 12).groupBy("src").agg(F.collect_set("v").alias("m")).toPandas().set_index("src").m
    for s, g in geo.toPandas().groupby("src"):
        r, d = 3.0, g[g.d > 0]
        keep = d[d.d < r]
        while len(keep) > 12:
            r *= 0.95
            keep = d[d.d < r]
        assert set(got.get(s, [])) == set(keep.v)


def test_sphere_normals_and_curvature(spark):
    p, f = sphere(2)
    p = p * 3.0
    v = spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(p)], "protein_id long, vix int, x double, y double, z double")
    # half of the faces is listed inside out on purpose: only the vote makes normals point outwards
    fd = spark.createDataFrame([(0, i, int(a), int(c), int(b)) for i, (a, b, c) in enumerate(f)], "protein_id long, fix int, v0 int, v1 int, v2 int")
    n = mesh.vertex_normals(v, fd)
    nn = n.toPandas().sort_values("vix")[["nx", "ny", "nz"]].values
    assert np.allclose((nn * p / 3).sum(1), 1, atol=1e-2)
    c = mesh.curvatures(v, fd, n).toPandas()
    assert abs(c.mean_curv.median() - 1 / 3) < 0.01 and np.allclose(c.mean_curv, 1 / 3, rtol=0.15)
    assert np.isclose((2 * math.pi - c.angle_sum).sum(), 4 * math.pi)
    s = spark.createDataFrame([(1.0, 1.0), (0.0, -1.0), (-1.0, 1.0 + 1e-6)], "h double, k double").select(shape_index(F.col("h"), F.col("k")).alias("s")).toPandas().s
    assert np.allclose(s, [1, 0, -1], atol=1e-2)


def test_facing_sheets(spark):
    gap = 1.0
    a, fa, *_ = grid(spark, 6, 6, pid=1)
    b, fb, *_ = grid(spark, 6, 6, z=gap, pid=2)
    up = lambda v, s: v.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(s)})
    v, f = up(a, 1.0).unionByName(up(b, -1.0)), fa.unionByName(fb)
    m = geodesic.patches(geodesic.geodesics(mesh.edges(v, f), 3.0), 200)
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, p1 long, p2 long")
    r = patch.shape_complementarity(pairs, m, v, radius=3.0).toPandas()
    filled = r[r.q50 != 0]
    assert len(r) == 2 * 36 * 10 and np.allclose(filled.q25, math.exp(-0.25 * gap * gap)) and len(filled) < len(r)


def test_last_writer_wins(spark):
    v = spark.createDataFrame(
        [(1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 1, 0.4, 0.0, 0.0, 1.0, 0.0, 0.0), (2, 0, 0.1, 0.0, 0.5, 0.0, 0.0, -1.0)],
        "protein_id long, vix int, x double, y double, z double, nx double, ny double, nz double",
    )
    m = spark.createDataFrame([(1, 0, 0, 0, 1e-8), (1, 1, 0, 1, 1e-8), (2, 0, 0, 0, 1e-8)], "protein_id long, center_vix int, pos int, member_vix int, rho double")
    r = patch.shape_complementarity(spark.createDataFrame([(7, 1, 2)], "pair_id long, p1 long, p2 long"), m, v).filter("side = 2 and ring = 0").toPandas()
    # the second vertex of partner 1 is perpendicular to partner 2 and writes last
    assert np.allclose(r.q50, 0.0)


def test_ring_percentiles_edges(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (0, 0.05, 2.0), (0, 0.5, 8.0), (0, 0.95, 4.0), (0, 1.0, 9.0)], "c int, rho double, v double")
    got = patch.ring_percentiles(df, ["c"], "rho", "v", 1.0).toPandas().set_index("ring")
    assert got.q25[0] == 1.25 and got.q50[5] == 8.0 and got.q50[9] == 4.0 and got.q50[1] == 0.0 and len(got) == 10
    old = patch.ring_percentiles(df, ["c"], "rho", "v", 1.0, strict_compat=True).toPandas().set_index("ring")
    assert old.q50[9] == 0.0 and old.q50[5] == 8.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0, 1.0, 0.7), (0, 8.999, -0.7), (0, 9.0, 0.0), (0, 0.99, 0.0), (0, 2.0, 0.71), (1, 0.1, 0.0)], "c int, rho double, ddc double")
    got = patch.curvature_histogram(df, ["c"]).toPandas().set_index("c")["hist"]
    h = np.array(got[0])
    assert np.isclose(np.linalg.norm(h), 1) and h[14] > 0 and h[45] > 0 and (h > 0).sum() == 2 and got[1] is None


def test_clean(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0), (0, 3, 1.0002, 0.0, 0.0), (0, 4, 9.0, 9.0, 9.0)], "protein_id long, vix int, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 2, 0, 3), (0, 2, 1, 3, 2)], "protein_id long, fix int, v0 int, v1 int, v2 int")
    kv, kf = mesh.clean(v, f)
    assert [tuple(r) for r in kf.collect()] == [(0, 0, 0, 1, 2)] and sorted(r.vix for r in kv.collect()) == [0, 1, 2]


def test_polar_angles_on_a_plane(spark):
    v, f, pts, _ = grid(spark, 9, 9)
    v = v.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    geo = geodesic.geodesics(mesh.edges(v, f), 4.0)
    m = geodesic.patches(geo, 200)
    t = geodesic.polar_angles(m, v, mesh.edges(v, f), 4.0).filter("center_vix = 40").toPandas()
    inner = t[(t.rho < 2.0) & (t.rho > 1e-6)]
    d = pts[inner.member_vix] - pts[40]
    ref = pts[int(inner.sort_values("pos").iloc[0].member_vix)] - pts[40]
    want = np.mod(np.arctan2(d[:, 1], d[:, 0]) - math.atan2(ref[1], ref[0]), 2 * math.pi)
    assert np.allclose(np.cos(inner.theta - want), 1, atol=1e-9) and len(t) == m.filter("center_vix = 40").count()


def test_pooling_forms_agree(spark, sheet):
    rng = np.random.default_rng(4)
    rows = [(0, c, i, float(rng.random() * 3), float(rng.random() * 6.28), float(rng.normal()), float(rng.normal())) for c in range(3) for i in range(6)]
    m = spark.createDataFrame(rows, "protein_id long, center_vix int, pos int, rho double, theta double, a double, b double")
    g = PolarGrid(n_rho=2, n_theta=3, n_rotations=4, max_rho=3.0)
    rel = pool_relational(m, ["a", "b"], g).toPandas()
    for r in patch_arrays(m, ["a", "b"]).collect():
        p = pool_patch(np.array(r.rho), np.array(r.theta), np.array([r.a, r.b]), g)
        sub = rel[rel.center_vix == r.center_vix]
        for _, x in sub.iterrows():
            assert abs(p[x.rotation, "ab".index(x.channel), x.cell] - x.value) < 1e-12
    w = DescriptorWeights.seeded(2, g.size)
    s = descriptors(m, w, g, ("a", "b"))
    # a turned patch by one rotation step has the same fingerprint
    turned = m.withColumn("theta", F.pmod(F.col("theta") + 2 * math.pi / 4, F.lit(2 * math.pi)))
    t = descriptors(turned, w, g, ("a", "b"))
    a, b = (np.stack(d.toPandas().sort_values("vix").desc) for d in (s, t))
    assert np.allclose(a, b, atol=1e-5)
    assert not np.allclose(a, np.stack(descriptors(m, w, g, ("a", "b"), flipped=True).toPandas().sort_values("vix").desc))


def test_nan_patches_are_dropped(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 0, float("nan")), (0, 1, 1.0), (0, 2, None)], "protein_id long, center_vix int, f double")
    assert [r.center_vix for r in filters.usable_patches(m, ["protein_id", "center_vix"], ["f"]).collect()] == [1]
    ref = lambda c: F.struct(F.lit(0).cast("long").alias("protein_id"), F.col(c).cast("int").alias("center_vix"))
    pairs = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 1)], "a int, b int, c int")
    pairs = pairs.select(ref("a").alias("binder"), ref("b").alias("pos"), ref("c").alias("neg"))
    assert filters.usable_pairs(pairs, m, ["protein_id", "center_vix"], ["f"], ["binder", "pos", "neg"]).count() == 1


def test_penalised_sites(spark):
    m = spark.createDataFrame([(0, c, c + d) for c in range(5) for d in (0, 1)], "protein_id long, center_vix int, member_vix int")
    s = spark.createDataFrame([(0, i, x) for i, x in enumerate([0.1, 0.9, 1.0, 0.8, 0.2, 0.7])], "protein_id long, vix int, score double")
    plain = geodesic.top_sites(geodesic.patch_mean(m, s), 2).toPandas()
    assert list(plain.sort_values("site_ix").center_vix) == [1, 2]
    # halving the first patch leaves patch 2 at 0.65, still first of the rest
    assert [r.center_vix for r in geodesic.penalised_sites(m, s, 2).orderBy("site_ix").collect()] == [1, 2]


def test_surface_job_sends_no_table_through_the_driver(spark, sf, monkeypatch):
    """Both sides of its joins grow with the surfaces, so none is broadcast, however small its compressed files are."""
    import contextlib
    import io

    from facetry.catalog import QUERIES, surface
    from facetry.operators import geodesic
    from facetry.plans import preprocess
    from facetry.session import materialize

    plans = io.StringIO()

    def seen(df):
        with contextlib.redirect_stdout(plans):
            df.explain()
        return materialize(df)

    for module in (geodesic, preprocess):
        monkeypatch.setattr(module, "materialize", seen)
    monkeypatch.setattr("facetry.catalog.models.materialize", seen)
    seen(QUERIES["descriptor_model"](spark, sf))
    seen(geodesic.patch_mean(surface.members(spark, sf), surface.surface(spark, sf)[0]))
    assert "SortMergeJoin" in plans.getvalue() and "Broadcast" not in plans.getvalue()
