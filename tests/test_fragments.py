import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import components, contact, fragments, mesh
from facetry.sinks.tables import positional_join, write_bucketed


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    path = [(i, i + 1) for i in range(1000, 1060)]
    star = [(2000, 2000 + i) for i in range(1, 300)]
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + path + star + [(5, 5), (None, 3), (777, 777)]
    edges = edges + edges[:20] + [(b, a) for a, b in edges[10:40]]
    rng.shuffle(edges)
    got = components.connected(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == brute_components(edges) and len(got) == len({r["node"] for r in got})
    assert components.connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_stay_within_their_group(spark):
    e = spark.createDataFrame([("p", 1, 2), ("p", 2, 3), ("q", 3, 4), ("q", 2, 9)], "g string, a long, b long")
    got = {(r["g"], r["node"]): r["component"] for r in components.connected(e, "a", "b", ["g"]).collect()}
    assert got == {("p", 1): 1, ("p", 2): 1, ("p", 3): 1, ("q", 3): 3, ("q", 4): 3, ("q", 2): 2, ("q", 9): 2}


@pytest.mark.parametrize("size", [1, 5, 12])
def test_rmsd_pairs_against_brute_force(spark, size):
    rng = np.random.default_rng(size)
    base = rng.normal(0, 4, (15, size, 3))
    frags = np.concatenate([base + rng.normal(0, s, base.shape) for s in (0, 0.2, 0.5, 1.0)] + [base[:3]])
    rows = [(i, f.ravel().tolist()) for i, f in enumerate(frags)]
    v = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    classes = fragments.fragment_classes(v, "id")
    pairs = fragments.rmsd_pairs(classes, 1.3, size)
    got = {(r["class_id"], r["n_class_id"]): r["rmsd"] for r in pairs.collect()}
    n = 60  # the last three are copies of the first three
    d = np.sqrt(((frags[:, None] - frags[None]) ** 2).sum((2, 3)) / size)
    want = {(i, j): d[i, j] for i in range(n) for j in range(i + 1, n) if d[i, j] <= 1.3}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want
    roots = brute_components(list(want))
    clusters = {r["id"]: (r["class_id"], r["cluster_id"]) for r in fragments.rmsd_clusters(v, classes, pairs, "id").collect()}
    own = lambda i: i - 60 if i >= n else i
    assert clusters == {i: (own(i), roots.get(own(i), own(i))) for i in range(63)}


def test_fragments_need_every_position(spark):
    atoms = [("a", r, "CA", float(r), 0.0, 0.0) for r in range(6)] + [("b", r, "CA", float(r), 5.0, 0.0) for r in range(3)]
    atoms += [("c", r, "CB" if r == 1 else "CA", float(r), 9.0, 0.0) for r in range(4)]
    a = spark.createDataFrame(atoms, "f string, resid long, atom string, x double, y double, z double")
    dots = spark.createDataFrame([(1, 4.0, 0.5, 0.0)], "dot long, x double, y double, z double")
    got = fragments.touching_fragments(a, dots, "dot", "f", size=4, reach=1.2).collect()
    assert sorted((r["f"], r["pos"], r["x"]) for r in got) == [("a", i, i + 2.0) for i in range(4)]
    v = fragments.fragment_vectors(spark.createDataFrame([("n", 0, None, 0.0, 0.0), ("o", 0, 1.0, 2.0, float("nan")), ("p", 0, 1.0, 2.0, 3.0)], "f string, pos int, x double, y double, z double"), "f", 1)
    assert [tuple(r) for r in v.collect()] == [("p", [1.0, 2.0, 3.0])]
    assert fragments.touching_fragments(a.limit(0), dots, "dot", "f", 4).count() == 0


def test_vertices_on_both_sides_of_a_raster_line_merge(spark):
    xs = [0.00049, 0.00051, 0.0014, 0.0030, 0.0030]
    v = spark.createDataFrame([("p", i, x, 0.0, 0.0) for i, x in enumerate(xs)] + [("p", 9, None, 0.0, 0.0)], "protein_id string, vix int, x double, y double, z double")
    got = {r["vix"]: r["_keep"] for r in mesh.merged(v, 0.001).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_exposed_area_against_brute_force(spark):
    rng = np.random.default_rng(3)
    p, r = rng.normal(0, 3, (80, 3)), rng.uniform(0.8, 2.0, 80)  # as many radii as atoms
    p[1], r[1] = p[0], r[0]
    a = spark.createDataFrame([("s", i, *map(float, q), float(t)) for i, (q, t) in enumerate(zip(p, r))], "s string, serial long, x double, y double, z double, r double")
    got = {x["serial"]: x["area"] for x in contact.exposed_area(a.repartition(4), ["s"], "serial", "r", n_points=100, on=["s"]).collect()}
    big, d = r + 1.4, np.array(contact.sphere_points(100))
    for i in range(80):
        pts = p[i] + big[i] * d
        far = ((pts[:, None] - p[None]) ** 2).sum(2) >= (big - 1e-9) ** 2
        far[:, i] = True
        assert abs(got[i] - far.all(1).sum() / 100 * 4 * np.pi * big[i] ** 2) < 1e-9


def test_positional_join_of_bucketed_tables_has_no_shuffle(spark, tmp_path):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 5).alias("protein_id"), F.col("id").alias("vix"), (F.col("id") * 2).alias("a"))
    write_bucketed(rows, "side_a", ["protein_id", "vix"], 4, sort_by=["protein_id", "vix"], path=str(tmp_path / "a"))
    write_bucketed(rows.select("protein_id", "vix", (F.col("a") + 1).alias("b")), "side_b", ["protein_id", "vix"], 4, sort_by=["protein_id", "vix"], path=str(tmp_path / "b"))
    out = positional_join(spark, ["side_a", "side_b"], ["protein_id", "vix"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert out.count() == 2000 and out.filter("b <> a + 1").count() == 0
    assert len(list((tmp_path / "a").glob("*.parquet"))) == 4
    for name in ("side_a", "side_b"):
        spark.sql(f"DROP TABLE {name}")
