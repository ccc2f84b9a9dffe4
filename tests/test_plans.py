"""End-to-end jobs on small complexes and the catalogue against SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.catalog import QUERIES, SQL
from facetry.catalog.models import FIND, complexes
from facetry.models.scorer import FEATURES, NetScorer
from facetry.models.training import first_points, pocket_predictions, sample_alignments
from facetry.operators.contact import best_of_both_directions, contact_share_by_state, hotspot_spans
from facetry.plans import evaluation, model_fit, search
from facetry.session import materialize

FAST = [
    "vector_threshold_match", "per_protein_match_lists", "vector_global_topk", "vector_rank_of_partner", "pivot_index_match", "patch_polar_angles", "distance_auc", "grid_pooling", "ball_filter", "radius_join",
    "nearest_neighbour", "contact_counts", "clash_gate", "rmsd_by_pair", "apply_rigid_transform", "mesh_edges", "submesh", "vertex_normals", "best_of_retries",
    "roc_auc_by_group", "roc_auc_global", "topk_counters", "recovery_curve", "confusion_matrix", "score_histogram", "quantile_cutoff_selection", "tiered_selection",
    "metric_left_joins", "pre_post_compare", "sliding_window_best_fragment", "run_detection", "run_detection_compat", "fragment_numbering", "trim_hotspots", "sample_per_group",
    "negative_pairs", "fraction_split", "hit_line_roundtrip", "props_json", "string_alignment_best_match", "redundancy_drop", "price_percentiles",
]


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _norm(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", FAST)
def test_catalog_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = [tuple(_norm(x[names.index(c)]) for c in cols) for x in res.fetchall()]
    # the two engines may hold the same number as int and float
    plain = lambda t: repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in t])
    assert sorted(map(plain, got)) == sorted(map(plain, want))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["target", "protein_id", "vix", "desc_dist", "rank"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_search_finds_the_mirror_partner(spark, sf):
    database, targets = complexes(spark, sf)
    area = targets.vertices.filter("x > 2 and x < 7 and y > 2 and y < 7")
    hits = materialize(search.search(database, targets, FIND.overridden(attempts=2, sites=2), area=area))
    rows = hits.collect()
    assert len(rows) >= 5 and all(r.target == r.protein_id for r in rows)
    assert all(r.clashing_ca == 0 and 0 < r.score < 1 and r.desc_dist < 1e-6 for r in rows)
    none = spark.createDataFrame([(999,)], "id long")
    sites = materialize(search.choose_sites(targets, FIND))
    assert search.first_stage(database, targets, sites, FIND, whitelist=none).count() == 0
    # atoms of the hit, put into the target frame, label the pose as right
    partners = sites.select("target", F.col("target").alias("partner"))
    wall = targets.atoms.select(F.col("protein_id").alias("target"), F.col("serial").alias("t_serial"), "x", "y", "z")
    lab = evaluation.label_poses(hits.select(*search.CANDIDATE, "pose"), database.atoms, wall, partners, 10.0).collect()
    assert all(np.isfinite(r.rmsd) for r in lab)
    other = partners.withColumn("partner", F.col("partner") + 1)
    assert all(r.rmsd == float("inf") for r in evaluation.label_poses(hits.select(*search.CANDIDATE, "pose"), database.atoms, wall, other, 10.0).collect())


def test_regions(spark, sf):
    _, targets = complexes(spark, sf)
    v = targets.vertices
    a = v.filter("vix = 44").withColumn("serial", F.lit(0)).withColumn("element", F.lit("C"))
    for kw in ({"atom": a}, {"residue": a}, {"point": (4.0, 4.0, 0.0)}):
        n = search.region(v, 2.0, **kw).groupBy("protein_id").count().toPandas()["count"]
        assert (n > 3).all() and (n < 20).all()
    assert search.region(v, 2.0, listed=v.select("protein_id", "vix").filter("vix < 3")).filter("vix > 2").count() == 0
    assert search.region(v, 2.0).count() == v.count()
    hydrogen = a.withColumn("element", F.lit("H"))
    assert search.region(v, 2.0, residue=hydrogen).count() == 0


def test_training_pairs(spark):
    pts = lambda pid, z: [(pid, i * 8 + j, float(i), float(j), z) for i in range(8) for j in range(8)]
    v = spark.createDataFrame(pts(1, 0.0) + pts(2, 0.5) + [(2, 100 + i, 50.0 + i, 0.0, 0.0) for i in range(80)], "protein_id long, vix int, x double, y double, z double")
    rings = spark.createDataFrame([(7, 1, i, r, 0.6 if i < 40 else 0.4, 0.7) for i in range(64) for r in range(10)], "pair_id long, side int, center_vix int, ring int, q25 double, q50 double")
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, p1 long, p2 long")
    t = evaluation.training_pairs(rings, pairs, v).toPandas()
    assert len(t) == 40 and (t.binder == t.positive).all() and t.negative.is_unique and t.split.nunique() == 1
    # partners of unselected vertices are fair negatives, those of selected ones are not
    assert (t.negative >= 40).all() and (t.negative < 64).any()


def test_sampling_alignments(spark):
    rows = [(0, i, 0.5 if i < 3 else float("inf")) for i in range(30)] + [(1, i, 9.0) for i in range(30)] + [(2, 0, 0.1), (2, 1, 5.0)]
    s = sample_alignments(spark.createDataFrame(rows, "target int, pose int, rmsd double"), "target", "pose", n_pos=1, n_neg=10).toPandas()
    assert set(s.target) == {0} and s.label.sum() == 1 and len(s) == 11 and s.groupby("label").weight.sum().round(9).eq(1).all()


def test_net_scorer_and_importance(spark):
    rng = np.random.default_rng(0)
    rows = [(k, i, *map(float, rng.random(4))) for k, n in ((0, 20), (1, 250)) for i in range(n)]
    f = spark.createDataFrame(rows, "k int, vix int, " + ", ".join(f"{n} double" for n in FEATURES))
    net = NetScorer.seeded()
    s = net.score(f, ["k"]).toPandas().set_index("k").score
    x = np.zeros((1, 200, 4))
    x[0, :20] = [r[2:] for r in rows[:20]]
    assert abs(s[0] - net._predict(x)[0]) < 1e-12 and s.between(0, 1).all()
    imp = net.point_importance(f, ["k"], cutoff=-1.0).toPandas()
    assert np.isclose(imp[imp.k == 0].importance.abs().max(), 1) and (imp[imp.k == 1].importance == 0).all()


def test_pocket_votes(spark):
    p = spark.createDataFrame([(0, 1, 0.2, 0.5), (0, 2, 0.5, 0.2), (1, 1, 0.1, 0.9)], "pocket int, sample int, a double, b double")
    assert {r.pocket: r.predicted for r in pocket_predictions(p, ["pocket"], ["a", "b"]).collect()} == {0: 0, 1: 1}
    q = spark.range(50).select(F.lit(0).alias("pocket"), "id")
    assert first_points(q, ["pocket"], "id").agg(F.max("id")).first()[0] == 31


def test_aligned_range_and_model_fit(spark):
    a = spark.createDataFrame([("x", "--ABC-D", "QQABCEF"), ("y", "AB--", "--CD")], "k string, test string, ref string")
    assert {r.k: (r["first"], r["last"]) for r in model_fit.aligned_range(a, ["k"]).collect()} == {"x": (2, 6), "y": (None, None)}
    assert [(r.test_ix, r.ref_ix) for r in model_fit.aligned_columns(a.filter("k = 'x'"), ["k"]).collect()] == [(0, 2), (1, 3), (2, 4), (3, 6)]
    with pytest.raises(Exception, match="differ in length"):
        model_fit.aligned_range(spark.createDataFrame([("z", "A", "AB")], a.schema), ["k"]).collect()
    rng = np.random.default_rng(0)
    p = rng.normal(size=(20, 3)) * 5
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    model = spark.createDataFrame([("c", i, " ", *map(float, x)) for i, x in enumerate(p @ q.T + 3)], "chain string, resid int, hetflag string, x double, y double, z double")
    struct = spark.createDataFrame([("c", 100 + i, *map(float, p[i])) for i in range(4, 15)], "chain string, resid int, x double, y double, z double")
    ranges = spark.createDataFrame([("c", 4, 14)], "chain string, first int, last int")
    fit = model_fit.fit_models(struct, model, ranges, ["chain"]).first()
    assert fit.rmsd < 1e-9 and fit.atoms == 11
    r = spark.createDataFrame([("c", 1, "ALA"), ("c", 2, "GLY"), ("c", 3, "HOH")], "chain string, resid int, resname string")
    assert model_fit.sequences(r, ["chain"]).first().sequence == "AG"
    hot = spark.createDataFrame([("c", 2)], "chain string, resid int")
    assert model_fit.masked_sequence(r, hot, ["chain"]).first().seq == "-G"


def test_contact_share_and_spans(spark):
    c = spark.createDataFrame([("d", 1), ("d", 1), ("d", 2)], "design string, resid int")
    sse = spark.createDataFrame([("d", 1, "E"), ("d", 2, "H")], "design string, resid int, state string")
    r = contact_share_by_state(c, sse, ["design"], ["design", "resid"]).first()
    assert (r.contacts, r.in_state) == (3, 2) and abs(r.ratio - 2 / 3) < 1e-12
    res = spark.createDataFrame([("s", 1, 10 + i, i) for i in range(8)], "seed string, fragment int, resid int, serial int")
    spots = spark.createDataFrame([("s", 1, [3, 5])], "seed string, fragment int, spots array<int>")
    assert sorted(x.resid for x in hotspot_spans(res, spots, ["seed", "fragment"]).collect()) == [12, 13, 14]
    b = spark.createDataFrame([(1.0, 2.0), (None, None)], "a double, b double").select(best_of_both_directions(F.col("a"), F.col("b")).alias("m"))
    assert [x.m for x in b.collect()] == [1.0, -1.0]


def test_net_scorer_takes_plain_rows(spark):
    """Poses of different sizes, many more than a step holds, as one row of numbers each."""
    rng = np.random.default_rng(3)
    rows = [(k, i, *map(float, rng.random(4))) for k in range(300) for i in range(1 + k % 5)]
    df = spark.createDataFrame(rows, "k long, vix long, " + ", ".join(f"{f} double" for f in FEATURES))
    net = NetScorer.seeded()
    assert dict(net._arrays(df, ["k"]).dtypes)["x"] == "array<double>"
    got = {r["k"]: r["score"] for r in net.score(df, ["k"]).collect()}
    for k in (0, 3, 7, 299):
        a = np.zeros((1, net.max_points, 4))
        mine = [r[2:] for r in rows if r[0] == k]
        a[0, : len(mine)] = mine
        assert abs(got[k] - net._predict(a)[0]) < 1e-9
