"""Model-facing and end-to-end queries."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from facetry import fixtures
from facetry.align.superpose import place
from facetry.catalog.registry import DESIGNS, POINTS, query, r6
from facetry.catalog.search import random_poses
from facetry.catalog.surface import with_normals
from facetry.models.pooling import PolarGrid, DescriptorWeights, InterfaceWeights, descriptors, interface_scores
from facetry.models.scorer import HeuristicScorer, NetScorer, pooled_features
from facetry.models.training import fit_classifier, pocket_samples, sample_alignments
from facetry.operators import geodesic, mesh, ranking, select
from facetry.operators.sampling import hash_number
from facetry.operators.similar_text import closest_designs
from facetry.params import SearchParams
from facetry.plans import evaluation, search
from facetry.plans.preprocess import build_patches
from facetry.session import materialize

SMALL = PolarGrid(n_rho=2, n_theta=4, n_rotations=4, max_rho=2.6)
REACH = {"patch": (2.6, 24)}


def _patches(spark, sf):
    v, f = with_normals(spark, sf)
    return build_patches(materialize(v), f, REACH)["patch"]


@query("surface_features", "SELECT vec_id // 100 AS protein_id, count(*) AS centers, TRUE AS bounded FROM embeddings GROUP BY 1")
def surface_features(spark, sf):
    """The whole surface job: paths, patches, angles and five channels, all inside their ranges."""
    m = _patches(spark, sf)
    ok = F.col("si").between(-1, 1) & F.col("ddc").between(-0.7, 0.7) & F.col("charge").between(-1, 1) & F.col("theta").between(0, 6.2832)
    return m.groupBy("protein_id").agg(F.countDistinct("center_vix").alias("centers"), F.bool_and(ok).alias("bounded"))


@query("descriptor_model", "SELECT vec_id // 100 AS protein_id, count(*) AS vertices, 8 AS size FROM embeddings GROUP BY 1")
def descriptor_model(spark, sf):
    d = descriptors(_patches(spark, sf), DescriptorWeights.seeded(5, SMALL.size), SMALL)
    return d.groupBy("protein_id").agg(F.count("*").alias("vertices"), F.max(F.size("desc")).alias("size"))


@query("interface_model", "SELECT vec_id // 100 AS protein_id, count(*) AS vertices, TRUE AS valid FROM embeddings GROUP BY 1")
def interface_model(spark, sf):
    s = interface_scores(_patches(spark, sf), InterfaceWeights.seeded(3, 5, SMALL), SMALL)
    return s.groupBy("protein_id").agg(F.count("*").alias("vertices"), F.bool_and(F.col("score").between(0, 1)).alias("valid"))


# a small net with given weights over blocks of 20 vertices: every vertex is a centre, its block is its patch
NET = PolarGrid(n_rho=2, n_theta=3, n_rotations=2, max_rho=20.0)
NET_CHANNELS = ("charge", "hphob")


def _net() -> InterfaceWeights:
    w = InterfaceWeights.seeded(2, 2, NET, seed=5)
    steps = lambda a: a + np.linspace(-0.1, 0.1, a.size).reshape(a.shape)
    w.first = replace(w.first, conv_bias=steps(w.first.conv_bias), dense_bias=steps(w.first.dense_bias))
    (a, ab), (b, bb) = w.head
    return replace(w, mix_bias=steps(w.mix_bias), deep=[(m, steps(v)) for m, v in w.deep], head=[(a, steps(ab)), (b, steps(bb))])


def _weights(name: str, a: np.ndarray) -> str:
    """A weight array as a view: its indices i0, i1, ... and the weight w."""
    cols = ", ".join(f"i{k}" for k in range(a.ndim))
    return f"{name}({cols}, w) AS (VALUES " + ", ".join(f"({', '.join(map(str, i))}, {float(x)!r}::DOUBLE)" for i, x in np.ndenumerate(a)) + ")"


def _pool_sql(name: str, values: str) -> str:
    """Pooled values (c, f, r, cell, v) of the view ``values`` (c, rho, theta, f, x)."""
    g, eps = NET, NET.eps
    return f"""{name}t AS (SELECT c, rho, f, x, r, CASE WHEN theta + r * pi() >= 2 * pi() THEN theta + r * pi() - 2 * pi() ELSE theta + r * pi() END AS t FROM {values}, range({g.n_rotations}) q(r)),
{name}g AS (SELECT c, f, r, x, i * {g.n_theta} + j AS cell, exp(-((rho - {g.max_rho} * (i + 1) / {g.n_rho}) ** 2) / {g.sigma_rho**2 + eps}) * exp(-((t - 2 * pi() * j / {g.n_theta}) ** 2) / {g.sigma_theta**2 + eps}) AS gs
  FROM {name}t, range({g.n_rho}) a(i), range({g.n_theta}) b(j)),
{name} AS (SELECT c, f, r, cell, sum(gs * x) / (sum(gs) + {eps}) AS v FROM {name}g GROUP BY ALL)"""


def _net_sql() -> str:
    w = _net()
    parts = [
        _weights("conv", w.first.conv), _weights("convb", w.first.conv_bias), _weights("dense", w.first.dense), _weights("denseb", w.first.dense_bias),
        _weights("mix", w.mix), _weights("mixb", w.mix_bias), _weights("deep", w.deep[0][0]), _weights("deepb", w.deep[0][1]),
        _weights("ha", w.head[0][0]), _weights("hab", w.head[0][1]), _weights("hb", w.head[1][0]), _weights("hbb", w.head[1][1]),
        """mem AS (SELECT a.vix AS c, b.vix AS m, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS rho, CASE WHEN atan2(b.y-a.y, b.x-a.x) < 0 THEN atan2(b.y-a.y, b.x-a.x) + 2*pi() ELSE atan2(b.y-a.y, b.x-a.x) END AS theta, b.charge, b.hphob
  FROM pts a JOIN pts b ON a.vix // 20 = b.vix // 20),
in1 AS (SELECT c, rho, theta, 0 AS f, charge AS x FROM mem UNION ALL SELECT c, rho, theta, 1, hphob FROM mem)""",
        _pool_sql("p1", "in1"),
        f"""cv AS (SELECT c, f, r, i2 AS d, sum(v * w) AS s FROM p1 JOIN conv ON i0 = f AND i1 = cell GROUP BY ALL),
c1 AS (SELECT c, f, d, greatest(max(s) + any_value(w), 0) AS s FROM cv JOIN convb ON i0 = f AND i1 = d GROUP BY ALL),
d0 AS (SELECT c, i1 AS o, sum(s * w) AS s FROM c1 JOIN dense ON i0 = f * {NET.size} + d GROUP BY ALL),
d1 AS (SELECT c, o, s + w AS s FROM d0 JOIN denseb ON i0 = o)""",
    ]
    return "WITH " + POINTS + ",\n" + ",\n".join(parts)


_DEEP = f""",
m0 AS (SELECT c, i1 AS o, sum(greatest(s, 0) * w) AS s FROM d1 JOIN mix ON i0 = o GROUP BY ALL),
o1 AS (SELECT c, o, greatest(s + w, 0) AS s FROM m0 JOIN mixb ON i0 = o),
in2 AS (SELECT mem.c, rho, theta, o AS f, s AS x FROM mem JOIN o1 ON o1.c = mem.m),
{_pool_sql("p2", "in2")},
e0 AS (SELECT c, r, i1 AS o, sum(v * w) AS s FROM p2 JOIN deep ON i0 = f * {NET.size} + cell GROUP BY ALL),
e1 AS (SELECT c, o, greatest(max(s) + any_value(w), 0) AS s FROM e0 JOIN deepb ON i0 = o GROUP BY ALL),
o2 AS (SELECT c, o // {NET.size} AS f, avg(s) AS s FROM e1 GROUP BY ALL),
a0 AS (SELECT c, i1 AS o, sum(s * w) AS s FROM o2 JOIN ha ON i0 = f GROUP BY ALL),
a1 AS (SELECT c, o, greatest(s + w, 0) AS s FROM a0 JOIN hab ON i0 = o),
z AS (SELECT c, sum(s * w) AS s FROM a1 JOIN hb ON i0 = o AND i1 = 0 GROUP BY c)
SELECT c // 100 AS protein_id, c AS vix, round(1 / (1 + exp(-(s + w))), 6) AS score FROM z JOIN hbb ON i0 = 0"""


def _block_members(spark, sf):
    """Every vertex with the vertices of its block of 20, in polar coordinates around it."""
    p = fixtures.points(spark, sf).withColumn("b", F.expr("vix div 20"))
    c = p.select("b", F.expr("vix div 100").alias("protein_id"), F.col("vix").alias("center_vix"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    m = c.join(p.select("b", F.col("vix").alias("member_vix"), "x", "y", *NET_CHANNELS), "b")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    polar = [F.sqrt(dx * dx + dy * dy).alias("rho"), F.pmod(F.atan2(dy, dx), F.lit(2 * math.pi)).alias("theta")]
    return m.select("protein_id", "center_vix", "member_vix", (F.col("member_vix") % 20).cast("int").alias("pos"), *polar, *NET_CHANNELS)


@query("descriptor_values", _net_sql() + " SELECT c // 100 AS protein_id, c AS vix, o AS place, round(s, 4) + 0.0 AS value FROM d1")
def descriptor_values(spark, sf):
    """Fingerprints of every vertex, number by number."""
    d = descriptors(_block_members(spark, sf), _net().first, NET, NET_CHANNELS)
    d = d.select("protein_id", "vix", F.posexplode("desc").alias("place", "v"))
    return d.select("protein_id", "vix", "place", (F.round(F.col("v").cast("double"), 4) + 0.0).alias("value"))


@query("interface_values", _net_sql() + _DEEP)
def interface_values(spark, sf):
    """Interface scores of every vertex after a layer over the outputs of its neighbours."""
    s = interface_scores(materialize(_block_members(spark, sf)), _net(), NET, NET_CHANNELS)
    return s.select("protein_id", "vix", r6("score"))


def complexes(spark, sf) -> tuple[search.Surfaces, search.Surfaces]:
    """Database surfaces and, as targets, their mirror partners: same points, opposite normals, same fingerprints.

    The database side is turned and moved at random, so partners can only be found by search.
    """
    v, f = with_normals(spark, sf)
    v = materialize(v)
    geo = geodesic.geodesics(mesh.edges(v, f), 2.6, v.select("protein_id", F.col("vix").alias("src")))
    members = materialize(geodesic.patches(geo, 24))
    e = fixtures.table(spark, sf, "embeddings")
    key = [F.floor(F.col("vec_id") / 100).cast("bigint").alias("protein_id"), (F.col("vec_id") % 100).cast("int").alias("vix")]
    desc = e.select(*key, F.lit("straight").alias("variant"), "embedding").withColumnRenamed("embedding", "desc")
    scores = v.select("protein_id", "vix", "score")

    def atoms(vert, depth):
        return vert.select("protein_id", F.col("vix").alias("serial"), F.lit("CA").alias("atom"), F.lit("C").alias("element"), *[(F.col(c) - depth * F.col(f"n{c}")).alias(c) for c in "xyz"])

    cols = ["protein_id", "vix", "x", "y", "z", "nx", "ny", "nz"]
    moved = materialize(place(v.select(*cols), random_poses(v), ["protein_id"]))
    database = search.Surfaces(desc, scores, moved, members, atoms(moved, 3.0))
    back = v.select(*cols[:5], *[(-F.col(c)).alias(c) for c in cols[5:]])
    targets = search.Surfaces(desc.withColumn("variant", F.lit("flipped")), scores, back, members, atoms(back, 3.0))
    return database, targets


FIND = SearchParams(max_desc_dist=0.5, min_iface=0.0, min_score=0.0, sites=1, vote_rounds=64, refine_rounds=2, max_members=24)


@query("seed_search", "SELECT DISTINCT vec_id // 100 AS target, vec_id // 100 AS protein_id, 0 AS clashing_ca, TRUE AS tight FROM embeddings")
def seed_search(spark, sf):
    """Two-stage search: every target finds its own mirror partner and nothing else."""
    database, targets = complexes(spark, sf)
    h = search.search(database, targets, FIND)
    return h.select("target", "protein_id", F.col("clashing_ca").cast("int").alias("clashing_ca"), (F.col("fitness") > 0.9).alias("tight"))


@query("score_given_complex", "SELECT DISTINCT vec_id // 100 AS target, 0.0 AS center_distance, 0.0 AS descriptor_distance, 0.0 AS mean_patch_desc_dist FROM embeddings")
def score_given_complex(spark, sf):
    """Complexes scored where they stand: the mirror partner in place has distance 0 everywhere."""
    _, targets = complexes(spark, sf)
    t = targets
    binder = search.Surfaces(t.descriptors.withColumn("variant", F.lit("straight")), t.scores, t.vertices.withColumns({c: -F.col(c) for c in ("nx", "ny", "nz")}), t.members, t.atoms)
    p = FIND.overridden(outward_shift=0.0)
    sites = materialize(search.choose_sites(targets, p))
    pairs = sites.select("target", F.col("target").alias("protein_id")).distinct()
    s = search.score_complex(binder, targets, pairs, sites, p)
    return s.select("target", r6("center_distance"), r6("descriptor_distance"), r6("mean_patch_desc_dist"))


@query("docking_ranks", "SELECT count(DISTINCT vec_id // 100) AS total, count(DISTINCT vec_id // 100) AS top1, 0 AS failed, 10 AS k FROM embeddings")
def docking_ranks(spark, sf):
    """Docking benchmark: among the ten nearest fingerprints the true partner's pose ranks first."""
    database, targets = complexes(spark, sf)
    sites = materialize(search.choose_sites(targets, FIND))
    partners = sites.select("target", F.col("target").alias("partner")).distinct()
    cand = materialize(evaluation.training_candidates(database, targets, sites, 10))
    source = materialize(search.candidate_patches(database, cand, FIND))
    patch = materialize(search.site_patches(targets, sites, FIND))
    poses = search.find_poses(source, patch, FIND)
    scored = search.score_poses(source, patch, targets.atoms, poses, FIND, HeuristicScorer())
    scored = scored.join(partners, "target")
    ranks = ranking.best_positive_rank(scored, ["target"], "score", F.col("protein_id") == F.col("partner"))
    return ranking.topk_counters(ranks).select("total", "top1", F.col("failed").cast("int").alias("failed"), F.lit(10).alias("k"))


def _placed(spark, sf):
    """One row per placed point: each event type of a user is a pose, its events are the points."""
    e = fixtures.table(spark, sf, "events")
    u = lambda s: hash_number("event_id", seed=s) / F.lit(float(1 << 48))
    good = (hash_number("user_id", "event_type", seed=9) % 4 == 0).cast("int")
    p = e.select("user_id", "event_type", F.col("event_id").alias("vix"), good.alias("good"), u(1).alias("a"), u(2).alias("b"), u(3).alias("c"), u(4).alias("d"))
    near = F.when(F.col("good") == 1, F.col("a")).otherwise(F.col("a") * 4)
    p = p.withColumn("nn_dist", near).withColumn("f_dist", 1 / F.greatest("nn_dist", F.lit(0.5))).withColumn("f_desc", 1 / (0.4 + F.col("b") * (2 - F.col("good"))))
    return p.withColumn("f_normal", F.col("c") * 2 - 1 + F.col("good") * 0.5).withColumn("f_atom", 1 / (0.5 + F.col("d")))


@query("alignment_classifier_eval")
def alignment_classifier_eval(spark, sf):
    """Training and evaluation of the alignment classifier with a split by target."""
    keys = ["user_id", "event_type"]
    pts = _placed(spark, sf)
    x = pooled_features(pts, keys).join(pts.groupBy(*keys).agg(F.max("good").alias("good")), keys)
    x = x.withColumn("rmsd", F.when(F.col("good") == 1, 1.0).otherwise(F.lit(float("inf"))))
    x = materialize(x.withColumn("split", F.when(hash_number("user_id", seed=3) % 5 == 0, "test").otherwise("train")))
    train = sample_alignments(x.filter("split = 'train'"), "user_id", "event_type", n_pos=1, n_neg=2)
    inputs = [c for c in x.columns if c.startswith(("mean_", "sd_")) or c == "near_share"]
    scored = fit_classifier(train, inputs).transform(x).withColumn("p", vector_to_array("probability")[1])
    return ranking.auc(scored, ["split"], F.col("p"), F.col("rmsd") < 2.0).select("split", r6("auc"), "n_pos", "n_neg")


@query("alignment_net_scores", "SELECT user_id, event_type, TRUE AS valid FROM events GROUP BY ALL")
def alignment_net_scores(spark, sf):
    keys = ["user_id", "event_type"]
    s = NetScorer.seeded().score(_placed(spark, sf), keys)
    return s.select(*keys, F.col("score").between(0, 1).alias("valid"))


# a small point net over plain arithmetic of the events
POINT_NET = NetScorer(
    points=[(np.linspace(-0.9, 0.8, 12).reshape(4, 3), np.array([0.1, -0.2, 0.3]), np.array([1.1, 0.9, 1.2]), np.array([0.05, 0.1, -0.1])), (np.linspace(0.7, -0.6, 12).reshape(3, 4), np.array([0.2, 0.1, 0.0, 0.3]), np.ones(4), np.zeros(4))],
    dense=[(np.linspace(-8.0, 9.0, 12).reshape(4, 3), np.array([0.1, 0.0, -0.1]), None, None), (np.array([[-3.0, 4.0], [2.0, -1.0], [-2.0, 3.0]]), np.array([0.0, 0.2]), None, None)],
)
_EVENT_POINTS = "(event_id % 97) / 40.0 AS a, (event_id % 31) / 20.0 AS b, (event_id % 13) / 6.5 - 1 AS c, (event_id % 7) / 7.0 AS d"


def _layer(name: str, source: str, i: int, kind: str, last: bool = False) -> str:
    """View (k, p, o, s): one layer of ``source``, positive part unless it is the last."""
    value = "sum(s * m.w) + any_value(b.w)"
    if kind == "pw":
        value = f"({value}) * any_value(a.w) + any_value(h.w)"
    more = f"JOIN {kind}{i}a a ON a.i0 = m.i1 JOIN {kind}{i}h h ON h.i0 = m.i1 " if kind == "pw" else ""
    value = value if last else f"greatest({value}, 0)"
    return f"{name} AS (SELECT k, p, m.i1 AS o, {value} AS s FROM {source} JOIN {kind}{i} m ON m.i0 = o JOIN {kind}{i}b b ON b.i0 = m.i1 {more}GROUP BY k, p, m.i1)"


def _point_net_sql() -> str:
    n, parts = POINT_NET, []
    for i, (m, b, scale, shift) in enumerate(n.points):
        parts += [_weights(f"pw{i}", m), _weights(f"pw{i}b", b), _weights(f"pw{i}a", scale), _weights(f"pw{i}h", shift)]
    for i, (m, b, *_) in enumerate(n.dense):
        parts += [_weights(f"dw{i}", m), _weights(f"dw{i}b", b)]
    parts.append(f"""ev AS (SELECT user_id || '/' || event_type AS k, event_id AS p, {_EVENT_POINTS} FROM events),
q AS (SELECT k, p, 0 AS o, 1 / greatest(a, 0.5)::DOUBLE AS s FROM ev UNION ALL SELECT k, p, 1, 1 / (0.4 + b)::DOUBLE FROM ev UNION ALL SELECT k, p, 2, c::DOUBLE FROM ev UNION ALL SELECT k, p, 3, 1 / (0.5 + d)::DOUBLE FROM ev
  UNION ALL SELECT '', -1, o, 0.0 FROM range(4) t(o))""")
    last = "q"
    for i in range(len(n.points)):
        parts.append(_layer(f"q{i}", last, i, "pw"))
        last = f"q{i}"
    parts.append(f"""blank AS (SELECT o, s AS z FROM {last} WHERE p = -1), h AS (SELECT k, p, o, s, z FROM {last} JOIN blank USING (o) WHERE p <> -1),
tot AS (SELECT k, o, sum(s) + ({n.max_points} - count(*)) * any_value(z) AS t, count(*) AS n FROM h GROUP BY ALL),
r AS (SELECT k, -1 AS p, o, t / {n.max_points} AS s FROM tot UNION ALL SELECT k, p, o, (t - s + z) / {n.max_points} FROM h JOIN tot USING (k, o))""")
    last = "r"
    for i in range(len(n.dense)):
        parts.append(_layer(f"r{i}", last, i, "dw", i + 1 == len(n.dense)))
        last = f"r{i}"
    parts.append(f"sc AS (SELECT k, p, 1 / (1 + exp(sum(CASE o WHEN 0 THEN s ELSE -s END))) AS score FROM {last} GROUP BY k, p)")
    return "WITH " + ",\n".join(parts)


def _event_points(spark, sf):
    e = fixtures.table(spark, sf, "events").select(F.concat_ws("/", "user_id", "event_type").alias("k"), F.col("event_id").alias("vix"))
    part = lambda n, by: (F.col("vix") % n) / by
    return e.withColumns({"f_dist": 1 / F.greatest(part(97, 40.0), F.lit(0.5)), "f_desc": 1 / (0.4 + part(31, 20.0)), "f_normal": part(13, 6.5) - 1, "f_atom": 1 / (0.5 + part(7, 7.0))})


@query("alignment_net_values", _point_net_sql() + " SELECT k, round(score, 6) AS score FROM sc WHERE p = -1")
def alignment_net_values(spark, sf):
    """Scores of every pose of the point net, its events being the points."""
    return POINT_NET.score(_event_points(spark, sf), ["k"]).select("k", r6("score"))


@query(
    "point_importance_values",
    _point_net_sql() + """, df AS (SELECT a.k, a.p, a.score - b.score AS d, b.score AS base FROM sc a JOIN sc b ON a.k = b.k AND b.p = -1 WHERE a.p <> -1), mx AS (SELECT k, max(abs(d)) AS m FROM df GROUP BY k)
SELECT k, p AS vix, round(CASE WHEN base > 0.91 AND m > 0 THEN d / m ELSE 0 END, 4) + 0.0 AS importance FROM df JOIN mx USING (k)""",
)
def point_importance_values(spark, sf):
    """Change of the score when one point is blanked, as a share of the largest change of the pose."""
    out = POINT_NET.point_importance(_event_points(spark, sf), ["k"], cutoff=0.91)
    return out.select("k", "vix", (F.round("importance", 4) + 0.0).alias("importance"))


@query("pocket_sampling", """WITH p AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 32) SELECT user_id, s::INT AS sample, 32 AS points FROM p, range(1, 101) t(s)""")
def pocket_sampling(spark, sf):
    """A hundred random subsets of 32 points of every pocket that is large enough."""
    s = pocket_samples(fixtures.table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id")
    return s.groupBy("user_id", "sample").agg(F.count("*").cast("int").alias("points"))


@query("string_alignment_best_match", """WITH n AS (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS c, max(p_partkey) OVER (PARTITION BY p_name) AS a FROM part),
b AS (SELECT p_name, max(p_partkey) AS b FROM n WHERE p_partkey <> a GROUP BY p_name) SELECT p_partkey AS description, 1.0::DOUBLE AS similarity, CASE WHEN p_partkey = a THEN b ELSE a END AS closest FROM n JOIN b ON b.p_name = n.p_name WHERE c > 1""")
def string_alignment_best_match(spark, sf):
    """Closest other part by its name; a copy of the name is the best there can be."""
    p = fixtures.table(spark, sf, "part").select(F.col("p_partkey").alias("description"), F.col("p_name").alias("seq"))
    return closest_designs(p).filter("similarity = 1.0")


@query("redundancy_drop", "WITH " + DESIGNS + """, u AS (SELECT l_suppkey AS seed, l_partkey % 50 AS slot, min(-l_extendedprice/l_quantity) AS e FROM lineitem GROUP BY ALL),
d AS (SELECT seed || '_' || slot AS description, e AS nddg, seed || '_' || ((slot + 1) % 50) AS closest, (slot % 10) / 10.0 AS similarity FROM u),
l AS (SELECT CASE WHEN a.nddg <= b.nddg THEN b.description ELSE a.description END AS description FROM d a JOIN d b ON b.description = a.closest WHERE a.similarity > 0.7)
SELECT description, nddg FROM d WHERE description NOT IN (SELECT description FROM l)""")
def redundancy_drop(spark, sf):
    li = fixtures.table(spark, sf, "lineitem")
    u = li.groupBy(F.col("l_suppkey").alias("seed"), (F.col("l_partkey") % 50).alias("slot")).agg(F.min(-F.col("l_extendedprice") / F.col("l_quantity")).alias("nddg"))
    name = lambda s: F.concat_ws("_", F.col("seed").cast("string"), s.cast("string"))
    d = u.select(name(F.col("slot")).alias("description"), "nddg", name((F.col("slot") + 1) % 50).alias("closest"), ((F.col("slot") % 10) / 10.0).alias("similarity"))
    return select.drop_redundant(d).select("description", "nddg")
