"""Fingerprint search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry import fixtures
from facetry.align.features import alignment_features, correspondence_scores, descriptor_score, fitness
from facetry.align.refine import refine
from facetry.align.superpose import place, superpose, vote_poses
from facetry.catalog.registry import POINTS, query, r6
from facetry.functions.geometry import apply_transform, rotation_from_uniforms, uniform_from_hash
from facetry.models.pooling import PolarGrid, pool_relational
from facetry.operators.mesh import vertex_normals
from facetry.operators.pivots import build_index, pivot_match
from facetry.operators.ranking import auc
from facetry.operators.scale import top_k
from facetry.operators.vector_search import match_lists, partner_ranks, rank_database, scan_counters, scan_distances, threshold_match
from facetry.session import materialize

MAX_DIST, MIN_SCORE = 1.3, 0.5


def site_targets(d: DataFrame, flip: bool = True) -> DataFrame:
    """Best-scoring vertex of every protein as search target, seen from the other side."""
    best = d.groupBy("protein_id").agg(F.max(F.struct("score", (-F.col("vix")).alias("n"), "desc")).alias("b"))
    desc = F.transform("b.desc", lambda v: -v) if flip else F.col("b.desc")
    return best.select(F.col("protein_id").alias("target"), (-F.col("b.n")).alias("t_vix"), desc.alias("t_desc"))


_SITES = """,
best AS (SELECT protein_id AS target, vix AS t_vix, descr FROM pts QUALIFY row_number() OVER (PARTITION BY protein_id ORDER BY score DESC, vix) = 1),
tgt AS (SELECT target, t_vix, list_transform(descr, lambda v: -v) AS t_desc FROM best)"""
_MATCH = (
    "WITH "
    + POINTS
    + _SITES
    + f""",
cand AS (SELECT target, protein_id, vix, list_distance(descr, t_desc) AS desc_dist, score FROM pts, tgt
  WHERE score > {MIN_SCORE} AND list_distance(descr, t_desc) < {MAX_DIST})"""
)


def matches(spark, sf) -> DataFrame:
    d = fixtures.descriptors(spark, sf)
    return threshold_match(d, site_targets(d), MAX_DIST, MIN_SCORE)


@query(
    "vector_threshold_match",
    _MATCH + " SELECT target, protein_id, vix, round(desc_dist, 6) AS desc_dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY target, protein_id ORDER BY desc_dist, vix) AS rank FROM cand) WHERE rank <= 3",
)
def vector_threshold_match(spark, sf):
    top = top_k(matches(spark, sf), ["target", "protein_id"], [F.col("desc_dist"), F.col("vix")], 3)
    return top.select("target", "protein_id", "vix", r6("desc_dist"), "rank")


@query(
    "per_protein_match_lists",
    _MATCH + " SELECT target, protein_id, 0 AS part, count(*) AS n, array_to_string(list(vix ORDER BY vix), ',') AS vix_list, round(min(desc_dist), 6) AS best FROM cand GROUP BY ALL",
)
def per_protein_match_lists(spark, sf):
    m = match_lists(matches(spark, sf), ["target", "protein_id"])
    text = F.array_join(F.transform("vix_list", lambda v: v.cast("string")), ",")
    return m.select("target", "protein_id", "part", F.size("vix_list").cast("bigint").alias("n"), text.alias("vix_list"), r6(F.array_min("dist_list"), "best"))


@query(
    "vector_global_topk",
    "WITH " + POINTS + _SITES + " SELECT target, protein_id, vix, round(d, 6) AS desc_dist, rank FROM (SELECT target, protein_id, vix, list_distance(descr, t_desc) AS d, row_number() OVER (PARTITION BY target ORDER BY list_distance(descr, t_desc), vix) AS rank FROM pts, tgt) WHERE rank <= 50",
)
def vector_global_topk(spark, sf):
    d = fixtures.descriptors(spark, sf)
    top = rank_database(d, site_targets(d), ["target"], 50, ["vix"])
    return top.select("target", "protein_id", "vix", r6("desc_dist"), "rank")


@query(
    "vector_rank_of_partner",
    "WITH " + POINTS + _SITES + """, m AS (SELECT target, protein_id = target AS pos, list_distance(p.descr, b.descr) AS d FROM pts p, best b WHERE vix <> t_vix),
bp AS (SELECT target, min(d) FILTER (pos) AS b FROM m GROUP BY target)
SELECT m.target, count(*) FILTER (NOT pos AND d < b) + 1 AS rank FROM m JOIN bp ON bp.target = m.target GROUP BY m.target""",
)
def vector_rank_of_partner(spark, sf):
    d = fixtures.descriptors(spark, sf)
    ranks = partner_ranks(d, site_targets(d, flip=False), ("protein_id", "target"), F.col("vix") == F.col("t_vix"))
    return ranks.select("target", "rank")


@query(
    "pivot_index_match",
    "WITH " + POINTS + f""" SELECT t.vix AS t_vix, p.protein_id, p.vix, round(list_distance(p.descr, t.descr), 6) AS desc_dist
FROM pts p, pts t WHERE t.vix % 20 = 0 AND p.score > {MIN_SCORE} AND list_distance(p.descr, t.descr) < {MAX_DIST}""",
)
def pivot_index_match(spark, sf):
    d = fixtures.descriptors(spark, sf)
    targets = d.filter(F.col("vix") % 20 == 0).select(F.col("vix").alias("t_vix"), F.col("desc").alias("t_desc"))
    return pivot_match(build_index(d), targets, MAX_DIST, MIN_SCORE).select("t_vix", "protein_id", "vix", r6("desc_dist"))


@query(
    "distance_auc",
    "WITH " + POINTS + _SITES + """, m AS (SELECT target, protein_id = target AS pos, list_distance(p.descr, b.descr) AS d FROM pts p, best b WHERE vix <> t_vix),
r AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY -d) + (count(*) OVER (PARTITION BY target, d) - 1) / 2.0 AS rk FROM m),
s AS (SELECT target, sum(rk) FILTER (pos) AS sr, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg FROM r GROUP BY target)
SELECT target, round((sr - n_pos*(n_pos+1)/2.0)/(n_pos*n_neg), 6) AS auc, n_pos, n_neg FROM s""",
)
def distance_auc(spark, sf):
    d = fixtures.descriptors(spark, sf)
    m = scan_distances(d, site_targets(d, flip=False)).filter(F.col("vix") != F.col("t_vix"))
    a = auc(m, ["target"], F.col("desc_dist"), F.col("protein_id") == F.col("target"), lower_is_better=True)
    return a.select("target", r6("auc"), "n_pos", "n_neg")


@query("scan_counters", "SELECT count(DISTINCT label) AS proteins, count(*) AS fragments FROM embeddings")
def scan_counters_query(spark, sf):
    return scan_counters(fixtures.descriptors(spark, sf))


# one placed patch per pair of neighbouring proteins: source 2i against target 2i+1
def _pairs(spark, sf):
    d = fixtures.descriptors(spark, sf).select("vix", "desc")
    p = fixtures.points(spark, sf).join(d, "vix")
    site = F.floor(F.col("protein_id") / 2).cast("int").alias("site")
    cols = ["vix", "x", "y", "z", "nx", "ny", "nz", "desc"]
    source = p.filter(F.col("protein_id") % 2 == 0).select(site, F.col("vix").alias("src_vix"), *cols[1:])
    target = p.filter(F.col("protein_id") % 2 == 1).select(site, *cols[:4], *[(-F.col(c)).alias(c) for c in cols[4:7]], "desc")
    return source, target


_PAIRS = """,
s AS (SELECT protein_id // 2 AS site, * FROM pts WHERE protein_id % 2 = 0),
t AS (SELECT protein_id // 2 AS site, * FROM pts WHERE protein_id % 2 = 1),
nn AS (SELECT s.site, s.vix AS src_vix, t.vix AS vix, sqrt((s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y)+(s.z-t.z)*(s.z-t.z)) AS nn_dist,
  list_distance(s.descr, t.descr) AS desc_dist, -(s.nx*t.nx+s.ny*t.ny+s.nz*t.nz) AS normal_dp
  FROM s JOIN t ON s.site = t.site QUALIFY row_number() OVER (PARTITION BY s.site, s.vix ORDER BY nn_dist, t.vix) = 1)"""


@query(
    "alignment_features",
    "WITH " + POINTS + _PAIRS + """, tc AS (SELECT protein_id // 2 AS site, x, y, z FROM pts WHERE protein_id % 2 = 1 AND vix % 4 <> 3),
ad AS (SELECT s.site, s.vix AS src_vix, min(sqrt((s.x-tc.x)*(s.x-tc.x)+(s.y-tc.y)*(s.y-tc.y)+(s.z-tc.z)*(s.z-tc.z))) AS atom_dist FROM s JOIN tc ON tc.site = s.site GROUP BY ALL)
SELECT nn.site, nn.src_vix, vix AS nn_vix, round(1/greatest(nn_dist, 0.5), 6) AS f_dist, round(1/greatest(desc_dist, 1e-6), 6) AS f_desc, round(normal_dp, 6) + 0.0 AS f_normal,
round(1/greatest(atom_dist, 0.25), 6) AS f_atom FROM nn JOIN ad ON ad.site = nn.site AND ad.src_vix = nn.src_vix""",
)
def alignment_features_query(spark, sf):
    source, target = _pairs(spark, sf)
    a = fixtures.atoms(spark, sf).filter((F.col("protein_id") % 2 == 1) & (F.col("element") != "H"))
    a = a.select(F.floor(F.col("protein_id") / 2).cast("int").alias("site"), F.col("vix").alias("serial"), "x", "y", "z")
    f = alignment_features(source, target, a, ["site"], ["site"])
    return f.select("site", "src_vix", F.col("n_vix").alias("nn_vix"), r6("f_dist"), r6("f_desc"), r6("f_normal"), r6("f_atom"))


@query(
    "descriptor_score",
    "WITH " + POINTS + _PAIRS + """ SELECT site, round(coalesce(sum(1/(greatest(desc_dist,1e-6)*greatest(desc_dist,1e-6))) FILTER (nn_dist < 1.5), 0), 6) AS desc_dist_score,
round(sum(1/(greatest(desc_dist,1e-6)*greatest(desc_dist,1e-6))) FILTER (nn_dist < 1.5) / nullif(count(*) FILTER (nn_dist < 1.5), 0), 6) AS mean_desc_dist_score, count(*) AS points FROM nn GROUP BY site""",
)
def descriptor_score_query(spark, sf):
    source, target = _pairs(spark, sf)
    s = descriptor_score(alignment_features(source, target, None, ["site"]), ["site"])
    return s.select("site", r6("desc_dist_score"), r6("mean_desc_dist_score"), "points")


@query(
    "desc_score_family",
    "WITH " + POINTS + _PAIRS + """, g AS (SELECT DISTINCT site, src_vix % 10 AS part FROM nn), c AS (SELECT *, src_vix % 10 AS part FROM nn WHERE nn_dist <= 2.0),
a AS (SELECT site, part, sum(1/(desc_dist*desc_dist)) AS score, count(*) AS inliers, avg(1/(desc_dist*desc_dist)) AS mean_score, sum(1/(desc_dist*desc_dist*desc_dist)) AS cube_score FROM c GROUP BY ALL)
SELECT g.site, g.part, round(coalesce(score, 1e-6), 6) AS score, coalesce(inliers, 0) AS inliers, round(coalesce(mean_score, 1e-6), 6) AS mean_score, round(coalesce(cube_score, 1e-9), 6) AS cube_score
FROM g LEFT JOIN a ON a.site = g.site AND a.part = g.part""",
)
def desc_score_family(spark, sf):
    source, target = _pairs(spark, sf)
    f = alignment_features(source, target, None, ["site"]).withColumn("part", F.col("src_vix") % 10)
    s = correspondence_scores(f.filter(F.col("nn_dist") <= 2.0), f, ["site", "part"])
    return s.select("site", "part", r6("score"), "inliers", r6("mean_score"), r6("cube_score"))


@query(
    "pose_fitness",
    "WITH " + POINTS + _PAIRS + " SELECT site, round((count(*) FILTER (nn_dist <= 1.5)) / count(*)::DOUBLE, 6) AS fitness, count(*) FILTER (nn_dist <= 1.5) AS inliers, round(sqrt(avg(nn_dist*nn_dist) FILTER (nn_dist <= 1.5)), 6) AS inlier_rmse FROM nn GROUP BY site",
)
def pose_fitness(spark, sf):
    source, target = _pairs(spark, sf)
    f = fitness(alignment_features(source, target, None, ["site"]), ["site"])
    return f.select("site", r6("fitness"), "inliers", r6("inlier_rmse"))


def random_poses(points: DataFrame) -> DataFrame:
    """A repeatable start pose per protein."""
    keys = points.select("protein_id").distinct()
    u = [uniform_from_hash("protein_id", seed=i) for i in range(3)]
    r = rotation_from_uniforms(*u)
    t = {c: uniform_from_hash("protein_id", seed=10 + i) * 20 - 10 for i, c in enumerate(("tx", "ty", "tz"))}
    return keys.withColumn("pose", F.struct(*[v.alias(k) for k, v in {**r, **t}.items()]))


@query(
    "superposition",
    "SELECT label AS protein_id, count(*) AS n, 0.0 AS rmsd, 1.0 AS determinant FROM embeddings GROUP BY label",
)
def superposition(spark, sf):
    """Every protein moved by a random pose and fitted back: the fit has to undo it."""
    p = fixtures.points(spark, sf).select("protein_id", "vix", "x", "y", "z")
    moved = place(p, random_poses(p), ["protein_id"], normals=False)
    both = moved.join(p.select("protein_id", "vix", *[F.col(c).alias(f"q{c}") for c in "xyz"]), ["protein_id", "vix"])
    fit = superpose(both, ["protein_id"])
    back = both.join(fit, "protein_id")
    x = apply_transform(("x", "y", "z"), "pose")
    sq = sum(F.pow(a - F.col(f"q{c}"), F.lit(2.0)) for a, c in zip(x, "xyz"))
    m = lambda i, j: F.col(f"pose.r{i}{j}")
    det = m(1, 1) * (m(2, 2) * m(3, 3) - m(2, 3) * m(3, 2)) - m(1, 2) * (m(2, 1) * m(3, 3) - m(2, 3) * m(3, 1)) + m(1, 3) * (m(2, 1) * m(3, 2) - m(2, 2) * m(3, 1))
    out = back.groupBy("protein_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(sq)).alias("rmsd"), F.max(det).alias("determinant"))
    return out.select("protein_id", "n", r6("rmsd"), r6("determinant"))


@query("vote_superpose_refine", "SELECT vec_id // 100 AS protein_id, TRUE AS recovered FROM embeddings GROUP BY 1")
def vote_superpose_refine(spark, sf):
    """Triplet voting and refinement find the pose that was applied to every surface patch."""
    v = fixtures.lattice_vertices(spark, sf).select("protein_id", "vix", "x", "y", "z")
    p = v.join(vertex_normals(v, fixtures.lattice_faces(v)), ["protein_id", "vix"]).withColumnRenamed("vix", "pos")
    moved = place(p, random_poses(p), ["protein_id"])
    q = p.select("protein_id", "pos", *[F.col(c).alias(f"q{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    start = materialize(vote_poses(moved.join(q, ["protein_id", "pos"]), ["protein_id"], rounds=64))
    end = refine(moved, p.withColumnRenamed("pos", "vix"), start, ["protein_id"], ["protein_id"], rounds=1)
    back = place(moved, end, ["protein_id"]).join(q, ["protein_id", "pos"])
    sq = sum(F.pow(F.col(c) - F.col(f"q{c}"), F.lit(2.0)) for c in "xyz")
    out = back.groupBy("protein_id").agg(F.sqrt(F.avg(sq)).alias("rmsd"))
    return out.select("protein_id", (F.col("rmsd") < 1e-6).alias("recovered"))


GRID = PolarGrid(n_rho=2, n_theta=3, n_rotations=2, max_rho=20.0)


@query(
    "grid_pooling",
    "WITH " + POINTS + """, mem AS (SELECT protein_id, vix % 5 AS center_vix, sqrt(x*x+y*y) AS rho, CASE WHEN atan2(y,x) < 0 THEN atan2(y,x) + 2*pi() ELSE atan2(y,x) END AS theta, charge, hphob FROM pts),
grid AS (SELECT i*3+j AS cell, 20.0*(i+1)/2 AS mr, 2*pi()*j/3 AS mt FROM range(2) a(i), range(3) b(j)),
turned AS (SELECT m.*, r AS rotation, CASE WHEN theta + r*pi() >= 2*pi() THEN theta + r*pi() - 2*pi() ELSE theta + r*pi() END AS t FROM mem m, range(2) q(r)),
g AS (SELECT protein_id, center_vix, rotation, cell, charge, hphob, exp(-((rho-mr)*(rho-mr))/(2.5*2.5+1e-5))*exp(-((t-mt)*(t-mt))/(1.0+1e-5)) AS w FROM turned, grid)
SELECT protein_id, center_vix, 'charge' AS channel, rotation, cell, round(sum(w*charge)/(sum(w)+1e-5), 6) + 0.0 AS value FROM g GROUP BY ALL
UNION ALL SELECT protein_id, center_vix, 'hphob', rotation, cell, round(sum(w*hphob)/(sum(w)+1e-5), 6) + 0.0 FROM g GROUP BY ALL""",
)
def grid_pooling(spark, sf):
    p = fixtures.points(spark, sf)
    m = p.select(
        "protein_id",
        (F.col("vix") % 5).alias("center_vix"),
        F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("rho"),
        F.pmod(F.atan2("y", "x"), F.lit(2 * 3.141592653589793)).alias("theta"),
        "charge",
        "hphob",
    )
    out = pool_relational(m, ["charge", "hphob"], GRID)
    return out.select("protein_id", "center_vix", "channel", F.col("rotation").cast("bigint").alias("rotation"), F.col("cell").cast("bigint").alias("cell"), r6("value"))
