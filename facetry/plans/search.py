"""Database search as one job over all targets, sites and proteins.

Tables of one side (``Surfaces``): descriptors(protein_id, vix, variant, desc, norm), scores(protein_id,
vix, score), vertices(protein_id, vix, x..z, nx..nz), members(protein_id, center_vix, member_vix, pos,
rho) and atoms(protein_id, serial, atom, element, x..z, resid, chain).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.align.features import alignment_features, descriptor_score, fitness
from facetry.align.refine import refine
from facetry.align.superpose import place, vote_poses
from facetry.functions.geometry import flip3, shift_outward
from facetry.functions.vector import as_double, vec_dist
from facetry.models.scorer import HeuristicScorer, Scorer
from facetry.operators.contact import clash_counts
from facetry.operators.filters import clash_ok, hit, not_hydrogen_name
from facetry.operators.geodesic import patch_mean, top_sites
from facetry.operators.select import best_attempt
from facetry.operators.spatial import ball, exists_within, nearest
from facetry.operators.vector_search import PART_ROWS, first_nearest, known, threshold_match
from facetry.params import SearchParams
from facetry.session import materialize

SITE = ["target", "site_ix"]
CANDIDATE = [*SITE, "protein_id", "vix"]


@dataclass
class Surfaces:
    descriptors: DataFrame
    scores: DataFrame
    vertices: DataFrame
    members: DataFrame
    atoms: DataFrame


def region(
    vertices: DataFrame,
    cutoff: float,
    point: tuple[float, float, float] | None = None,
    residue: DataFrame | None = None,
    atom: DataFrame | None = None,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Vertices a site may be chosen from. A list wins, then atom, residue, point; without any, the whole surface.

    ``residue``/``atom``: atom rows of the chosen place (hydrogens of a residue do not count).
    """
    if listed is not None:
        return vertices.join(listed, ["protein_id", "vix"], "left_semi")
    if atom is not None:
        return exists_within(vertices, atom, "serial", cutoff, ["protein_id"], closed=False)
    if residue is not None:
        return exists_within(vertices, residue.filter(F.col("element") != "H"), "serial", cutoff, ["protein_id"], closed=False)
    if point is not None:
        return ball(vertices, point, cutoff).drop("dist")
    return vertices


def choose_sites(targets: Surfaces, params: SearchParams, area: DataFrame | None = None) -> DataFrame:
    """Best patches of each target by mean interface score: target, site_ix, vix, mean_score."""
    members = targets.members
    if area is not None:
        members = members.join(area.select("protein_id", F.col("vix").alias("center_vix")), ["protein_id", "center_vix"], "left_semi")
    top = top_sites(patch_mean(members, targets.scores), params.sites)
    return top.select(F.col("protein_id").alias("target"), "site_ix", F.col("center_vix").alias("vix"), "mean_score")


def first_stage(database: Surfaces, targets: Surfaces, sites: DataFrame, params: SearchParams, whitelist: DataFrame | None = None) -> DataFrame:
    """Candidates: database vertices with a high interface score and a fingerprint close to a site's."""
    d = database.descriptors.filter(F.col("variant") == "straight").drop("variant")
    if whitelist is not None:
        d = d.join(whitelist.select(F.col("id").alias("protein_id")).distinct(), "protein_id", "left_semi")
    d = d.withColumn("desc", as_double("desc")).join(database.scores, ["protein_id", "vix"])
    t = targets.descriptors.filter(F.col("variant") == params.target_variant)
    t = sites.join(t.select(F.col("protein_id").alias("target"), "vix", as_double("desc").alias("t_desc")), ["target", "vix"])
    found = threshold_match(d, t.drop("vix", "mean_score"), params.max_desc_dist, params.min_iface)
    return found.select(*CANDIDATE, "desc_dist", F.col("score").alias("iface_score"))


def _patch_points(side: Surfaces, centers: DataFrame, keys: list[str], params: SearchParams, flip: bool, variant: str) -> DataFrame:
    """Points of the patches around ``centers`` (protein_id, center_vix + keys), shifted outwards."""
    m = side.members.filter(F.col("pos") < params.max_members).select("protein_id", "center_vix", "member_vix", "pos")
    d = side.descriptors.filter(F.col("variant") == variant).select("protein_id", F.col("vix").alias("member_vix"), as_double("desc").alias("desc"))
    v = side.vertices.select("protein_id", F.col("vix").alias("member_vix"), "x", "y", "z", "nx", "ny", "nz")
    p = centers.join(m, ["protein_id", "center_vix"]).join(v, ["protein_id", "member_vix"]).join(d, ["protein_id", "member_vix"])
    xyz = shift_outward(("x", "y", "z"), ("nx", "ny", "nz"), params.outward_shift)
    nrm = flip3(("nx", "ny", "nz")) if flip else tuple(F.col(c) for c in ("nx", "ny", "nz"))
    return p.select(*keys, "pos", "member_vix", *[c.alias(n) for n, c in zip(("x", "y", "z"), xyz)], *[c.alias(n) for n, c in zip(("nx", "ny", "nz"), nrm)], "desc")


def site_patches(targets: Surfaces, sites: DataFrame, params: SearchParams) -> DataFrame:
    c = sites.select(*SITE, F.col("target").alias("protein_id"), F.col("vix").alias("center_vix"))
    p = _patch_points(targets, c, SITE, params, params.flip_normals, params.target_variant)
    return p.drop("pos").withColumnRenamed("member_vix", "vix")


def candidate_patches(database: Surfaces, candidates: DataFrame, params: SearchParams) -> DataFrame:
    c = candidates.select(*CANDIDATE, F.col("vix").alias("center_vix"))
    return _patch_points(database, c, CANDIDATE, params, False, "straight")


def descriptor_correspondences(source: DataFrame, target: DataFrame) -> DataFrame:
    """Each source point with the target point of the most similar fingerprint.

    A vertex lies in many patches, so it is compared once per site; a site's patch is bounded, and at most about ``PART_ROWS`` vertices
    meet it at once.
    """
    key, coords = [*SITE, "protein_id", "member_vix"], ("x", "y", "z", "nx", "ny", "nz")
    got = ["q_vix", *[f"q{c}" for c in coords]]
    whole = lambda c: F.when(known(c), as_double(c)).alias("_v")
    parts = materialize(source.groupBy(*SITE).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts")))
    verts = source.select(*key, whole("desc")).dropDuplicates(key).join(parts, SITE)
    verts = verts.withColumn("_part", F.pmod(F.xxhash64("protein_id", "member_vix"), F.col("_parts")).cast("int")).drop("_parts")
    patch = target.select(*SITE, F.col("vix").alias("q_vix"), *[F.col(c).alias(f"q{c}") for c in coords], whole("desc"))
    patch = patch.join(parts, SITE).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, [(c, "ascending") for c in got], null_placement="at_start"))
        left = left if right.num_rows else left.slice(0, 0)
        best, dd = (np.zeros(0, int), np.zeros(0))
        if left.num_rows:
            best, dd = first_nearest(*(t["_v"].combine_chunks() for t in (left, right)))
        q = right.select(got).take(pa.array(best))
        return pa.Table.from_arrays([*left.select(key).columns, pa.array(dd, mask=dd < 0), *q.columns], names=[*key, "dd", *got])

    kind = T.StructType([*verts.select(*key).schema, T.StructField("dd", T.DoubleType()), *patch.select(*got).schema])
    links = verts.groupBy(*SITE, "_part").cogroup(patch.groupBy(*SITE, "_part")).applyInArrow(meet, kind)
    return source.join(links, key)


def find_poses(source: DataFrame, target: DataFrame, params: SearchParams, attempt: int = 0) -> DataFrame:
    """Voted and refined pose per candidate."""
    links = materialize(descriptor_correspondences(source, target).drop("desc"))
    poses = materialize(vote_poses(links, CANDIDATE, params.vote_rounds, inlier=params.vote_inlier, seed=attempt))
    return refine(source.select(*CANDIDATE, "pos", "x", "y", "z", "nx", "ny", "nz"), target, poses, CANDIDATE, SITE, params.refine_rounds)


def score_poses(source: DataFrame, target: DataFrame, target_atoms: DataFrame, poses: DataFrame, params: SearchParams, scorer: Scorer) -> DataFrame:
    """Scores per candidate; a pose with too few partners scores 0."""
    placed = place(source, poses, CANDIDATE)
    heavy = target_atoms.filter(not_hydrogen_name()).select(F.col("protein_id").alias("target"), "serial", "x", "y", "z")
    feats = materialize(alignment_features(placed, target, heavy, SITE, ["target"]))
    fit = fitness(feats, CANDIDATE, 1.0).withColumnRenamed("inliers", "partners").withColumnRenamed("fitness", "fit")
    net = scorer.score(feats, CANDIDATE)
    scored = fit.join(descriptor_score(feats, CANDIDATE), CANDIDATE).join(net, CANDIDATE)
    poor = F.col("fit") < params.min_fitness
    # a near-perfect score from one or two partners is an artefact of that pose
    odd = (F.col("partners") <= 2) & (F.col("score") > 0.9)
    zero = lambda c: F.when(poor | odd, F.lit(0.0)).otherwise(F.col(c)).alias(c)
    return scored.select(*CANDIDATE, F.col("fit").alias("fitness"), "partners", zero("score"), zero("desc_dist_score"), zero("mean_desc_dist_score"))


def second_stage(database: Surfaces, targets: Surfaces, sites: DataFrame, candidates: DataFrame, params: SearchParams, scorer: Scorer | None = None) -> DataFrame:
    """Pose, score, filter and clash-check every candidate: the hit table."""
    scorer = scorer or HeuristicScorer()
    source = materialize(candidate_patches(database, candidates, params))
    target = materialize(site_patches(targets, sites, params))
    tries = None
    for a in range(params.attempts):
        poses = find_poses(source, target, params, a)
        s = score_poses(source, target, targets.atoms, poses, params, scorer).join(poses.select(*CANDIDATE, "pose"), CANDIDATE)
        s = s.withColumn("attempt", F.lit(a))
        tries = s if tries is None else tries.unionByName(s)
    best = best_attempt(tries, CANDIDATE, "score", "attempt", ["desc_dist_score", "mean_desc_dist_score", "fitness", "pose"])
    best = materialize(best.filter(hit(params.min_score, params.min_desc_score)))

    moved = best.select(*CANDIDATE, "pose").join(database.atoms, "protein_id")
    moved = place(moved.drop("pose"), best, CANDIDATE, normals=False)
    wall = targets.atoms.filter(not_hydrogen_name()).select(F.col("protein_id").alias("target"), "serial", "x", "y", "z")
    clashes = clash_counts(moved.withColumnRenamed("serial", "own_serial"), wall, CANDIDATE, "serial", params.clash_radius, params.max_ca_clashes, ["target"])
    hits = best.join(clashes, CANDIDATE, "left").na.fill(0, ["clashing_ca", "clashing_heavy"])
    hits = hits.filter(clash_ok(params.max_ca_clashes, params.max_heavy_clashes))
    return hits.join(candidates.select(*CANDIDATE, "desc_dist", "iface_score"), CANDIDATE)


def search(database: Surfaces, targets: Surfaces, params: SearchParams, scorer: Scorer | None = None, area: DataFrame | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    sites = materialize(choose_sites(targets, params, area))
    candidates = materialize(first_stage(database, targets, sites, params, whitelist))
    return second_stage(database, targets, sites, candidates, params, scorer)


def score_complex(binder: Surfaces, targets: Surfaces, pairs: DataFrame, sites: DataFrame, params: SearchParams, scorer: Scorer | None = None) -> DataFrame:
    """Score given complexes as they stand: the binder vertex nearest to each site, no alignment.

    ``pairs``: target, protein_id (binder).
    """
    scorer = scorer or HeuristicScorer()
    tv = targets.vertices.select(F.col("protein_id").alias("target"), "vix", "x", "y", "z")
    spots = sites.select(*SITE, F.col("vix").alias("query_vix")).join(tv.withColumnRenamed("vix", "query_vix"), ["target", "query_vix"]).join(pairs, "target")
    near = nearest(spots, binder.vertices, "vix", ["protein_id"], 1)
    cand = near.select(*SITE, "protein_id", F.col("n_vix").alias("vix"), "query_vix", F.col("n_dist").alias("center_distance"))
    source = candidate_patches(binder, cand, params)
    target = site_patches(targets, sites, params)
    heavy = targets.atoms.filter(not_hydrogen_name()).select(F.col("protein_id").alias("target"), "serial", "x", "y", "z")
    feats = materialize(alignment_features(source, target, heavy, SITE, ["target"]))
    # fingerprint distance of every point to its nearest point of the whole target patch, averaged
    mean_patch = feats.groupBy(*CANDIDATE).agg(F.avg("desc_dist").alias("mean_patch_desc_dist"))
    td = targets.descriptors.filter(F.col("variant") == params.target_variant).select(F.col("protein_id").alias("target"), F.col("vix").alias("query_vix"), as_double("desc").alias("_t"))
    bd = binder.descriptors.filter(F.col("variant") == "straight").select("protein_id", "vix", as_double("desc").alias("_b"))
    ts = targets.scores.select(F.col("protein_id").alias("target"), F.col("vix").alias("query_vix"), F.col("score").alias("query_iface_score"))
    bs = binder.scores.select("protein_id", "vix", F.col("score").alias("binder_iface_score"))
    out = cand.join(td, ["target", "query_vix"]).join(bd, ["protein_id", "vix"]).withColumn("descriptor_distance", vec_dist("_t", "_b")).drop("_t", "_b")
    out = out.join(ts, ["target", "query_vix"]).join(bs, ["protein_id", "vix"])
    return out.join(scorer.score(feats, CANDIDATE), CANDIDATE).join(descriptor_score(feats, CANDIDATE), CANDIDATE).join(mean_patch, CANDIDATE)
