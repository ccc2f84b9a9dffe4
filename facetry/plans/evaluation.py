"""Benchmarks and training tables built on the search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.align.superpose import place
from facetry.functions.vector import as_double
from facetry.models.scorer import Scorer
from facetry.operators.contact import interface_rmsd
from facetry.operators.patch import interface_center, ring_median
from facetry.operators.ranking import best_positive_rank, recovery_curve, topk_counters
from facetry.operators.sampling import hash_number, shuffled_ordinals, split_column
from facetry.operators.scale import with_ordinals
from facetry.operators.spatial import exists_within, nearest
from facetry.operators.vector_search import rank_database
from facetry.params import SearchParams
from facetry.plans.search import CANDIDATE, SITE, Surfaces, candidate_patches, find_poses, score_poses, site_patches
from facetry.session import materialize


def partner_map(cases: DataFrame) -> DataFrame:
    """Both directions of each benchmark pair: target, partner."""
    a = F.concat_ws("_", "pdb", "chain1")
    b = F.concat_ws("_", "pdb", "chain2")
    return cases.select(a.alias("target"), b.alias("partner")).unionAll(cases.select(b.alias("target"), a.alias("partner"))).distinct()


def recovery(hits: DataFrame, partners: DataFrame, posed: DataFrame, reference: DataFrame, target_atoms: DataFrame, ks: list[int], max_irmsd: float = 5.0) -> DataFrame:
    """Binder recovery: best pose per (target, site, match), interface RMSD for the true partner, curve over k."""
    best = hits.groupBy(*SITE, "protein_id").agg(F.max(F.struct("score", (-F.col("vix")).alias("n"))).alias("b"))
    best = best.select(*SITE, "protein_id", (-F.col("b.n")).alias("vix"), F.col("b.score").alias("score"))
    true = best.join(partners, (best["target"] == partners["target"]) & (best["protein_id"] == partners["partner"]), "left_semi")
    moved = posed.join(true.select(*CANDIDATE), CANDIDATE, "left_semi")
    ref = true.select(*CANDIDATE).join(reference, "protein_id")
    near = interface_rmsd(moved, ref, target_atoms, CANDIDATE, "serial", "t_serial", 5.0, on=["target"]).select(*CANDIDATE, F.col("rmsd").alias("irmsd"))
    table = best.join(near, CANDIDATE, "left").withColumn("entry", F.concat_ws("|", "site_ix", "protein_id"))
    return recovery_curve(table, "target", "score", F.coalesce(F.col("irmsd") < max_irmsd, F.lit(False)), ks, "entry")


def center_sites(rings: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Target vertex of each pair: highest median complementarity."""
    return interface_center(ring_median(rings.filter("side = 1"), [pair, "center_vix"]), [pair], "center_vix")


def training_candidates(database: Surfaces, targets: Surfaces, sites: DataFrame, k: int) -> DataFrame:
    """Nearest ``k`` database fingerprints of every site."""
    t = targets.descriptors.filter("variant = 'flipped'").select(F.col("protein_id").alias("target"), "vix", as_double("desc").alias("t_desc"))
    t = sites.select(*SITE, "vix").join(t, ["target", "vix"]).drop("vix")
    d = database.descriptors.filter("variant = 'straight'").select("protein_id", "vix", as_double("desc").alias("desc"))
    return rank_database(d, t, SITE, k, ["protein_id", "vix"]).select(*CANDIDATE, "desc_dist", "rank")


def label_poses(poses: DataFrame, atoms: DataFrame, target_atoms: DataFrame, partners: DataFrame, cutoff: float = 10.0) -> DataFrame:
    """RMSD of the placed true partner over its interface atoms (chosen in the moved pose); infinite for all others."""
    true = poses.join(partners, (poses["target"] == partners["target"]) & (poses["protein_id"] == partners["partner"]), "left_semi")
    ref = true.select(*CANDIDATE).join(atoms, "protein_id")
    moved = place(ref, true, CANDIDATE, normals=False)
    near = interface_rmsd(moved, ref, target_atoms, CANDIDATE, "serial", "t_serial", cutoff, from_moved=True, on=["target"], closed=True)
    # a placed partner without any atom near the target has no interface; NaN as in an empty mean
    known = true.select(*CANDIDATE).join(near.select(*CANDIDATE, "rmsd"), CANDIDATE, "left").withColumn("rmsd", F.coalesce("rmsd", F.lit(float("nan"))))
    return poses.join(known, CANDIDATE, "left").withColumn("rmsd", F.coalesce("rmsd", F.lit(float("inf"))))


def docking_benchmark(database: Surfaces, targets: Surfaces, sites: DataFrame, partners: DataFrame, params: SearchParams, scorer: Scorer, k: int = 2000, worst: int | None = None) -> DataFrame:
    """Rank of the first correct pose per target among the ``k`` nearest, and the report row."""
    cand = materialize(training_candidates(database, targets, sites, k))
    source = materialize(candidate_patches(database, cand, params))
    target = materialize(site_patches(targets, sites, params))
    poses = find_poses(source, target, params)
    wall = targets.atoms.select(F.col("protein_id").alias("target"), F.col("serial").alias("t_serial"), "x", "y", "z")
    labelled = label_poses(poses, database.atoms, wall, partners)
    scored = score_poses(source, target, targets.atoms, poses, params, scorer).join(labelled.select(*CANDIDATE, "rmsd"), CANDIDATE)
    good = (F.col("rmsd") < 5.0) & (F.col("fitness") > 0)
    ranks = best_positive_rank(scored, ["target"], "score", good, worst=worst)
    return topk_counters(ranks).withColumn("k", F.lit(k))


def training_pairs(rings: DataFrame, pairs: DataFrame, vertices: DataFrame, sc: tuple[float, float] = (0.5, 1.0), cutoff: float = 1.0, accept: float = 1.0, validation: float = 0.1, seed: int = 0) -> DataFrame:
    """Binder/positive/negative vertex triples for descriptor training.

    Positives: partner-1 vertices with median complementarity inside ``sc`` and their nearest partner-2
    vertex below ``cutoff``. Negatives: as many partner-2 vertices farther than ``cutoff`` from the
    selected vertices, in hash order. A pair with too few negatives gives only that many triples.
    """
    med = ring_median(rings.filter("side = 1"), ["pair_id", "center_vix"])
    sel = med.filter((F.col("median") > sc[0]) & (F.col("median") < sc[1])).select("pair_id", F.col("center_vix").alias("vix"))
    if accept < 1.0:
        sel = sel.filter(hash_number("pair_id", "vix", seed=seed + 1) < int(accept * (1 << 48)))
    side = lambda p: pairs.select("pair_id", F.col(p).alias("protein_id")).join(vertices, "protein_id").select("pair_id", "vix", "x", "y", "z")
    v1, v2 = side("p1").join(sel, ["pair_id", "vix"], "left_semi"), side("p2")
    pos = nearest(v1, v2, "vix", ["pair_id"], 1, cutoff, closed=False).select("pair_id", F.col("vix").alias("binder"), F.col("n_vix").alias("positive"))
    close = nearest(v2, v1, "vix", ["pair_id"], 1, cutoff).select("pair_id", "vix")
    # pairs without any selected vertex have nothing to be far from
    far = v2.join(sel.select("pair_id").distinct(), "pair_id", "left_semi").join(close, ["pair_id", "vix"], "left_anti")
    a = with_ordinals(pos, ["pair_id"], ["binder"], "_i")
    b = shuffled_ordinals(far, ["pair_id"], ["vix"], seed, "_i").select("pair_id", "_i", F.col("vix").alias("negative"))
    return a.join(b, ["pair_id", "_i"]).drop("_i").withColumn("split", split_column(["pair_id"], {"train": 1 - validation, "val": validation}, seed + 2))


def run_matrix(setups: DataFrame, cases: DataFrame, parts: int = 32) -> DataFrame:
    """Setup x case x direction work list. The product is the result; setups are copied to ``parts`` keys, so no side has to be small."""
    both = F.array(*[F.struct(F.col(a).alias("target_chains"), F.col(b).alias("binder_chains")) for a, b in (("chain1", "chain2"), ("chain2", "chain1"))])
    rows = cases.withColumn("d", F.explode(both)).withColumn("_k", F.pmod(F.xxhash64(*cases.columns), F.lit(parts)))
    copies = setups.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return rows.join(copies, "_k").drop("_k").select("*", "d.*").drop("d")


def interface_center_point(target_atoms: DataFrame, binder_atoms: DataFrame, vertices: DataFrame, keys: list[str], contact: float = 5.0, reach: float = 10.0, least: int = 3) -> DataFrame:
    """Mean of the target atoms near the binder; where too few vertices lie around it, the closest vertex instead."""
    iface = exists_within(target_atoms, binder_atoms, "serial", contact, keys, closed=False)
    mid = iface.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in "xyz"])
    around = vertices.join(mid.select(*keys, *[F.col(c).alias(f"m{c}") for c in "xyz"]), keys)
    sq = sum(F.pow(F.col(c) - F.col(f"m{c}"), F.lit(2.0)) for c in "xyz")
    best = around.withColumn("_d", F.sqrt(sq)).groupBy(*keys).agg(F.count_if(F.col("_d") < reach).alias("n_near"), F.min(F.struct("_d", "vix", "x", "y", "z")).alias("v"))
    few = F.col("n_near") < least
    return mid.join(best, keys).select(*keys, "n_near", *[F.when(few, F.col(f"v.{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"])


def farthest_atom(ligand_atoms: DataFrame, protein_atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Ligand atom whose nearest protein atom is farthest away (first one on ties)."""
    near = nearest(ligand_atoms.withColumnRenamed("serial", "lig_serial"), protein_atoms, "serial", keys, 1)
    b = near.groupBy(*keys).agg(F.max(F.struct("n_dist", (-F.col("lig_serial")).alias("n"))).alias("b"))
    return b.select(*keys, (-F.col("b.n")).alias("serial"), F.col("b.n_dist").alias("distance"))


def middle_atom(target_atoms: DataFrame, binder_atoms: DataFrame, keys: list[str], contact: float = 5.0) -> DataFrame:
    """Interface atom whose farthest fellow interface atom is nearest (first one on ties)."""
    iface = exists_within(target_atoms, binder_atoms, "serial", contact, keys, closed=False)
    far = nearest(iface.withColumnRenamed("serial", "own"), iface, "serial", keys, farthest=True)
    b = far.groupBy(*keys).agg(F.min(F.struct("n_dist", "own")).alias("b"))
    return b.select(*keys, F.col("b.own").alias("serial"), F.col("b.n_dist").alias("reach"))
