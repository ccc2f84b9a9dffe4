"""Contacts between molecules: clashes, per-element contacts, minimum distances, buried area."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.chem import CONTACT_DEFAULT, CONTACT_RADII, CONTACT_SLACK, contact_radius
from facetry.operators.sequence import fragment_spans
from facetry.operators.spatial import exists_within, nearest, radius_pairs
from facetry.session import materialize

# Atom names that do not count as side chain.
BACKBONE = ["N", "CA", "C", "O", "H", "HA"]
FAR = 1000.0
WORD = 62  # sphere points per long


def clash_counts(posed: DataFrame, targets: DataFrame, keys: list[str], target_id: str, radius: float = 2.0, max_ca: float | None = None, on: list[str] = ()) -> DataFrame:
    """Alpha carbons and heavy atoms within ``radius`` of any target atom, per pose.

    With ``max_ca`` the heavy count of a pose that already fails on alpha carbons is 0.
    """
    near = exists_within(posed, targets, target_id, radius, on)
    counts = near.groupBy(*keys).agg(
        F.count_if(F.col("atom") == "CA").alias("clashing_ca"), F.count_if(~F.col("atom").startswith("H")).alias("clashing_heavy")
    )
    out = posed.select(*keys).distinct().join(counts, keys, "left").na.fill(0, ["clashing_ca", "clashing_heavy"])
    if max_ca is not None:
        out = out.withColumn("clashing_heavy", F.when(F.col("clashing_ca") > max_ca, F.lit(0)).otherwise(F.col("clashing_heavy")))
    return out


def contact_atoms(atoms: DataFrame, targets: DataFrame, target_id: str, on: list[str] = (), by: str = "element") -> DataFrame:
    """Atoms closer to some target atom than the sum of both radii plus a slack.

    Only the nearest target of each radius class can decide, so one bounded search per class
    answers it without listing pairs. ``by='atom'`` looks radii up by atom name.
    """
    on = list(on)
    classes = sorted({*CONTACT_RADII.values(), CONTACT_DEFAULT})
    reach = max(classes) * 2 + CONTACT_SLACK
    t = targets.withColumn("_rt", contact_radius(F.col(by)))
    q = atoms.withColumn("_rt", F.explode(F.array(*[F.lit(c) for c in classes]))).withColumn("_ra", contact_radius(F.col(by)))
    found = nearest(q, t, target_id, [*on, "_rt"], 1, reach, closed=False)
    hit = found.filter(F.col("n_dist") < F.col("_ra") + F.col("_rt") + CONTACT_SLACK)
    return hit.select(*atoms.columns).distinct()


def contact_counts(atoms: DataFrame, targets: DataFrame, keys: list[str], atom_id: str, target_id: str, on: list[str] = ()) -> DataFrame:
    """Atoms with at least one contact per design (0 where there is none)."""
    hits = contact_atoms(atoms.select(*dict.fromkeys([*keys, atom_id, "element", "x", "y", "z", *on])), targets, target_id, on)
    counts = hits.groupBy(*keys).agg(F.countDistinct(atom_id).alias("contacts"))
    return atoms.select(*keys).distinct().join(counts, keys, "left").na.fill(0, ["contacts"])


def contact_share_by_state(contacts: DataFrame, sse: DataFrame, keys: list[str], residue_keys: list[str], state: str = "E") -> DataFrame:
    """Share of contacts made by residues in one secondary-structure state; null without contacts."""
    per_res = contacts.groupBy(*residue_keys).agg(F.count("*").alias("c"))
    j = per_res.join(sse, residue_keys, "left")
    total, part = F.sum("c"), F.sum(F.when(F.col("state") == state, F.col("c")).otherwise(F.lit(0)))
    return j.groupBy(*keys).agg(total.alias("contacts"), part.alias("in_state"), F.try_divide(part, total).alias("ratio"))


def min_distances(atoms: DataFrame, targets: DataFrame, keys: list[str], target_id: str, on: list[str] = (), within: float | None = None) -> DataFrame:
    """Smallest side-chain to target distance per residue; 1000 stands for none."""
    side = atoms.filter(~F.col("atom").isin(BACKBONE))
    found = nearest(side, targets, target_id, on, 1, within).groupBy(*keys).agg(F.min("n_dist").alias("min_dist"))
    return atoms.select(*keys).distinct().join(found, keys, "left").na.fill(FAR, ["min_dist"])


def hotspots(min_dist: DataFrame, spans: DataFrame, keys: list[str], cutoff: float = 2.5) -> DataFrame:
    """Hotspot numbers per fragment, counted from 1 at the fragment's first residue."""
    hot = min_dist.filter(F.col("min_dist") < cutoff).join(spans, keys).select(*keys, (F.col("resid") - F.col("start") + 1).alias("spot"))
    lists = hot.groupBy(*keys).agg(F.array_sort(F.collect_set("spot")).alias("spots"))  # at most one entry per residue of a seed
    return spans.select(*keys).join(lists, keys, "left").withColumn("spots", F.coalesce("spots", F.array().cast("array<bigint>")))


def hotspot_string(per_fragment: DataFrame, seed: str, fragment: str) -> DataFrame:
    """``a:b:c,d:e`` with one group per fragment."""
    text = F.concat_ws(":", F.transform("spots", lambda s: s.cast("string")))
    parts = per_fragment.withColumn("_t", text).groupBy(seed).agg(F.array_sort(F.collect_list(F.struct(fragment, "_t"))).alias("f"))
    return parts.select(seed, F.btrim(F.array_join(F.col("f._t"), ","), F.lit(",")).alias("hotspots"))


def hotspot_spans(residues: DataFrame, per_fragment: DataFrame, keys: list[str]) -> DataFrame:
    """Residues between the first and last hotspot of their fragment."""
    ends = per_fragment.filter(F.size("spots") > 0).select(*keys, F.array_min("spots").alias("_a"), F.array_max("spots").alias("_b"))
    start = fragment_spans(residues, keys, "resid", "serial").select(*keys, "start")
    pos = F.col("resid") - F.col("start") + 1
    return residues.join(start, keys).join(ends, keys).filter(pos.between(F.col("_a"), F.col("_b"))).drop("start", "_a", "_b")


def sphere_points(n: int = 100) -> list[tuple[float, float, float]]:
    """Evenly spread unit directions on a golden spiral."""
    step = math.pi * (3 - math.sqrt(5))
    out = []
    for i in range(n):
        z = 1 - (2 * i + 1) / n
        r = math.sqrt(1 - z * z)
        out.append((math.cos(step * i) * r, math.sin(step * i) * r, z))
    return out


def exposed_area(atoms: DataFrame, keys: list[str], atom_id: str, radius: str, probe: float = 1.4, n_points: int = 100, on: list[str] = ()) -> DataFrame:
    """Solvent-exposed area per atom: share of its probe sphere outside every other atom's sphere.

    Atoms whose spheres meet are found by one cell join. Each such pair marks the sphere points it buries as bits, a matrix product per
    Arrow batch, and bits are united per atom before and after the shuffle, so radii are free and no list of neighbours is held.
    """
    on, ids = list(on), list(dict.fromkeys([*on, *keys, atom_id]))
    directions = np.array(sphere_points(n_points))
    words = [slice(i, i + WORD) for i in range(0, n_points, WORD)]
    names = [f"_w{i}" for i in range(len(words))]
    base = atoms.withColumn("_R", F.col(radius) + probe)
    balls = materialize(base.select(*ids, *[F.col(c).cast("double").alias(c) for c in "xyz"], F.col("_R").cast("double").alias("_R")))
    widest = balls.agg(F.max("_R")).first()[0] or probe

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def hidden(dx: pd.Series, dy: pd.Series, dz: pd.Series, own: pd.Series, other: pd.Series) -> pd.DataFrame:
        d = np.column_stack([dx, dy, dz])
        limit = np.maximum(other.to_numpy() - 1e-9, 0)
        # |own direction - d|^2 < limit^2
        left = (own.to_numpy() ** 2 + (d * d).sum(1) - limit**2) / 2
        inside = (d @ directions.T) * own.to_numpy()[:, None] > left[:, None]
        return pd.DataFrame({n: inside[:, w] @ (1 << np.arange(min(WORD, n_points - w.start), dtype=np.int64)) for n, w in zip(names, words)})

    meet = radius_pairs(balls, balls, 2 * widest, on).filter((F.col("dist") < F.col("_R") + F.col("n__R")) & (F.col(f"n_{atom_id}") != F.col(atom_id)))
    bits = meet.select(*ids, hidden(*[F.col(f"n_{c}") - F.col(c) for c in "xyz"], "_R", "n__R").alias("_b")).select(*ids, "_b.*")
    bits = bits.groupBy(*ids).agg(*[F.bit_or(n).alias(n) for n in names])
    buried = bits.select(*ids, sum(F.bit_count(n) for n in names).alias("_buried"))
    out = base.join(buried, ids, "left").na.fill(0, ["_buried"])
    return out.withColumn("area", (F.lit(1.0) - F.col("_buried") / n_points) * 4 * math.pi * F.pow("_R", F.lit(2.0))).drop("_R", "_buried")


def buried_area_report(areas: DataFrame, key: str = "structure_id") -> DataFrame:
    """Sums per part alone and in the complex, and their differences and ratio.

    ``areas``: key, part (target/binder/ligand), state (alone/complex), area.
    """
    pick = lambda part, state: F.sum(F.when((F.col("part") == part) & (F.col("state") == state), F.col("area")).otherwise(0.0))
    # a ligand belongs to the target's side
    both = lambda state: pick("target", state) + pick("ligand", state)
    s = areas.groupBy(key).agg(
        both("alone").alias("target_sasa"),
        pick("ligand", "alone").alias("ligand_sasa"),
        pick("binder", "alone").alias("binder_sasa"),
        F.sum(F.when(F.col("state") == "complex", F.col("area")).otherwise(0.0)).alias("complex_sasa"),
        both("complex").alias("target_complex_sasa"),
        pick("ligand", "complex").alias("ligand_complex_sasa"),
    )
    s = s.withColumn("target_buried_sasa", F.col("target_sasa") - F.col("target_complex_sasa"))
    s = s.withColumn("ligand_buried_sasa", F.col("ligand_sasa") - F.col("ligand_complex_sasa"))
    return s.withColumn("ligand_sasa_per_target_buried_sasa", F.try_divide("ligand_buried_sasa", "target_buried_sasa"))


def rmsd(moved: DataFrame, reference: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Root mean square distance over atoms paired by ordinal; both sides must have the same atoms."""
    ref = reference.select(*keys, ordinal, *[F.col(c).alias(f"r{c}") for c in "xyz"])
    both = moved.select(*keys, ordinal, "x", "y", "z").join(ref, [*keys, ordinal], "full_outer")
    sq = sum(F.pow(F.col(c) - F.col(f"r{c}"), F.lit(2.0)) for c in "xyz")
    out = both.groupBy(*keys).agg(
        F.sqrt(F.avg(sq)).alias("rmsd"), F.count_if(F.col("x").isNull() | F.col("rx").isNull()).alias("_odd"), F.count("*").alias("atoms")
    )
    return out.filter(F.assert_true(F.col("_odd") == 0, "structures differ in their atoms").isNull()).drop("_odd")


def interface_rmsd(moved: DataFrame, reference: DataFrame, partner: DataFrame, keys: list[str], ordinal: str, partner_id: str, cutoff: float = 5.0, from_moved: bool = False, on: list[str] = (), closed: bool = False) -> DataFrame:
    """RMSD over atoms near the partner, chosen in the reference pose or in the moved one."""
    base = moved if from_moved else reference
    near = exists_within(base, partner, partner_id, cutoff, on, closed).select(*keys, ordinal)
    pick = lambda d: d.join(near, [*keys, ordinal], "left_semi")
    return rmsd(pick(moved), pick(reference), keys, ordinal)


def best_of_both_directions(r1: Column, r2: Column) -> Column:
    """Smaller of two RMSDs, -1 if neither fragment exists."""
    return F.coalesce(F.least(r1, r2), F.lit(-1.0))
