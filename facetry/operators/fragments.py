"""Fragments that touch a surface, their distances in place within a cutoff, and clusters of them.

Fragments of one length lie in one frame, so their distance is the root mean square over positions without superposition.
Only pairs within the cutoff are made, never a matrix: by Jensen's inequality the distance of two fragments is at least that of their
centroids, and at least the weighted root mean square of the distances of the centroids of both halves. The first bound is a join over
cells, the second a test of six numbers per pair before all positions are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.components import connected
from facetry.operators.scale import with_ordinals
from facetry.operators.sequence import best_window
from facetry.operators.spatial import XYZ, exists_within, radius_pairs
from facetry.session import materialize

SIZE = 12
REACH = 3.0


def touching_fragments(atoms: DataFrame, dots: DataFrame, dot_id: str, key: str, size: int = SIZE, reach: float = REACH) -> DataFrame:
    """(key, pos, x, y, z): alpha carbons of the window of ``size`` residues with most atoms closer than ``reach`` to some dot.

    ``atoms``: key, resid, atom, x, y, z. The first window wins ties, also where nothing touches; chains with fewer residues, or whose best window
    lacks an alpha carbon, give no row.
    """
    near = exists_within(atoms.select(key, "resid", "atom", *XYZ), dots.select(dot_id, *XYZ), dot_id, reach, closed=False)
    touch = near.groupBy(key, "resid").agg(F.count("*").alias("_n"))
    residues = atoms.select(key, "resid").distinct().join(touch, [key, "resid"], "left").na.fill(0, ["_n"])
    residues = materialize(with_ordinals(residues, [key], ["resid"], "_ord"))
    start = best_window(residues, [key], ["resid"], "_n", size).select(key, F.col("start").alias("_start"))
    inside = residues.join(start, key).withColumn("pos", F.col("_ord") - F.col("_start")).filter((F.col("pos") >= 0) & (F.col("pos") < size))
    ca = atoms.filter(F.col("atom") == "CA").groupBy(key, "resid").agg(F.min(F.struct(*XYZ)).alias("_p"))
    out = inside.join(ca, [key, "resid"]).select(key, F.col("pos").cast("int").alias("pos"), *[F.col(f"_p.{c}").alias(c) for c in XYZ])
    whole = out.groupBy(key).agg(F.count("*").alias("_c")).filter(F.col("_c") == size)
    return out.join(whole, key, "left_semi")


def fragment_vectors(positions: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """(key, vec): coordinates of a fragment in one array of 3 ``size`` numbers; only fragments with every position and finite numbers."""
    rows = positions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", *XYZ))).alias("_l"))  # at most size of them
    ok = (F.size("_l") == size) & F.forall("_l", lambda p: reduce(lambda a, b: a & b, [F.coalesce(F.abs(p[c]) < float("inf"), F.lit(False)) for c in XYZ]))
    return rows.filter(ok).select(key, F.flatten(F.transform("_l", lambda p: F.array(*[p[c].cast("double") for c in XYZ]))).alias("vec"))


def _mean(vec: str, axis: int, first: int, last: int) -> Column:
    return sum((F.col(vec)[3 * i + axis] for i in range(first, last)), F.lit(0.0)) / (last - first)


def fragment_classes(vectors: DataFrame, key: str) -> DataFrame:
    """(class_id, vec, copies): fragments with the same coordinates are one class, named after its smallest key."""
    return vectors.groupBy("vec").agg(F.min(key).alias("class_id"), F.count("*").alias("copies"))


def rmsd_pairs(classes: DataFrame, cutoff: float, size: int = SIZE) -> DataFrame:
    """(class_id, n_class_id, rmsd) of all pairs of classes with a root mean square distance of at most ``cutoff``, smaller id first."""
    half = max(1, size // 2)
    ends = {"a": (0, half), "b": (half, size)} if size > 1 else {"a": (0, 1)}
    c = classes.select("class_id", "vec", *[_mean("vec", i, 0, size).alias(n) for i, n in enumerate(XYZ)])
    c = c.select("*", *[_mean("vec", i, *r).alias(f"{h}{n}") for h, r in ends.items() for i, n in enumerate(XYZ)])
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    loose = cutoff * (1 + 1e-9)  # the bounds are rounded in another way than the distance
    c = materialize(c)
    pairs = radius_pairs(c, c, loose, closed=True).filter(F.col("class_id") < F.col("n_class_id"))
    bound = sum((r[1] - r[0]) * sum(sq(f"{h}{n}", f"n_{h}{n}") for n in XYZ) for h, r in ends.items()) / size
    pairs = pairs.filter(bound <= loose * loose)
    # spelled out position by position: compiled code instead of interpreted array functions
    rmsd = F.sqrt(sum((F.col("vec")[i] - F.col("n_vec")[i]) * (F.col("vec")[i] - F.col("n_vec")[i]) for i in range(3 * size)) / size)
    return pairs.select("class_id", "n_class_id", rmsd.alias("rmsd")).filter(F.col("rmsd") <= cutoff)


def rmsd_clusters(vectors: DataFrame, classes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, class_id, cluster_id) of every fragment: the smallest class reachable over pairs, its own where it has none."""
    found = connected(pairs, "class_id", "n_class_id").select(F.col("node").alias("class_id"), F.col("component").alias("_c"))
    named = classes.join(found, "class_id", "left").select("vec", "class_id", F.coalesce("_c", "class_id").alias("cluster_id"))
    return vectors.join(named, "vec").select(key, "class_id", "cluster_id")
