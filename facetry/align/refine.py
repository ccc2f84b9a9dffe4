"""Iterative point-to-plane refinement of poses against site patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.align.superpose import place, plane_step, then
from facetry.operators.spatial import nearest
from facetry.session import materialize


def refine(source: DataFrame, target: DataFrame, poses: DataFrame, keys: list[str], site: list[str], rounds: int = 5, reach: float = 1.0) -> DataFrame:
    """A fixed number of rounds: nearest partners within ``reach``, one step per pose, compose.

    A pose without partners keeps its transform. Of all poses on the way, the one with most partners (then the smallest distance to them)
    is returned: a small or flat patch hardly fixes a step along its plane, and such a step may lose all partners.
    Each round is written out, so plans stay short.
    """
    if not rounds:
        return poses
    cols = poses.columns
    t = target.select(*site, F.col("vix").alias("n_vix"), *[F.col(c).alias(f"q{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    poses = poses.withColumns({"_best": F.col("pose"), "_held": F.lit(0).cast("long"), "_off": F.lit(0.0)})
    better = (F.col("partners") > F.col("_held")) | ((F.col("partners") == F.col("_held")) & (F.col("sq_dist") < F.col("_off")))
    for i in range(rounds + 1):
        placed = place(source, poses, keys, normals=False)
        pairs = nearest(placed, target, "vix", site, 1, reach).join(t, [*site, "n_vix"])
        seen = poses.join(plane_step(pairs, keys), keys, "left").withColumn("_up", F.coalesce(better, F.lit(False)))
        seen = seen.withColumns({a: F.when(F.col("_up"), F.col(b)).otherwise(F.col(a)) for a, b in (("_best", "pose"), ("_held", "partners"), ("_off", "sq_dist"))})
        if i < rounds:  # the last pose is only looked at
            seen = seen.withColumn("pose", F.when(F.col("step").isNull(), F.col("pose")).otherwise(then("step", "pose")))
        poses = materialize(seen.select(*cols, "_best", "_held", "_off"))
    return poses.withColumn("pose", F.col("_best")).select(*cols)
