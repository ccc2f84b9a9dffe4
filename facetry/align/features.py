"""Features and simple scores of placed patches against target patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.geometry import dot3
from facetry.functions.vector import vec_dist
from facetry.operators.spatial import nearest

# Floors of the three distances before inversion.
MIN_POINT_DIST, MIN_DESC_DIST, MIN_ATOM_DIST = 0.5, 1e-6, 0.25
NEAR = 1.5


def feature_columns(clip_desc: bool = True) -> dict[str, Column]:
    """1/distance, 1/descriptor distance, normal product, 1/atom distance; training tables do not clip the second."""
    desc = F.greatest(F.col("desc_dist"), F.lit(MIN_DESC_DIST)) if clip_desc else F.col("desc_dist")
    return {
        "f_dist": 1 / F.greatest(F.col("nn_dist"), F.lit(MIN_POINT_DIST)),
        "f_desc": F.try_divide(F.lit(1.0), desc),
        "f_normal": F.col("normal_dp"),
        "f_atom": 1 / F.greatest(F.col("atom_dist"), F.lit(MIN_ATOM_DIST)),
    }


def alignment_features(source: DataFrame, target: DataFrame, atoms: DataFrame | None, site: list[str], atom_on: list[str] = (), clip_desc: bool = True) -> DataFrame:
    """Features of every placed source point against its nearest point of the site's patch.

    ``source``: pose keys, site keys, x..z, nx..nz, desc. ``target``: site keys, vix, the same
    columns (normals already flipped). Without ``atoms`` only the three-feature form results.
    """
    near = nearest(source, target, "vix", site, 1)
    t = target.select(*site, F.col("vix").alias("n_vix"), F.col("desc").alias("_td"), *[F.col(f"n{c}").alias(f"_t{c}") for c in "xyz"])
    out = near.drop("n_rank").withColumnRenamed("n_dist", "nn_dist").join(t, [*site, "n_vix"])
    out = out.withColumn("desc_dist", vec_dist("desc", "_td")).withColumn("normal_dp", dot3(("nx", "ny", "nz"), ("_tx", "_ty", "_tz")))
    out = out.drop("_td", "_tx", "_ty", "_tz")
    feats = feature_columns(clip_desc)
    if atoms is None:
        feats.pop("f_atom")
    else:
        places = out.select(*dict.fromkeys([*atom_on, "x", "y", "z"])).distinct()
        d = nearest(places, atoms, "serial", list(atom_on), 1).drop("n_serial", "n_rank").withColumnRenamed("n_dist", "atom_dist")
        out = out.join(d, list(dict.fromkeys([*atom_on, "x", "y", "z"])))
    return out.withColumns(feats)


def descriptor_score(features: DataFrame, keys: list[str]) -> DataFrame:
    """Sum (and mean) of squared inverse descriptor distances over points closer than 1.5; mean is null without any."""
    near = F.col("nn_dist") < NEAR
    total = F.sum(F.when(near, F.pow("f_desc", F.lit(2.0))).otherwise(F.lit(0.0)))
    return features.groupBy(*keys).agg(total.alias("desc_dist_score"), F.try_divide(total, F.count_if(near)).alias("mean_desc_dist_score"), F.count("*").alias("points"))


def correspondence_scores(correspondences: DataFrame, groups: DataFrame, keys: list[str], dist: str = "desc_dist") -> DataFrame:
    """Sum of 1/d^2, count, mean of 1/d^2 and sum of 1/d^3; a group without correspondences counts as one of distance 1000."""
    inv = 1 / F.col(dist)
    s = correspondences.groupBy(*keys).agg(
        F.sum(inv * inv).alias("score"), F.count("*").alias("inliers"), F.avg(inv * inv).alias("mean_score"), F.sum(inv * inv * inv).alias("cube_score")
    )
    far = 1e-3
    return groups.select(*keys).distinct().join(s, keys, "left").na.fill({"score": far**2, "inliers": 0, "mean_score": far**2, "cube_score": far**3})


def fitness(features: DataFrame, keys: list[str], reach: float = NEAR) -> DataFrame:
    """Share and number of points with a partner within ``reach``, and their root mean square distance."""
    near = F.col("nn_dist") <= reach
    return features.groupBy(*keys).agg(
        (F.count_if(near) / F.count("*")).alias("fitness"),
        F.count_if(near).alias("inliers"),
        F.sqrt(F.avg(F.when(near, F.col("nn_dist") * F.col("nn_dist")))).alias("inlier_rmse"),
    )
