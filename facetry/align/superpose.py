"""Rigid superposition and pose search. Sums and joins run in Spark; only 3x3 and 6x6 algebra is Arrow."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.functions.geometry import ROTATION, SHIFT, apply_transform, compose_transforms, cross3, dot3, transform_struct

IDENTITY = {**{n: 1.0 if n[1] == n[2] else 0.0 for n in ROTATION}, **{n: 0.0 for n in SHIFT}}
POSE = T.StructType([T.StructField(n, T.DoubleType()) for n in (*ROTATION, *SHIFT)])
VOTE = T.StructType(
    [T.StructField("pose", POSE), T.StructField("fitness", T.DoubleType()), T.StructField("inliers", T.IntegerType()), T.StructField("inlier_rmse", T.DoubleType())]
)


def _kabsch(cov: np.ndarray) -> np.ndarray:
    """Rotations (B,3,3) that best turn p onto q from covariances sum p q^T."""
    u, _, vt = np.linalg.svd(cov)
    sign = np.sign(np.linalg.det(u @ vt))
    d = np.repeat(np.eye(3)[None], len(cov), 0)
    d[:, 2, 2] = np.where(sign == 0, 1.0, sign)
    return np.transpose(vt, (0, 2, 1)) @ d @ np.transpose(u, (0, 2, 1))


def _pose_frame(r: np.ndarray, t: np.ndarray) -> pd.DataFrame:
    out = {n: r[:, int(n[1]) - 1, int(n[2]) - 1] for n in ROTATION}
    out.update({n: t[:, i] for i, n in enumerate(SHIFT)})
    return pd.DataFrame(out)


@F.pandas_udf(POSE)
def _fit(sums: pd.Series) -> pd.DataFrame:
    s = np.stack(sums.to_numpy()).astype(float)
    n, p, q, pq = s[:, 0], s[:, 1:4], s[:, 4:7], s[:, 7:16].reshape(-1, 3, 3)
    cov = pq - p[:, :, None] * q[:, None, :] / n[:, None, None]
    r = _kabsch(cov)
    t = q / n[:, None] - np.einsum("bij,bj->bi", r, p / n[:, None])
    return _pose_frame(r, t)


def superpose(pairs: DataFrame, keys: list[str], p: tuple = ("x", "y", "z"), q: tuple = ("qx", "qy", "qz")) -> DataFrame:
    """Least-squares rigid transform per group that moves p onto q: keys, ``pose``, ``n``."""
    sums = [F.count("*").cast("double").alias("_n")]
    sums += [F.sum(c).alias(f"_p{i}") for i, c in enumerate(p)] + [F.sum(c).alias(f"_q{i}") for i, c in enumerate(q)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"_c{i}{j}") for i, a in enumerate(p) for j, b in enumerate(q)]
    g = pairs.groupBy(*keys).agg(*sums)
    names = [c for c in g.columns if c not in keys]
    return g.withColumn("pose", _fit(F.array(*names))).select(*keys, "pose", F.col("_n").cast("long").alias("n"))


def place(points: DataFrame, poses: DataFrame, keys: list[str], normals: bool = True) -> DataFrame:
    """Points moved by the pose of their group."""
    m = points.join(poses.select(*keys, "pose"), keys)
    moved = dict(zip("xyz", apply_transform(("x", "y", "z"), "pose")))
    if normals:
        moved |= dict(zip(("nx", "ny", "nz"), apply_transform(("nx", "ny", "nz"), "pose", shift=False)))
    return m.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in m.columns if c != "pose"])


VOTE_CHUNK = 256


def _vote_chunk(p, q, pn, qn, pick, edge_ratio: float, max_dist: float, inlier: float):
    """(pose, fitness, inliers, rmse) of the best of some triplets; None if no triplet holds."""
    a, b = p[pick], q[pick]
    ea = np.linalg.norm(a - np.roll(a, 1, 1), axis=2)
    eb = np.linalg.norm(b - np.roll(b, 1, 1), axis=2)
    keep = (np.minimum(ea, eb) >= edge_ratio * np.maximum(ea, eb)).all(1)
    pick, a, b = pick[keep], a[keep], b[keep]
    if not len(a):
        return None
    ca, cb = a.mean(1, keepdims=True), b.mean(1, keepdims=True)
    r = _kabsch(np.einsum("bki,bkj->bij", a - ca, b - cb))
    t = (cb - np.einsum("bij,bkj->bki", r, ca))[:, 0]
    off = np.linalg.norm(np.einsum("bij,bkj->bki", r, a) + t[:, None] - b, axis=2).max(1)
    facing = (np.einsum("bij,bkj->bki", r, pn[pick]) * qn[pick]).sum(2).min(1)
    ok = (off <= max_dist) & (facing >= 0)
    r, t = r[ok], t[ok]
    if not len(r):
        return None
    d = np.linalg.norm(np.einsum("bij,kj->bki", r, p) + t[:, None] - q[None], axis=2)
    hit = d < inlier
    count = hit.sum(1)
    rmse = np.sqrt((d * d * hit).sum(1) / np.maximum(count, 1))
    i = np.lexsort((rmse, -count))[0]
    pose = {n: r[i, int(n[1]) - 1, int(n[2]) - 1] for n in ROTATION} | {n: t[i, j] for j, n in enumerate(SHIFT)}
    return pose, count[i] / len(p), int(count[i]), rmse[i]


def _vote_udf(rounds: int, edge_ratio: float, max_dist: float, inlier: float, seed: int):
    @F.pandas_udf(VOTE)
    def vote(name: pd.Series, src: pd.Series, dst: pd.Series, src_n: pd.Series, dst_n: pd.Series) -> pd.DataFrame:
        rows = []
        for key, *arrays in zip(name, src, dst, src_n, dst_n):
            p, q, pn, qn = (np.stack(a).astype(float) for a in arrays)
            best = None
            if len(p) >= 3:
                rng = np.random.default_rng(zlib.crc32(f"{seed}|{key}".encode()))
                pick = rng.integers(0, len(p), (rounds, 3))
                pick = pick[(pick[:, 0] != pick[:, 1]) & (pick[:, 1] != pick[:, 2]) & (pick[:, 0] != pick[:, 2])]
                for first in range(0, len(pick), VOTE_CHUNK):  # memory stays bounded for any number of rounds
                    found = _vote_chunk(p, q, pn, qn, pick[first : first + VOTE_CHUNK], edge_ratio, max_dist, inlier)
                    if found and (best is None or (-found[2], found[3]) < (-best[2], best[3])):
                        best = found
            rows.append(best or (IDENTITY, 0.0, 0, 0.0))
        return pd.DataFrame(rows, columns=VOTE.names)

    return vote


def vote_poses(
    correspondences: DataFrame,
    keys: list[str],
    rounds: int = 2000,
    edge_ratio: float = 0.9,
    max_dist: float = 1.0,
    inlier: float = 1.5,
    seed: int = 0,
) -> DataFrame:
    """Best pose per group from random triplets of correspondences.

    A triplet has to keep its edge lengths within ``edge_ratio``, land within ``max_dist`` and face
    the right way; the pose with most correspondences inside ``inlier`` wins. One group is one patch
    (bounded by the patch size). Columns: keys, pos, x..z, nx..nz and qx..qz, qnx..qnz.
    """
    tri = lambda p, n: F.transform("_c", lambda s: F.array(*[s[f"{p}{a}"] for a in n]))
    fields = ["pos", *"xyz", "nx", "ny", "nz", "qx", "qy", "qz", "qnx", "qny", "qnz"]
    g = correspondences.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_c"))
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    vote = _vote_udf(rounds, edge_ratio, max_dist, inlier, seed)
    g = g.withColumn("_v", vote(name, tri("", "xyz"), tri("q", "xyz"), tri("n", "xyz"), tri("qn", "xyz")))
    return g.select(*keys, "_v.pose", "_v.fitness", "_v.inliers", "_v.inlier_rmse")


@F.pandas_udf(POSE)
def _plane_step(sums: pd.Series) -> pd.DataFrame:
    s = np.stack(sums.to_numpy()).astype(float)
    a = np.zeros((len(s), 6, 6))
    iu = np.triu_indices(6)
    a[:, iu[0], iu[1]] = s[:, :21]
    a[:, iu[1], iu[0]] = s[:, :21]
    # patches with fewer than six independent correspondences take the smallest step
    w = np.einsum("bij,bj->bi", np.linalg.pinv(a), s[:, 21:27])
    angle = np.linalg.norm(w[:, :3], axis=1)
    axis = w[:, :3] / np.where(angle > 0, angle, 1.0)[:, None]
    k = np.zeros((len(s), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -axis[:, 2], axis[:, 1], -axis[:, 0]
    k -= np.transpose(k, (0, 2, 1))
    r = np.eye(3)[None] + np.sin(angle)[:, None, None] * k + (1 - np.cos(angle))[:, None, None] * (k @ k)
    return _pose_frame(r, w[:, 3:])


def plane_step(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One point-to-plane least-squares step per group from pairs (x..z) -> (qx..qz) with normals qnx..qnz.

    Columns: keys, step, the number of pairs (``partners``) and the sum of their squared distances before the step (``sq_dist``).
    """
    p, q, n = ("x", "y", "z"), ("qx", "qy", "qz"), ("qnx", "qny", "qnz")
    row = [*cross3(p, n), *[F.col(c) for c in n]]
    gap = dot3(tuple(F.col(a) - F.col(b) for a, b in zip(q, p)), n)
    apart = sum(F.pow(F.col(a) - F.col(b), F.lit(2.0)) for a, b in zip(p, q))
    v = pairs.select(*keys, *[c.alias(f"_a{i}") for i, c in enumerate(row)], gap.alias("_g"), apart.alias("_d"))
    sums = [F.sum(F.col(f"_a{i}") * F.col(f"_a{j}")).alias(f"_s{i}{j}") for i in range(6) for j in range(i, 6)]
    sums += [F.sum(F.col(f"_a{i}") * F.col("_g")).alias(f"_b{i}") for i in range(6)]
    names = [f"_s{i}{j}" for i in range(6) for j in range(i, 6)] + [f"_b{i}" for i in range(6)]
    g = v.groupBy(*keys).agg(*sums, F.count("*").alias("partners"), F.sum("_d").alias("sq_dist"))
    return g.select(*keys, _plane_step(F.array(*names)).alias("step"), "partners", "sq_dist")


def identity_pose() -> Column:
    return transform_struct(IDENTITY)


def then(step: str, pose: str) -> Column:
    return compose_transforms(step, pose)
