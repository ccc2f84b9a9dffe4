"""Soft polar-grid pooling of patch channels, the descriptor model and the interface model.

Training is outside this package; weights come in as arrays. Patches are bounded by their member
limit, so one patch is one array row at the model boundary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.scale import large

CHANNELS = ("si", "ddc", "hbond", "charge", "hphob")
PATCH = ["protein_id", "center_vix"]
CHUNK = 4_000_000  # numbers in the arrays of one step


@dataclass(frozen=True)
class PolarGrid:
    """Grid of Gaussians: cell = ring * n_theta + sector."""

    n_rho: int = 5
    n_theta: int = 16
    n_rotations: int = 16
    max_rho: float = 12.0
    sigma_theta: float = 1.0
    eps: float = 1e-5

    @property
    def sigma_rho(self) -> float:
        return self.max_rho / 8

    @property
    def size(self) -> int:
        return self.n_rho * self.n_theta

    def centers(self) -> list[tuple[int, float, float]]:
        return [
            (i * self.n_theta + j, self.max_rho * (i + 1) / self.n_rho, 2 * math.pi * j / self.n_theta)
            for i in range(self.n_rho)
            for j in range(self.n_theta)
        ]


DESCRIPTOR_GRID = PolarGrid()
INTERFACE_GRID = PolarGrid(n_rho=3, n_theta=4, n_rotations=4, max_rho=9.0)


def pool_relational(members: DataFrame, channels: list[str], grid: PolarGrid) -> DataFrame:
    """Reference form: center, channel, rotation, cell -> pooled value, all in expressions."""
    cells = F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(r).alias("mr"), F.lit(t).alias("mt")) for c, r, t in grid.centers()])
    turn = F.pmod(F.col("theta") + F.col("rotation") * (2 * math.pi / grid.n_rotations), F.lit(2 * math.pi))
    src = members.select(*PATCH, "rho", "theta", *channels)
    src = src.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(grid.n_rotations - 1)))).withColumn("_t", turn)
    src = src.withColumn("_c", F.explode(cells))
    gauss = F.exp(-F.pow(F.col("rho") - F.col("_c.mr"), F.lit(2.0)) / (grid.sigma_rho**2 + grid.eps)) * F.exp(
        -F.pow(F.col("_t") - F.col("_c.mt"), F.lit(2.0)) / (grid.sigma_theta**2 + grid.eps)
    )
    src = src.withColumn("_g", gauss)
    sums = src.groupBy(*PATCH, "rotation", F.col("_c.cell").alias("cell")).agg(
        F.sum("_g").alias("_w"), *[F.sum(F.col("_g") * F.col(c)).alias(f"_s{c}") for c in channels]
    )
    tall = F.array(*[F.struct(F.lit(c).alias("channel"), (F.col(f"_s{c}") / (F.col("_w") + grid.eps)).alias("value")) for c in channels])
    return sums.select(*PATCH, "rotation", "cell", F.explode(tall).alias("e")).select(*PATCH, "e.channel", "rotation", "cell", "e.value")


def patch_arrays(members: DataFrame, channels: list[str]) -> DataFrame:
    """One row per patch: aligned arrays rho, theta and one per channel, in member order."""
    fields = ["pos", "rho", "theta", *channels]
    g = members.groupBy(*PATCH).agg(F.array_sort(F.collect_list(F.struct(*[F.col(f).cast("double").alias(f) for f in fields]))).alias("m"))
    return g.select(*PATCH, F.col("m.rho").alias("rho"), F.col("m.theta").alias("theta"), *[F.col(f"m.{c}").alias(c) for c in channels])


def pool_batch(rho: np.ndarray, theta: np.ndarray, values: np.ndarray, mask: np.ndarray, grid: PolarGrid) -> np.ndarray:
    """(patches, rotations, channels, cells) of padded patches: rho, theta and mask (patches, members), values (patches, channels, members).

    A cell's Gaussian is a ring's times a sector's, so exponentials are taken per ring and per sector only, and the sums over members
    are one matrix product per patch.
    """
    n, f, width = values.shape
    rings = grid.max_rho * np.arange(1, grid.n_rho + 1) / grid.n_rho
    sectors = 2 * np.pi * np.arange(grid.n_theta) / grid.n_theta
    turns = 2 * np.pi * np.arange(grid.n_rotations) / grid.n_rotations
    ring = np.exp(-((rho[:, None] - rings[:, None]) ** 2) / (grid.sigma_rho**2 + grid.eps)) * mask[:, None]
    turned = np.mod(theta[:, :, None] + turns, 2 * np.pi)
    sector = np.exp(-((turned[..., None] - sectors) ** 2) / (grid.sigma_theta**2 + grid.eps))
    weighed = np.concatenate([values, np.ones((n, 1, width))], 1)[:, :, None] * ring[:, None]
    sums = weighed.reshape(n, (f + 1) * grid.n_rho, width) @ sector.reshape(n, width, -1)
    sums = sums.reshape(n, f + 1, grid.n_rho, grid.n_rotations, grid.n_theta).transpose(0, 3, 1, 2, 4).reshape(n, grid.n_rotations, f + 1, grid.size)
    return sums[:, :, :-1] / (sums[:, :, -1:] + grid.eps)


def pool_patch(rho: np.ndarray, theta: np.ndarray, values: np.ndarray, grid: PolarGrid) -> np.ndarray:
    """(rotations, channels, cells) of one patch; ``values`` is (channels, members)."""
    return pool_batch(rho[None], theta[None], values[None], np.ones((1, len(rho))), grid)[0]


def pooled_chunks(rho: pd.Series, theta: pd.Series, vals: pd.Series, grid: PolarGrid) -> Iterator[np.ndarray]:
    """Pooled patches of an Arrow batch, padded together in chunks of at most ``CHUNK`` numbers (or one patch)."""
    rho, theta, vals = rho.to_numpy(), theta.to_numpy(), vals.to_numpy()
    if not len(rho):
        return
    sizes = np.array([len(r) for r in rho])
    f, width = len(vals[0]), max(1, int(sizes.max()))
    each = width * (grid.n_rotations * grid.n_theta + (f + 1) * grid.n_rho) + (f + 1) * grid.n_rotations * grid.size
    step = max(1, CHUNK // each)
    for i in range(0, len(rho), step):
        n = sizes[i : i + step]
        mask = np.arange(int(n.max())) < n[:, None]

        def padded(rows):
            out = np.zeros(mask.shape)
            out[mask] = np.concatenate(rows)
            return out

        v = np.stack([padded([x[c] for x in vals[i : i + step]]) for c in range(f)], 1)
        yield pool_batch(padded(rho[i : i + step]), padded(theta[i : i + step]), v, mask, grid)


@dataclass
class DescriptorWeights:
    conv: np.ndarray  # channels, cells, cells
    conv_bias: np.ndarray  # channels, cells
    dense: np.ndarray  # channels * cells, cells
    dense_bias: np.ndarray  # cells

    @staticmethod
    def seeded(n_channels: int = 5, cells: int = 80, seed: int = 0) -> "DescriptorWeights":
        """Stand-in weights of the right shape (none are published)."""
        r = np.random.default_rng(seed)
        return DescriptorWeights(
            r.normal(size=(n_channels, cells, cells)) / math.sqrt(cells),
            np.zeros((n_channels, cells)),
            r.normal(size=(n_channels * cells, cells)) / math.sqrt(n_channels * cells),
            np.zeros(cells),
        )


def _convolve(pooled: np.ndarray, conv: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Per channel: dense layer per rotation, best rotation, positive part. (patches, rotations, channels, cells) in, one row per patch out."""
    turned = pooled.transpose(0, 2, 1, 3) @ conv  # patches, channels, rotations, cells
    return np.maximum(turned.max(2) + bias, 0.0).reshape(len(pooled), -1)


def descriptors(members: DataFrame, weights: DescriptorWeights, grid: PolarGrid = DESCRIPTOR_GRID, channels: tuple = CHANNELS, flipped: bool = False) -> DataFrame:
    """Fingerprint per patch. ``flipped``: the complementary view (signs and angles turned)."""
    channels = list(channels)
    if flipped:
        # hydropathy keeps its sign where it is the last of five or three channels
        keep = channels[-1] if len(channels) in (3, 5) else None
        turned = [(F.col(c) if c == keep else -F.col(c)).alias(c) for c in channels]
        members = members.select(*PATCH, "pos", "rho", (F.lit(2 * math.pi) - F.col("theta")).alias("theta"), *turned)
    shared = members.sparkSession.sparkContext.broadcast((weights.conv, weights.conv_bias, weights.dense, weights.dense_bias))

    @F.pandas_udf("array<float>")
    def score(rho: pd.Series, theta: pd.Series, vals: pd.Series) -> pd.Series:
        conv, conv_bias, dense, dense_bias = shared.value
        out = []
        for p in pooled_chunks(rho, theta, vals, grid):
            out.extend((_convolve(p, conv, conv_bias) @ dense + dense_bias).astype(np.float32))
        return pd.Series(out)

    arrays = patch_arrays(members, channels)
    variant = F.lit("flipped" if flipped else "straight")
    out = arrays.select("protein_id", F.col("center_vix").alias("vix"), variant.alias("variant"), score("rho", "theta", F.array(*channels)).alias("desc"))
    norm = F.sqrt(F.aggregate("desc", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return out.withColumn("norm", norm)


@dataclass
class InterfaceWeights:
    first: DescriptorWeights  # per-channel layer with 12-cell dense layer
    mix: np.ndarray  # cells, channels
    mix_bias: np.ndarray
    deep: list[tuple[np.ndarray, np.ndarray]]  # (channels*cells)^2 and bias, one per further layer
    head: list[tuple[np.ndarray, np.ndarray]]  # two dense layers

    @staticmethod
    def seeded(layers: int = 3, n_channels: int = 5, grid: PolarGrid = INTERFACE_GRID, seed: int = 0) -> "InterfaceWeights":
        r = np.random.default_rng(seed)
        n, c = n_channels * grid.size, grid.size
        deep = [(r.normal(size=(n, n)) / math.sqrt(n), np.zeros(n)) for _ in range(layers - 1)]
        head = [(r.normal(size=(n_channels, grid.n_theta)), np.zeros(grid.n_theta)), (r.normal(size=(grid.n_theta, 2)), np.zeros(2))]
        return InterfaceWeights(DescriptorWeights.seeded(n_channels, c, seed), r.normal(size=(c, n_channels)), np.zeros(n_channels), deep, head)


def gather_members(members: DataFrame, outputs: DataFrame, names: list[str]) -> DataFrame:
    """Patches rebuilt from per-vertex outputs: every member takes the values of its own vertex."""
    v = outputs.select("protein_id", F.col("vix").alias("member_vix"), *[F.col("out")[i].alias(n) for i, n in enumerate(names)])
    return members.select(*PATCH, "pos", "member_vix", "rho", "theta").join(large(v), ["protein_id", "member_vix"])


def interface_scores(members: DataFrame, weights: InterfaceWeights, grid: PolarGrid = INTERFACE_GRID, channels: tuple = CHANNELS) -> DataFrame:
    """Interface score per vertex: each further layer is one join of members with the outputs so far."""
    channels = list(channels)
    w = members.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<double>")
    def first(rho: pd.Series, theta: pd.Series, vals: pd.Series) -> pd.Series:
        f, k = w.value.first, w.value
        out = []
        for p in pooled_chunks(rho, theta, vals, grid):
            h = np.maximum(_convolve(p, f.conv, f.conv_bias) @ f.dense + f.dense_bias, 0.0)
            out.extend(np.maximum(h @ k.mix + k.mix_bias, 0.0))
        return pd.Series(out)

    def layer(i: int):
        @F.pandas_udf("array<double>")
        def deep(rho: pd.Series, theta: pd.Series, vals: pd.Series) -> pd.Series:
            conv, bias = w.value.deep[i]
            out = []
            for p in pooled_chunks(rho, theta, vals, grid):
                h = np.maximum((p.reshape(*p.shape[:2], -1) @ conv + bias).max(1), 0.0)
                out.extend(h.reshape(*p.shape[:1], p.shape[2], -1).mean(2))
            return pd.Series(out)

        return deep

    @F.pandas_udf("double")
    def head(h: pd.Series) -> pd.Series:
        (a, ab), (b, bb) = w.value.head
        z = np.maximum(np.stack(h.to_numpy()) @ a + ab, 0.0) @ b + bb
        return pd.Series(1 / (1 + np.exp(-z[:, 0])))

    def run(rows: DataFrame, f) -> DataFrame:
        arr = patch_arrays(rows, channels)
        return arr.select("protein_id", F.col("center_vix").alias("vix"), f("rho", "theta", F.array(*channels)).alias("out"))

    h = run(members, first)
    for i in range(len(weights.deep)):
        h = run(gather_members(members, h, channels), layer(i))
    return h.select("protein_id", "vix", head("out").alias("score"))
