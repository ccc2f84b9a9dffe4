"""Scorers of placed patches: one protocol, three implementations."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.align.features import descriptor_score
from facetry.operators.sampling import sample_per_group

FEATURES = ("f_dist", "f_desc", "f_normal", "f_atom")
MAX_POINTS = 200


class Scorer(Protocol):
    def score(self, features: DataFrame, keys: list[str]) -> DataFrame:
        """Keys and ``score`` in [0, 1] per pose, from one row per placed point."""


def pooled_features(features: DataFrame, keys: list[str], names: tuple = FEATURES) -> DataFrame:
    """Fixed-length summary of a pose: mean and spread of each feature, share of near points."""
    agg = [F.avg(n).alias(f"mean_{n}") for n in names] + [F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias(f"sd_{n}") for n in names]
    return features.groupBy(*keys).agg(*agg, F.avg((F.col("nn_dist") < 1.5).cast("double")).alias("near_share"))

STEP_NUMBERS = 500_000  # numbers in the widest layer of one step


@dataclass
class HeuristicScorer:
    """Descriptor score squashed to [0, 1); ``half`` is the score worth 0.5."""

    half: float = 10.0

    def score(self, features: DataFrame, keys: list[str]) -> DataFrame:
        s = descriptor_score(features, keys)
        return s.select(*keys, (F.col("desc_dist_score") / (F.col("desc_dist_score") + self.half)).alias("score"))


@dataclass
class ClassifierScorer:
    """A fitted Spark ML pipeline over the pooled features."""

    model: PipelineModel

    def score(self, features: DataFrame, keys: list[str]) -> DataFrame:
        p = self.model.transform(pooled_features(features, keys))
        return p.select(*keys, vector_to_array("probability")[1].alias("score"))


@dataclass
class NetScorer:
    """Point-wise layers, mean over the padded points, dense layers, softmax; weights are given.

    ``points`` and ``dense``: lists of (matrix, bias, scale, shift); scale and shift hold the folded
    normalisation (None in dense layers).
    """

    points: list
    dense: list
    max_points: int = MAX_POINTS
    names: tuple = FEATURES

    @staticmethod
    def seeded(n_features: int = 4, seed: int = 42) -> "NetScorer":
        """Stand-in weights of the published shape."""
        r = np.random.default_rng(seed)
        widths, points, dense, last = (16, 32, 64, 128, 256), [], [], n_features
        for w in widths:
            points.append((r.normal(size=(last, w)) / math.sqrt(last), np.zeros(w), np.ones(w), np.zeros(w)))
            last = w
        for w in (128, 64, 32, 16, 8, 4, 2):
            dense.append((r.normal(size=(last, w)) / math.sqrt(last), np.zeros(w), None, None))
            last = w
        return NetScorer(points, dense)

    def _predict(self, batch: np.ndarray) -> np.ndarray:
        """(poses, points, features) -> probability of the positive class."""
        h = batch
        for m, b, scale, shift in self.points:
            h = np.maximum((h @ m + b) * scale + shift, 0.0)
        h = h.mean(1)
        for i, (m, b, *_) in enumerate(self.dense):
            h = h @ m + b
            if i + 1 < len(self.dense):
                h = np.maximum(h, 0.0)
        e = np.exp(h - h.max(1, keepdims=True))
        return e[:, 1] / e.sum(1)

    def _arrays(self, features: DataFrame, keys: list[str]) -> DataFrame:
        # the published limit of points per pose, chosen by hash
        part = sample_per_group(features, keys, ["vix"], self.max_points)
        g = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vix", *self.names))).alias("m"))
        # one row of plain numbers per pose: a Python object per point would fill the executor's Python
        return g.withColumn("x", F.flatten(F.transform("m", lambda p: F.array(*[p[n].cast("double") for n in self.names]))))

    def _padded(self, rows: list[np.ndarray]) -> np.ndarray:
        """Numbers of some poses as (poses, points, features), zeros behind the last point."""
        a = np.zeros((len(rows), self.max_points * len(self.names)))
        n = np.array([len(r) for r in rows])
        a[np.arange(a.shape[1]) < n[:, None]] = np.concatenate(rows)
        return a.reshape(len(rows), self.max_points, len(self.names))

    def score(self, features: DataFrame, keys: list[str]) -> DataFrame:
        net = features.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            s = net.value
            step = max(1, STEP_NUMBERS // (s.max_points * max(len(b) for _, b, *_ in s.points)))
            out = [np.empty(0)]
            for i in range(0, len(x), step):
                out.append(s._predict(s._padded(list(x.iloc[i : i + step]))))
            return pd.Series(np.concatenate(out))

        return self._arrays(features, keys).select(*keys, run("x").alias("score"))

    def point_importance(self, features: DataFrame, keys: list[str], cutoff: float = 0.9) -> DataFrame:
        """Change of the score when a point is blanked, scaled to +-1; zeros for large or low-scoring poses."""
        net = features.sparkSession.sparkContext.broadcast(self)
        size = features.groupBy(*keys).agg(F.count("*").alias("_n"))

        @F.pandas_udf("array<double>")
        def run(x: pd.Series, n: pd.Series) -> pd.Series:
            s, out = net.value, []
            for row, count in zip(x, n):
                base, points = s._padded([row])[0], len(row) // len(s.names)
                score = s._predict(base[None])[0]
                d = np.zeros(points)
                if count <= s.max_points and score > cutoff:
                    each = np.repeat(base[None], points, 0)
                    each[np.arange(points), np.arange(points)] = 0.0
                    d = s._predict(each) - score
                    top = np.abs(d).max()
                    d = d / top if top > 0 else d
                out.append(d)
            return pd.Series(out)

        a = self._arrays(features, keys).join(size, keys)
        a = a.select(*keys, F.arrays_zip(F.col("m.vix").alias("vix"), run("x", "_n").alias("importance")).alias("z"))
        return a.select(*keys, F.explode("z").alias("z")).select(*keys, "z.vix", "z.importance")
