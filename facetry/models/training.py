"""Training and evaluation jobs for the alignment classifier and the pocket classes."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.sampling import hash_number, sample_per_group
from facetry.operators.scale import top_k


def sample_alignments(poses: DataFrame, target: str, pose: str, max_rmsd: float = 2.0, n_pos: int = 1, n_neg: int = 100, seed: int = 0) -> DataFrame:
    """Fixed numbers of positives (rmsd below the limit) and negatives per target, with class weights 1/n.

    An infinite rmsd is a negative. Targets without a positive or with too few negatives are left out.
    """
    labelled = poses.withColumn("label", F.when(F.col("rmsd") < max_rmsd, 1).otherwise(0))
    size = labelled.groupBy(target).agg(F.sum("label").alias("_p"), F.sum(1 - F.col("label")).alias("_q"))
    ok = size.filter((F.col("_p") >= 1) & (F.col("_q") >= n_neg)).select(target)
    rows = labelled.join(ok, target, "left_semi")
    pos = sample_per_group(rows.filter("label = 1"), [target], [pose], n_pos, seed)
    neg = sample_per_group(rows.filter("label = 0"), [target], [pose], n_neg, seed)
    return pos.withColumn("weight", F.lit(1.0 / n_pos)).unionByName(neg.withColumn("weight", F.lit(1.0 / n_neg)))


def fit_classifier(train: DataFrame, inputs: list[str], trees: bool = False, seed: int = 42) -> PipelineModel:
    """Weighted classifier over pooled features."""
    stages = [VectorAssembler(inputCols=inputs, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features")]
    cls = GBTClassifier if trees else LogisticRegression
    extra = {"seed": seed, "maxIter": 20} if trees else {"maxIter": 50, "regParam": 1e-3}
    return Pipeline(stages=[*stages, cls(labelCol="label", weightCol="weight", **extra)]).fit(train)


def pocket_samples(points: DataFrame, keys: list[str], point: str, n_samples: int = 100, size: int = 32, seed: int = 0) -> DataFrame:
    """Repeated random subsets of pockets that have at least ``size`` points."""
    big = points.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= size).drop("_n")
    src = points.join(big, keys, "left_semi").withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n_samples))))
    src = src.withColumn("_h", hash_number(*keys, "sample", point, seed=seed))
    return top_k(src, [*keys, "sample"], [F.col("_h"), F.col(point)], size, "_r").drop("_h", "_r")


def first_points(points: DataFrame, keys: list[str], point: str, size: int = 32) -> DataFrame:
    """The first ``size`` points of each pocket."""
    return top_k(points, keys, [F.col(point)], size, "_r").drop("_r")


def pocket_predictions(scored: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """Mean class probabilities over the samples of a pocket and the winning class (first on ties)."""
    mean = scored.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in classes])
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("p"), F.lit(-i).alias("i")) for i, c in enumerate(classes)]))
    return mean.withColumn("predicted", -best["i"])
