"""Retrieval and classification metrics as grouped jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.scale import SEGMENT_ROWS, exact_percentiles, running, top_k


def auc(df: DataFrame, keys: list[str], score: Column, positive: Column, lower_is_better: bool = False, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Area under the ROC curve per group from the rank statistic, ties counted half.

    Equal scores are merged first; a group is then a sorted list of (score, positives, negatives)
    whose running sums are taken over segments, so no group has to fit one task. Null where a
    class is missing.
    """
    s = -score.cast("double") if lower_is_better else score.cast("double")
    merged = (
        df.select(*keys, s.alias("_s"), F.when(positive, 1).otherwise(0).cast("long").alias("_p"))
        .groupBy(*keys, "_s")
        .agg(F.sum("_p").alias("_pos"), F.sum(1 - F.col("_p")).alias("_neg"))
    )
    cum = running(merged, keys, ["_s"], {"_below": F.col("_neg")}, segment_rows)
    wins = F.sum(F.col("_pos") * (F.col("_below") - F.col("_neg") / 2))
    return cum.groupBy(*keys).agg(
        F.try_divide(wins, (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("auc"),
        F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"),
    )


def auc_summary(per_group: DataFrame, split: list[str]) -> DataFrame:
    """Mean and median over groups that have both classes."""
    ok = per_group.filter(F.col("auc").isNotNull())
    mean = ok.groupBy(*split).agg(F.avg("auc").alias("mean_auc"), F.count("*").alias("groups"))
    median = exact_percentiles(ok, split, "auc", {"median_auc": 0.5})
    return mean.join(median, split) if split else mean.join(F.broadcast(median))


def best_positive_rank(df: DataFrame, keys: list[str], score: str, positive: Column, lower_is_better: bool = False, worst: int | None = None) -> DataFrame:
    """1 + number of negatives better than the best positive; null without positives or beyond ``worst``."""
    pick = F.min if lower_is_better else F.max
    src = df.select(*keys, F.col(score).alias("_s"), positive.alias("_p"))
    best = src.groupBy(*keys).agg(pick(F.when(F.col("_p"), F.col("_s"))).alias("_best"))
    better = (F.col("_s") < F.col("_best")) if lower_is_better else (F.col("_s") > F.col("_best"))
    out = src.join(best, keys).groupBy(*keys).agg(
        F.max(F.col("_best").isNotNull()).alias("_has"), (F.count_if(~F.col("_p") & better) + 1).alias("rank")
    )
    rank = F.when(F.col("_has"), F.col("rank"))
    if worst is not None:
        rank = F.when(rank <= worst, rank)
    return out.select(*keys, rank.alias("rank"))


TOP_K = (2000, 1000, 100, 10, 5, 1)


def topk_counters(ranks: DataFrame, rank: str = "rank", ks: tuple[int, ...] = TOP_K) -> DataFrame:
    """One report row: totals, hits within each k, mean and median rank, failures."""
    r = F.col(rank)
    counts = ranks.agg(
        F.count("*").alias("total"),
        *[F.count_if(r <= k).alias(f"top{k}") for k in ks],
        F.avg(r).alias("mean_rank"),
        F.count_if(r.isNull()).alias("failed"),
    )
    median = exact_percentiles(ranks, [], rank, {"median_rank": 0.5})
    return counts.join(F.broadcast(median), how="left")


def recovery_curve(results: DataFrame, target: str, score: str, solved: Column, ks: list[int], tie: str, listed_only: bool = True) -> DataFrame:
    """Targets solved within the first k results, growing over k.

    ``listed_only`` keeps the published rule: only the ranks named in ``ks`` are looked at, and a
    target with no more than k results is skipped at k. Otherwise any rank up to k counts.
    """
    ks = sorted(ks)
    positive = [k for k in ks if k > 0]
    size = results.groupBy(target).agg(F.count("*").alias("_n"))
    src = results.select(target, F.col(score).alias("_s"), solved.alias("_ok"), F.col(tie).alias("_t"))
    head = top_k(src, [target], [F.desc("_s"), F.col("_t")], max(positive))
    if listed_only:
        hits = head.filter(F.col("rank").isin(positive) & F.col("_ok")).join(size, target).filter(F.col("_n") > F.col("rank"))
    else:
        hits = head.filter("_ok")
    first = hits.groupBy(target).agg(F.min("rank").alias("first"))
    row = first.agg(*[F.count_if(F.col("first") <= k).alias(str(k)) for k in ks])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("solved")) for k in ks])).alias("r")).select("r.*")


def confusion(df: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    return df.groupBy(truth).pivot(predicted, classes).count().na.fill(0).withColumnsRenamed({str(c): f"pred_{c}" for c in classes})


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def score_histogram(df: DataFrame, cls: str, score: str, bins: int = 100, low: float | None = None, high: float | None = None) -> DataFrame:
    """Density histogram per class; the last bin is closed, as is usual."""
    if low is None or high is None:
        edge = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
        low, high = float(edge["lo"]), float(edge["hi"])
    if high == low:  # a unit range around the single value
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    s = F.col(score)
    b = F.least(F.floor((s - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter((s >= low) & (s <= high)).groupBy(cls, b.alias("bin")).agg(F.count("*").alias("n"))
    total = df.filter((s >= low) & (s <= high)).groupBy(cls).agg(F.count("*").alias("total"))
    return counts.join(total, cls).select(cls, "bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def mean_by_class(df: DataFrame, cls: str, columns: list[str]) -> DataFrame:
    return df.groupBy(cls).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def class_balance(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split, label).agg(F.count("*").alias("n"))
