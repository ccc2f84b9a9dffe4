"""Reproducible sampling, shuffling, splits and negative pairing, all driven by hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.scale import SEGMENT_ROWS, top_k, with_ordinals


def hash_number(*cols: str | Column, seed: int = 0) -> Column:
    """48-bit number from the digest of the id; other engines can compute the same."""
    parts = [F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")


def sample_per_group(df: DataFrame, keys: list[str], ids: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows per group without replacement."""
    df = df.withColumn("_h", hash_number(*ids, seed=seed))
    return top_k(df, keys, [F.col("_h"), *[F.col(i) for i in ids]], n, "_r").drop("_h", "_r")


def shuffled_ordinals(df: DataFrame, keys: list[str], ids: list[str], seed: int = 0, name: str = "pos", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Position of each row in a random but repeatable order."""
    df = df.withColumn("_h", hash_number(*ids, seed=seed))
    return with_ordinals(df, keys, ["_h", *ids], name, segment_rows).drop("_h")


def repaired(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, seed: int = 0, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Negative pairs: the right side is permuted inside its group and paired by position."""
    a = with_ordinals(left, keys, [left_id], "_pos", segment_rows)
    b = shuffled_ordinals(right, keys, [right_id], seed, "_pos", segment_rows)
    return a.join(b, [*keys, "_pos"]).drop("_pos")


def split_column(ids: list[str], fractions: dict[str, float], seed: int = 0) -> Column:
    """Train/validation/test by the hash bucket of the id."""
    u = hash_number(*ids, seed=seed) / F.lit(float(1 << 48))
    out, edge = None, 0.0
    names = list(fractions)
    for name in names[:-1]:
        edge += fractions[name]
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


# Shares of the pocket data set.
POCKET_SPLIT = {"train": 0.72, "val": 0.08, "test": 0.20}


def listed_split(df: DataFrame, id_col: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """Split by membership lists; ids on neither list are left out."""
    a = df.join(train.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi").withColumn("split", F.lit("train"))
    b = df.join(test.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi").withColumn("split", F.lit("test"))
    return a.unionByName(b)


def split_faults(df: DataFrame, id_col: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: how many distinct ids lie on neither list (``left_over``) and on both (``in_both``)."""
    side = lambda lst, name: lst.select(F.col("id").alias(id_col)).distinct().withColumn(name, F.lit(1))
    ids = df.select(id_col).distinct().join(side(train, "_a"), id_col, "left").join(side(test, "_b"), id_col, "left")
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return ids.agg(count(~a & ~b).alias("left_over"), count(a & b).alias("in_both"))


def assert_split_covers(df: DataFrame, id_col: str, train: DataFrame, test: DataFrame) -> None:
    """Raise unless every id lies on exactly one list."""
    found = split_faults(df, id_col, train, test).first()
    if found["left_over"] or found["in_both"]:
        raise ValueError(f"{found['left_over']} ids on neither list, {found['in_both']} on both")


def shard(id_col: Column, n: int = 1000) -> Column:
    return F.pmod(id_col, F.lit(n))
