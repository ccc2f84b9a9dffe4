"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.session import checkpoint_root, materialize

__all__ = ["table", "materialize", "shared_folder", "hash_bucket", "with_rank", "slots_for", "WORK", "uint64_mix", "filled", "unfilled"]

WORK = 2_000  # rows that one window partition should hold, on average
SLOTS = 1 << 16  # and the most of them; beyond it they get larger instead, still far below a task's memory


NO_ID = -(2**63)  # stands for a null id on the way through pandas, which would turn a column with nulls into floats


def filled(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def unfilled(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def slots_for(rows: int, each: int = WORK) -> int:
    return min(SLOTS, max(1, -(-rows // each)))


def hash_bucket(h: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 that rises with the unsigned top 31 bits of a 64-bit hash."""
    return F.shiftright(F.shiftrightunsigned(h, 33) * F.lit(buckets), 31)


def with_rank(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str, weight: str | None = None, total: str | None = None) -> DataFrame:
    """0-based position of each row within ``keys`` in the order (``bucket``, ``order``), without gathering a key in one task.

    ``bucket`` has to hold bounded groups of rows; its totals are added up per key. With ``weight`` a row
    stands for that many rows and gets the position of the first. ``df`` should be a written table, as it
    is read twice. Key and bucket columns must not be null.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*keys, bucket).agg(size.alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    if weight:
        local = F.coalesce(F.sum(weight).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        local = F.row_number().over(inner) - 1
    out = df.withColumn("_local", local).join(offsets.drop("_n"), [*keys, bucket])
    return out.withColumn(name, (F.col("_local") + F.col("_off")).cast("long")).drop("_local", "_off")




def uint64_mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over an array of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
