"""Shards that all hold the same mixture of sources (proportional stratified interleaving).

Rows of a source are put in a seeded order and ranked; a row's place is (rank + phase) / rows of the
source, so each source is spread evenly over [0, 1). Sorting all rows by place and cutting the order into
equal runs gives shards whose row counts differ by at most one and whose share of each source differs from the
source's share of the whole by about a row. Everything is built from DataFrame functions.

Defined results: a null text has no bytes; null ids and null sources are ordinary values (null sources form
one source); repeated rows each get a slot of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import WORK, hash_bucket, materialize, slots_for, table, with_rank

SHARDS = 24
SEED = 20_231
ROW_OVERHEAD = 8


def interleave(df: DataFrame, row: list[str], stratum: str, shards: int, seed: int = SEED, bucket_rows: int = WORK) -> DataFrame:
    """Columns ``row`` of every row of ``df`` with ``shard`` and ``slot`` (its place there).

    Equal rows are counted first and spread out at the end, so a row that is repeated without end never
    meets in one task; the phase of each source keeps many one-row sources apart.
    """
    at, seeded = "_stratum", F.xxhash64(F.lit(seed), F.col("_stratum"), F.col("_none"), *[F.col(c) for c in row])
    base = (
        df.select(*row, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias(at), F.col(stratum).isNull().alias("_none"))
        .groupBy(*row, at, "_none")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_h", seeded)
    )
    base = materialize(base)
    n = base.agg(F.sum("_copies")).first()[0] or 0
    buckets = slots_for(n, bucket_rows)
    base = base.withColumn("_b", hash_bucket(F.col("_h"), buckets))
    ranked = with_rank(base, [at, "_none"], "_b", ["_h", *row], "_rank", weight="_copies", total="_of")
    ranked = ranked.withColumn("_rank", F.explode(F.sequence(F.col("_rank"), F.col("_rank") + F.col("_copies") - 1)))
    phase = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col(at), F.col("_none")), 11) / F.lit(float(1 << 53))
    place = (F.col("_rank") + phase) / F.col("_of")
    placed = materialize(ranked.select(*row, at, "_none", "_rank", place.alias("_place")))
    placed = placed.withColumn("_b", F.least(F.floor(F.col("_place") * buckets), F.lit(buckets - 1)))
    ordered = with_rank(placed, [], "_b", ["_place", at, "_none", "_rank"], "_pos")
    shard = F.expr(f"_pos * {shards} div {max(n, 1)}")
    first = F.expr(f"(_shard * {n} + {shards - 1}) div {shards}")
    return ordered.withColumn("_shard", shard).select(*row, F.col("_shard").cast("int").alias("shard"), (F.col("_pos") - first).cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards under the law ``rows``."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = interleave(rows, ["doc_id", "size", "text_crc32"], "source", SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
