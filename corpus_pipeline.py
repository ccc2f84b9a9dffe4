"""Training-corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. ``run`` writes each result
to the shared checkpoint folder and reads it back as the next stage's input. Rows are matched by id and text hash, null ids included.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import materialize, table
from facetry.llm.decontaminate import decontaminate
from facetry.llm.line_dedup import line_dedup
from facetry.llm.near_dups import near_duplicates
from facetry.llm.packing import pack, to_pieces
from facetry.llm.quality import classified


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of the text) is not in ``gone`` (doc_id, h)."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    match = (F.xxhash64("text") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return docs.join(gone, match, "left_anti")


KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(stage):
    """Runs a stage with columns beyond ``KNOWN`` under names that no operator uses, and names them back."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in KNOWN else f"__extra{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])

    return run_stage


@_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return _without(docs, classified(docs, table(spark, sf_dir, "labels")).filter(~F.col("kept")))


@_apart
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from the texts; no document does."""
    cut = line_dedup(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


@_apart
def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id; of repeated rows one."""
    left = _without(docs, near_duplicates(docs, k=5, num=80, den=100).filter(~F.col("kept")))
    return left.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h")


@_apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return pack(materialize(to_pieces(docs)))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dups", near_dups), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
