"""Parquet, CSV and JSON outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions.text import fixed


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "errorifexists") -> None:
    """All columns of a job or none: a failed job leaves no committed table."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, partition_by: list[str] = (), sort_by: list[str] = (), path: str | None = None) -> None:
    """Table bucketed on (protein, vertex), so a later join on them needs no shuffle and no protein fills a bucket.

    Rows are dealt to the buckets before they are written: one file per bucket (and partition) instead of one per task and bucket.
    ``path`` is a shared folder for the files; without it the table lies in the warehouse.
    """
    w = df.repartition(buckets, *keys).write.mode("errorifexists").format("parquet").bucketBy(buckets, *keys)
    if sort_by:
        w = w.sortBy(*sort_by)
    if path:
        w = w.option("path", path)
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)


def positional_join(spark: SparkSession, names: list[str], keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` of tables that :func:`write_bucketed` wrote with the same keys and buckets: bucket meets bucket, without a shuffle.

    Rows with a null key do not meet; other columns need different names.
    """
    out = spark.table(names[0])
    for name in names[1:]:
        out = out.join(spark.table(name).hint("merge"), keys)
    return out


def write_descriptors(straight: DataFrame, flipped: DataFrame, path: str) -> None:
    write_table(straight.unionByName(flipped), path, ["variant"])


def scores_on_mesh(vertices: DataFrame, scores: DataFrame) -> DataFrame:
    """Interface scores replace the vertex label."""
    s = scores.select("protein_id", "vix", F.col("score").alias("_s"))
    return vertices.join(s, ["protein_id", "vix"], "left").withColumn("iface_label", F.coalesce("_s", F.lit(0.0))).drop("_s")


def append_report(report: DataFrame, path: str) -> None:
    """Benchmark rows, one CSV line per run."""
    report.coalesce(1).write.mode("append").option("header", "true").csv(path)  # a single row


# Column order of the merged design score table.
DESIGN_COLUMNS = ["total_score", "buried_unsat_hbonds", "buried_unsat_hbonds2", "sasa", "sc", "hbonds", "ddG", "graft_RMSD", "array", "seed", "description"]


def design_lines(df: DataFrame, columns: list[str] = DESIGN_COLUMNS) -> DataFrame:
    """Selected columns, decimals fixed to three digits."""
    kinds = dict(df.dtypes)
    return df.select(*[fixed(c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns])


def write_design_table(df: DataFrame, path: str, columns: list[str] = DESIGN_COLUMNS) -> None:
    design_lines(df, columns).write.mode("errorifexists").option("header", "true").option("sep", "\t").csv(path)


def rmsd_json(fits: DataFrame) -> DataFrame:
    """One JSON document per structure from rows pdb_id, interactor, chain, rmsd, url."""
    chain = F.map_from_entries(F.array_sort(F.collect_list(F.struct("chain", F.struct("rmsd", F.col("url").alias("af2_pdb_url"))))))
    per = fits.groupBy("pdb_id", "interactor").agg(chain.alias("m"))  # a handful of chains
    doc = per.groupBy("pdb_id").agg(*[F.first(F.when(F.col("interactor") == i, F.col("m")), ignorenulls=True).alias(f"interactor_{i}") for i in (1, 2)])
    return doc.select("pdb_id", F.to_json(F.struct("pdb_id", "interactor_1", "interactor_2")).alias("value"))


def named_structures(structures: DataFrame, selected: DataFrame, key: str = "description") -> DataFrame:
    """Structure rows of the selected designs."""
    return structures.join(selected.select(key).distinct(), key, "left_semi")
