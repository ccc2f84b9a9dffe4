"""Driver tables seen as surface tables, one function per domain table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions.geometry import norm3
from facetry.functions.vector import as_double, vec_norm

LATTICE = 10  # vertices per side of one lattice surface


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def descriptors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    d = e.select(F.col("label").alias("protein_id"), F.col("vec_id").alias("vix"), as_double("embedding").alias("desc"))
    return d.withColumn("norm", vec_norm("desc")).withColumn("score", (F.col("desc")[7] + 1) / 2)


def points(spark, sf_dir) -> DataFrame:
    """Vertices with normals and attributes; chain A holds labels below 5."""
    e = table(spark, sf_dir, "embeddings")
    d = lambda i: F.col("embedding")[i].cast("double")
    p = e.select(
        F.col("label").alias("protein_id"),
        F.col("vec_id").alias("vix"),
        F.when(F.col("label") < 5, F.lit("A")).otherwise(F.lit("B")).alias("chain"),
        *[(d(i) * 50).alias(c) for i, c in enumerate("xyz")],
        *[d(i + 3).alias(f"_n{c}") for i, c in enumerate("xyz")],
        ((d(7) + 1) / 2).alias("score"),
        d(8).alias("charge"),
        d(9).alias("hbond"),
        d(10).alias("hphob"),
    )
    n = norm3(("_nx", "_ny", "_nz"))
    return p.select("*", *[(F.col(f"_n{c}") / n).alias(f"n{c}") for c in "xyz"]).drop("_nx", "_ny", "_nz")


def atoms(spark, sf_dir) -> DataFrame:
    """Points as atoms: element by vix mod 4, residue = 5 consecutive ids, name CA for every fifth."""
    p = points(spark, sf_dir).select("protein_id", "vix", "chain", "x", "y", "z")
    element = F.element_at(F.array(*[F.lit(e) for e in ("C", "N", "O", "H")]), (F.col("vix") % 4 + 1).cast("int"))
    return p.select(
        "*",
        element.alias("element"),
        F.floor(F.col("vix") / 5).cast("bigint").alias("resid"),
        F.when(F.col("vix") % 5 == 0, F.lit("CA")).otherwise(F.concat(element, F.lit("X"))).alias("atom"),
    )


def designs(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("description"),
        F.col("l_suppkey").alias("seed"),
        (-F.col("l_extendedprice") / 1000).alias("ddg"),
        (F.col("l_quantity") * 50).alias("sasa"),
        (1 - F.col("l_discount") * 3).alias("sc"),
        F.col("l_linenumber").alias("hbonds"),
        F.pmod("l_partkey", F.lit(4)).cast("int").alias("bunsh"),
    )


def attempts(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("target"), "event_type", F.col("event_id").alias("attempt"), "ts", F.col("value").alias("score"))


def lattice_vertices(spark, sf_dir) -> DataFrame:
    """Embedding rows laid out on square lattices with a bumpy height; one protein per full square."""
    side, size = LATTICE, LATTICE * LATTICE
    e = table(spark, sf_dir, "embeddings")
    d = lambda i: F.col("embedding")[i].cast("double")
    ix = F.col("vec_id") % size
    return e.select(
        F.floor(F.col("vec_id") / size).cast("bigint").alias("protein_id"),
        ix.cast("int").alias("vix"),
        (ix % side).cast("double").alias("x"),
        F.floor(ix / side).cast("double").alias("y"),
        (d(0) * 0.5).alias("z"),
        d(8).alias("charge"),
        d(9).alias("hbond"),
        d(10).alias("hphob"),
        ((d(7) + 1) / 2).alias("score"),
    )


def lattice_faces(vertices: DataFrame) -> DataFrame:
    """Two triangles per lattice cell whose four corners are at the usual places."""
    side = LATTICE
    cell = vertices.filter((F.col("vix") % side < side - 1) & (F.col("vix") < side * (side - 1)))
    v = F.col("vix")
    tri = lambda k, a, b, c: F.struct((v * 2 + k).cast("int").alias("fix"), a.cast("int").alias("v0"), b.cast("int").alias("v1"), c.cast("int").alias("v2"))
    both = F.array(tri(0, v, v + 1, v + side), tri(1, v + 1, v + side + 1, v + side))
    return cell.select("protein_id", F.explode(both).alias("f")).select("protein_id", "f.*")
