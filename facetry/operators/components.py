"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.session import materialize


def _lift(e: DataFrame, on: list[str]) -> DataFrame:
    """Every node hands its larger neighbours on to the smallest node it knows."""
    both = e.unionByName(e.select(*on, F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(*on, "u").agg(F.min("v").alias("_m"))
    out = both.join(low, [*on, "u"]).filter(F.col("v") > F.col("u"))
    return out.select(*on, F.col("v").alias("u"), F.least("u", "_m").alias("v")).distinct()


def _gather(e: DataFrame, on: list[str]) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, on to the smallest of them."""
    low = e.groupBy(*on, "u").agg(F.min("v").alias("_m"))
    rest = e.join(low, [*on, "u"]).filter(F.col("v") > F.col("_m")).select(*on, F.col("v").alias("u"), F.col("_m").alias("v"))
    return rest.unionByName(low.withColumnRenamed("_m", "v")).distinct()


def connected(edges: DataFrame, a: str, b: str, on: list[str] = ()) -> DataFrame:
    """(``on``, node, component) of every node that has an edge to another one: component is its smallest reachable node.

    Edges only join nodes with equal ``on``; direction, repeats and loops do not matter, edges with a null end are left out.
    The two steps alternate until the edges stay the same, which takes in the order of log^2 rounds; each round is one written table,
    and no group is ever gathered: minima are combined before the shuffle, and joins on a hot node can be split.
    """
    on = list(on)
    e = edges.select(*on, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    e, before = materialize(e.distinct()), None
    while True:
        e = materialize(_gather(_lift(e, on), on))
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64(*on, "u", "v"))).first()
        if state == before:
            break
        before = state
    roots = e.select(*on, F.col("v").alias("node")).distinct()
    return e.select(*on, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
