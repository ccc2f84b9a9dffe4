"""Order, coverage, rotation and all-metric cutoff queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry import fixtures
from facetry.catalog.registry import DESIGNS, query, r6
from facetry.functions.geometry import rotation_from_uniforms
from facetry.operators import sampling, select
from facetry.operators.scale import with_ordinals


@query("ordered_names", "SELECT c_custkey, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) - 1 AS pos FROM customer")
def ordered_names(spark, sf):
    """Places by name, cut into many segments of the order: equal leading letters must not matter."""
    c = fixtures.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return with_ordinals(c, ["c_mktsegment"], ["c_name", "c_custkey"], "pos", segment_rows=200).select("c_custkey", "c_name", "pos")


@query("display_sort", "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def display_sort(spark, sf):
    """Rows in the order in which a report shows them: highest value first, then key."""
    o = fixtures.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("_by"))
    return with_ordinals(o, [], ["_by", "o_orderkey"], "place", segment_rows=5000).drop("_by").orderBy("place")


@query(
    "split_cover",
    """WITH a AS (SELECT p_partkey FROM part WHERE p_size < 30), b AS (SELECT p_partkey FROM part WHERE p_size BETWEEN 28 AND 45)
SELECT count(*) FILTER (WHERE NOT (p_size < 30 OR p_size BETWEEN 28 AND 45)) AS left_over, count(*) FILTER (WHERE p_size < 30 AND p_size BETWEEN 28 AND 45) AS in_both FROM part""",
)
def split_cover(spark, sf):
    p = fixtures.table(spark, sf, "part")
    ids = lambda cond: p.filter(cond).select(F.col("p_partkey").alias("id"))
    return sampling.split_faults(p, "p_partkey", ids("p_size < 30"), ids("p_size between 28 and 45"))


_U = "(l_partkey % 997) / 997.0 AS u1, (l_suppkey % 89) / 89.0 AS u2, (l_orderkey % 1009) / 1009.0 AS u3"


@query(
    "random_rotation",
    f"""WITH u AS (SELECT l_orderkey, l_linenumber, {_U} FROM lineitem),
q AS (SELECT l_orderkey, l_linenumber, sqrt(1-u1)*sin(2*pi()*u2) AS x, sqrt(1-u1)*cos(2*pi()*u2) AS y, sqrt(u1)*sin(2*pi()*u3) AS z, sqrt(u1)*cos(2*pi()*u3) AS w FROM u)
SELECT l_orderkey, l_linenumber, round(w*w+x*x-y*y-z*z, 6) + 0.0 AS r11, round(2*x*y-2*w*z, 6) + 0.0 AS r12, round(2*x*z+2*w*y, 6) + 0.0 AS r13, round(w*w-x*x-y*y+z*z, 6) + 0.0 AS r33 FROM q""",
)
def random_rotation(spark, sf):
    """Rotation matrices from three even numbers each, against the quaternion product in SQL."""
    li = fixtures.table(spark, sf, "lineitem")
    u = li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 997 / 997.0).alias("u1"), (F.col("l_suppkey") % 89 / 89.0).alias("u2"), (F.col("l_orderkey") % 1009 / 1009.0).alias("u3"))
    r = rotation_from_uniforms("u1", "u2", "u3")
    return u.select("l_orderkey", "l_linenumber", *[r6(r[k], k) for k in ("r11", "r12", "r13", "r33")])


@query(
    "quantile_cutoffs_all",
    "WITH " + DESIGNS + """, m AS (SELECT l_suppkey % 7 AS bunsh2, l_quantity * 2 AS mol_contacts FROM lineitem)
SELECT round((SELECT quantile_cont(ddg, 0.75) FROM des), 6) AS cut_ddg, round((SELECT quantile_cont(nddg, 0.75) FROM des), 6) AS cut_nddg, round((SELECT quantile_cont(bunsh, 0.75) FROM des), 6) AS cut_bunsh,
  round((SELECT quantile_cont(bunsh2, 0.75) FROM m), 6) AS cut_bunsh2, round((SELECT quantile_cont(sc, 0.25) FROM des), 6) AS cut_sc, round((SELECT quantile_cont(hbonds, 0.25) FROM des), 6) AS cut_hbonds,
  round((SELECT quantile_cont(sasa, 0.25) FROM des), 6) AS cut_sasa, round((SELECT quantile_cont(mol_contacts, 0.25) FROM m), 6) AS cut_mol_contacts""",
)
def quantile_cutoffs_all(spark, sf):
    """Cutoffs of all eight published metrics."""
    li = fixtures.table(spark, sf, "lineitem")
    d = fixtures.designs(spark, sf).withColumn("nddg", select.normalized("ddg", "sasa"))
    more = li.select(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("description"), (F.col("l_suppkey") % 7).alias("bunsh2"), (F.col("l_quantity") * 2).alias("mol_contacts"))
    c = select.quantile_cutoffs(d.join(more, "description"))
    return c.select(*[r6(x) for x in c.columns])
