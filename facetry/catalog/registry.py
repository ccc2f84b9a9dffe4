from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded output; adding zero turns -0.0 into 0.0."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + 0.0).alias(name or c)


# SQL views of the domain tables, shared by the counterparts
POINTS = """
raw AS (SELECT label AS protein_id, vec_id AS vix, embedding::DOUBLE[] AS e FROM embeddings),
pts AS (SELECT protein_id, vix, CASE WHEN protein_id < 5 THEN 'A' ELSE 'B' END AS chain, e AS descr,
  e[1]*50 AS x, e[2]*50 AS y, e[3]*50 AS z,
  e[4]/sqrt(e[4]*e[4]+e[5]*e[5]+e[6]*e[6]) AS nx, e[5]/sqrt(e[4]*e[4]+e[5]*e[5]+e[6]*e[6]) AS ny, e[6]/sqrt(e[4]*e[4]+e[5]*e[5]+e[6]*e[6]) AS nz,
  (e[8]+1)/2 AS score, e[9] AS charge, e[10] AS hbond, e[11] AS hphob FROM raw)"""

ATOMS = (
    POINTS
    + """,
atm AS (SELECT *, ['C','N','O','H'][vix % 4 + 1] AS element, vix // 5 AS resid,
  CASE WHEN vix % 5 = 0 THEN 'CA' ELSE ['C','N','O','H'][vix % 4 + 1] || 'X' END AS atom FROM pts)"""
)

def lattice_sql(p: str = "", z: str = "e[1]*0.5") -> str:
    """Lattice vertices, faces and edges; ``p`` prefixes the view names."""
    return f"""
{p}lraw AS (SELECT vec_id // 100 AS protein_id, (vec_id % 100)::INT AS vix, embedding::DOUBLE[] AS e FROM embeddings),
{p}lat AS (SELECT protein_id, vix, (vix % 10)::DOUBLE AS x, (vix // 10)::DOUBLE AS y, {z} AS z, e[9] AS charge, e[10] AS hbond, e[11] AS hphob, (e[8]+1)/2 AS score FROM {p}lraw),
{p}cells AS (SELECT protein_id, vix FROM {p}lat WHERE vix % 10 < 9 AND vix < 90),
{p}fac AS (SELECT protein_id, (vix*2)::INT AS fix, vix::INT AS v0, (vix+1)::INT AS v1, (vix+10)::INT AS v2 FROM {p}cells
  UNION ALL SELECT protein_id, (vix*2+1)::INT, (vix+1)::INT, (vix+11)::INT, (vix+10)::INT FROM {p}cells),
{p}epairs AS (SELECT DISTINCT protein_id, s, t FROM (
  SELECT protein_id, v0 s, v1 t FROM {p}fac UNION ALL SELECT protein_id, v1, v0 FROM {p}fac UNION ALL SELECT protein_id, v0, v2 FROM {p}fac
  UNION ALL SELECT protein_id, v2, v0 FROM {p}fac UNION ALL SELECT protein_id, v1, v2 FROM {p}fac UNION ALL SELECT protein_id, v2, v1 FROM {p}fac)),
{p}edg AS (SELECT p.protein_id, s AS src, t AS dst, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS w
  FROM {p}epairs p JOIN {p}lat a ON a.protein_id=p.protein_id AND a.vix=s JOIN {p}lat b ON b.protein_id=p.protein_id AND b.vix=t)"""


def geodesic_sql(cutoff: float, p: str = "", z: str = "e[1]*0.5") -> str:
    """All walks up to the cutoff; the shortest one is the geodesic."""
    return (
        lattice_sql(p, z)
        + f""",
{p}walk(protein_id, src, v, d) AS (SELECT protein_id, vix, vix, 0.0::DOUBLE FROM {p}lat
  UNION SELECT k.protein_id, k.src, g.dst, k.d + g.w FROM {p}walk k JOIN {p}edg g ON g.protein_id=k.protein_id AND g.src=k.v WHERE k.d + g.w <= {cutoff}),
{p}geo AS (SELECT protein_id, src, v, min(d) AS d FROM {p}walk GROUP BY ALL)"""
    )


def normals_sql(p: str = "") -> str:
    """Vertex normals of the lattice views, outward by the sign of (v - centroid) . n."""
    return f""",
{p}fc AS (SELECT f.protein_id, v0, v1, v2, (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS cx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS cy, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS cz
  FROM {p}fac f JOIN {p}lat a ON a.protein_id=f.protein_id AND a.vix=v0 JOIN {p}lat b ON b.protein_id=f.protein_id AND b.vix=v1 JOIN {p}lat c ON c.protein_id=f.protein_id AND c.vix=v2),
{p}fn AS (SELECT protein_id, unnest([v0, v1, v2]) AS vix, cx/sqrt(cx*cx+cy*cy+cz*cz) AS fx, cy/sqrt(cx*cx+cy*cy+cz*cz) AS fy, cz/sqrt(cx*cx+cy*cy+cz*cz) AS fz FROM {p}fc),
{p}vs AS (SELECT protein_id, vix, sum(fx) AS sx, sum(fy) AS sy, sum(fz) AS sz FROM {p}fn GROUP BY ALL),
{p}un AS (SELECT l.protein_id, l.vix, x, y, z, charge, hbond, hphob, score, sx/sqrt(sx*sx+sy*sy+sz*sz) AS ux, sy/sqrt(sx*sx+sy*sy+sz*sz) AS uy, sz/sqrt(sx*sx+sy*sy+sz*sz) AS uz
  FROM {p}lat l JOIN {p}vs s ON s.protein_id=l.protein_id AND s.vix=l.vix),
{p}cen AS (SELECT protein_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM {p}un GROUP BY protein_id),
{p}vote AS (SELECT u.protein_id, CASE WHEN sum((x-mx)*ux+(y-my)*uy+(z-mz)*uz) < 0 THEN -1.0 ELSE 1.0 END AS s FROM {p}un u JOIN {p}cen c ON c.protein_id=u.protein_id GROUP BY u.protein_id),
{p}vn AS (SELECT u.protein_id, vix, x, y, z, charge, hbond, hphob, score, ux*s AS nx, uy*s AS ny, uz*s AS nz FROM {p}un u JOIN {p}vote v ON v.protein_id=u.protein_id)"""


DESIGNS = """
des AS (SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS description, l_suppkey AS seed, -l_extendedprice/1000 AS ddg,
  l_quantity*50 AS sasa, 1-l_discount*3 AS sc, l_linenumber AS hbonds, (l_partkey % 4)::INT AS bunsh,
  (-l_extendedprice/1000)/(l_quantity*50)*1000 AS nddg FROM lineitem)"""
