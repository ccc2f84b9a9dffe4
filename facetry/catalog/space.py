"""Spatial joins, contacts, clashes and transforms over the point tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from facetry import fixtures
from facetry.catalog.registry import ATOMS, POINTS, query, r6
from facetry.functions.geometry import angle_at, apply_transform, compose_transforms, plane_deviation, transform_struct
from facetry.operators.contact import clash_counts, contact_counts, exposed_area, hotspot_string, hotspots, interface_rmsd, min_distances, rmsd, sphere_points
from facetry.operators.filters import clash_ok
from facetry.operators.fragments import fragment_classes, fragment_vectors, rmsd_clusters, rmsd_pairs, touching_fragments
from facetry.operators.patch import interpolate, label_interface, pocket_points
from facetry.operators.sequence import fragment_spans
from facetry.operators.spatial import argmin_to_point, ball, exists_within, nearest, radius_pairs
from facetry.plans.evaluation import farthest_atom, interface_center_point, middle_atom
from facetry.session import materialize

_D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
CENTER = (2.0, -1.0, 0.5)


@query("ball_filter", "WITH " + POINTS + " SELECT vix, round(sqrt((x-2)*(x-2)+(y+1)*(y+1)+(z-0.5)*(z-0.5)), 6) AS dist FROM pts WHERE sqrt((x-2)*(x-2)+(y+1)*(y+1)+(z-0.5)*(z-0.5)) < 8")
def ball_filter(spark, sf):
    return ball(fixtures.points(spark, sf), CENTER, 8.0).select("vix", r6("dist"))


@query("argmin_point", "WITH " + POINTS + " SELECT vix, round(sqrt((x-2)*(x-2)+(y+1)*(y+1)+(z-0.5)*(z-0.5)), 6) AS dist FROM pts ORDER BY sqrt((x-2)*(x-2)+(y+1)*(y+1)+(z-0.5)*(z-0.5)), vix LIMIT 1")
def argmin_point(spark, sf):
    return argmin_to_point(fixtures.points(spark, sf), CENTER, "vix").select("vix", r6("dist"))


def _chain(spark, sf, c, *cols):
    return fixtures.atoms(spark, sf).filter(F.col("chain") == c).select(*(cols or ("protein_id", "vix", "x", "y", "z")))


@query("radius_join", "WITH " + POINTS + f" SELECT a.vix AS vix, b.vix AS n_vix, round({_D}, 6) AS dist FROM pts a, pts b WHERE a.chain = 'A' AND b.chain = 'B' AND {_D} < 3")
def radius_join(spark, sf):
    cols = ("vix", "x", "y", "z")
    return radius_pairs(_chain(spark, sf, "A", *cols), _chain(spark, sf, "B", *cols), 3.0).select("vix", "n_vix", r6("dist"))


@query("nearest_neighbour", "WITH " + POINTS + f" SELECT vix, n_vix, round(d, 6) AS n_dist FROM (SELECT a.vix, b.vix AS n_vix, {_D} AS d FROM pts a, pts b WHERE a.chain = 'A' AND b.chain = 'B' QUALIFY row_number() OVER (PARTITION BY a.vix ORDER BY d, b.vix) = 1)")
def nearest_neighbour(spark, sf):
    return nearest(_chain(spark, sf, "A"), _chain(spark, sf, "B"), "vix").select("vix", "n_vix", r6("n_dist"))


@query(
    "knn_interpolate",
    "WITH " + POINTS + f""", k AS (SELECT a.vix, b.charge AS c, b.hphob AS h, {_D} AS d FROM pts a, pts b WHERE a.chain = 'A' AND b.chain = 'B' QUALIFY row_number() OVER (PARTITION BY a.vix ORDER BY d, b.vix) <= 4)
SELECT vix, round(sum(c/(d*d))/sum(1/(d*d)), 6) + 0.0 AS charge, round(sum(h/(d*d))/sum(1/(d*d)), 6) + 0.0 AS hphob FROM k GROUP BY vix""",
)
def knn_interpolate(spark, sf):
    known = fixtures.points(spark, sf).filter("chain = 'B'").select("vix", "x", "y", "z", "charge", "hphob")
    out = interpolate(_chain(spark, sf, "A", "vix", "x", "y", "z"), known, "vix", ["charge", "hphob"])
    return out.select("vix", r6("charge"), r6("hphob"))


@query("nearest_within_bound", "WITH " + POINTS + f" SELECT a.protein_id, count(DISTINCT a.vix) AS n FROM pts a, pts b WHERE a.chain = 'A' AND b.chain = 'B' AND {_D} <= 2 GROUP BY a.protein_id")
def nearest_within_bound(spark, sf):
    near = exists_within(_chain(spark, sf, "A"), _chain(spark, sf, "B"), "vix", 2.0)
    return near.groupBy("protein_id").agg(F.count("*").alias("n"))


@query(
    "clash_gate",
    "WITH " + ATOMS + f""", near AS (SELECT DISTINCT a.protein_id, a.vix, a.atom FROM atm a, atm b WHERE a.chain = 'A' AND b.chain = 'B' AND b.atom NOT LIKE 'H%' AND {_D} <= 2.0),
c AS (SELECT protein_id, count(*) FILTER (atom = 'CA') AS ca, count(*) FILTER (atom NOT LIKE 'H%') AS heavy FROM near GROUP BY protein_id),
f AS (SELECT DISTINCT protein_id FROM atm WHERE chain = 'A'),
g AS (SELECT f.protein_id, coalesce(ca, 0) AS clashing_ca, CASE WHEN coalesce(ca, 0) > 3 THEN 0 ELSE coalesce(heavy, 0) END AS clashing_heavy FROM f LEFT JOIN c ON c.protein_id = f.protein_id)
SELECT *, clashing_ca <= 3 AND clashing_heavy <= 15 AS accepted FROM g""",
)
def clash_gate(spark, sf):
    cols = ("protein_id", "vix", "atom", "x", "y", "z")
    wall = _chain(spark, sf, "B", "vix", "atom", "x", "y", "z").filter(~F.col("atom").startswith("H"))
    c = clash_counts(_chain(spark, sf, "A", *cols), wall, ["protein_id"], "vix", 2.0, 3)
    return c.withColumn("accepted", clash_ok(3, 15))


@query(
    "contact_counts",
    "WITH " + ATOMS + f""", r AS (SELECT *, CASE element WHEN 'H' THEN 1.2 WHEN 'C' THEN 1.7 WHEN 'N' THEN 1.55 WHEN 'O' THEN 1.52 ELSE 1.2 END::DOUBLE AS rad FROM atm),
c AS (SELECT a.protein_id, count(DISTINCT a.vix) AS contacts FROM r a, r b WHERE a.chain = 'B' AND b.chain = 'A' AND {_D} < a.rad + b.rad + 0.2 GROUP BY a.protein_id)
SELECT f.protein_id, coalesce(contacts, 0) AS contacts FROM (SELECT DISTINCT protein_id FROM atm WHERE chain = 'B') f LEFT JOIN c ON c.protein_id = f.protein_id""",
)
def contact_counts_query(spark, sf):
    cols = ("protein_id", "vix", "element", "x", "y", "z")
    return contact_counts(_chain(spark, sf, "B", *cols), _chain(spark, sf, "A", *cols[1:]), ["protein_id"], "vix", "vix")


@query(
    "min_dist_per_residue",
    "WITH " + ATOMS + f""", m AS (SELECT a.protein_id, a.resid, min({_D}) AS d FROM atm a, atm b WHERE a.chain = 'B' AND b.chain = 'A' AND a.atom <> 'CA' GROUP BY ALL)
SELECT f.protein_id, f.resid, round(coalesce(d, 1000), 6) AS min_dist FROM (SELECT DISTINCT protein_id, resid FROM atm WHERE chain = 'B') f LEFT JOIN m ON m.protein_id = f.protein_id AND m.resid = f.resid""",
)
def min_dist_per_residue(spark, sf):
    a = _chain(spark, sf, "B", "protein_id", "resid", "atom", "x", "y", "z")
    m = min_distances(a, _chain(spark, sf, "A", "vix", "x", "y", "z"), ["protein_id", "resid"], "vix")
    return m.select("protein_id", "resid", r6("min_dist"))


@query(
    "hotspot_list",
    "WITH " + ATOMS + f""", fr AS (SELECT *, resid // 10 AS fragment FROM atm WHERE chain = 'B'),
m AS (SELECT a.protein_id, a.fragment, a.resid, min({_D}) AS d FROM fr a, atm b WHERE b.chain = 'A' AND a.atom <> 'CA' GROUP BY ALL),
st AS (SELECT protein_id, fragment, min(resid) AS start FROM fr GROUP BY ALL),
h AS (SELECT st.protein_id, st.fragment, coalesce(array_to_string(list(m.resid - start + 1 ORDER BY m.resid) FILTER (m.resid IS NOT NULL), ':'), '') AS spots
  FROM st LEFT JOIN m ON m.protein_id = st.protein_id AND m.fragment = st.fragment AND m.d < 2.5 GROUP BY ALL)
SELECT protein_id, trim(array_to_string(list(spots ORDER BY fragment), ','), ',') AS hotspots FROM h GROUP BY protein_id""",
)
def hotspot_list(spark, sf):
    a = _chain(spark, sf, "B", "protein_id", "resid", "vix", "atom", "x", "y", "z").withColumn("fragment", F.floor(F.col("resid") / 10))
    keys = ["protein_id", "fragment"]
    m = min_distances(a, _chain(spark, sf, "A", "vix", "x", "y", "z"), [*keys, "resid"], "vix", within=2.5)
    return hotspot_string(hotspots(m, fragment_spans(a, keys, "resid", "vix").drop("length"), keys), "protein_id", "fragment")


# a quarter turn about z and a shift
MOVE = {"r11": 0.0, "r12": -1.0, "r13": 0.0, "r21": 1.0, "r22": 0.0, "r23": 0.0, "r31": 0.0, "r32": 0.0, "r33": 1.0, "tx": 1.5, "ty": -2.0, "tz": 0.25}


def _moved(p):
    x, y, z = apply_transform(("x", "y", "z"), transform_struct(MOVE))
    return p.withColumns({"x": x, "y": y, "z": z})


@query("apply_rigid_transform", "WITH " + POINTS + " SELECT vix, round(1.5 - y, 6) + 0.0 AS x, round(x - 2, 6) + 0.0 AS y, round(z + 0.25, 6) + 0.0 AS z FROM pts")
def apply_rigid_transform(spark, sf):
    return _moved(fixtures.points(spark, sf)).select("vix", r6("x"), r6("y"), r6("z"))


@query("compose_rigid_transforms", "WITH " + POINTS + " SELECT vix, round(1.5 - (x - 2), 6) + 0.0 AS x, round((1.5 - y) - 2, 6) + 0.0 AS y, round(z + 0.5, 6) + 0.0 AS z FROM pts")
def compose_rigid_transforms(spark, sf):
    p = fixtures.points(spark, sf).withColumn("t", transform_struct(MOVE))
    x, y, z = apply_transform(("x", "y", "z"), compose_transforms("t", "t"))
    return p.select("vix", r6(x, "x"), r6(y, "y"), r6(z, "z"))


_M = "mv AS (SELECT protein_id, vix, 1.5 - y AS x, x - 2 AS y, z + 0.25 AS z FROM pts)"


@query("rmsd_by_pair", "WITH " + POINTS + f", {_M} SELECT a.protein_id, round(sqrt(avg((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))), 6) AS rmsd, count(*) AS atoms FROM mv a JOIN pts b ON a.vix = b.vix GROUP BY a.protein_id")
def rmsd_by_pair(spark, sf):
    p = fixtures.points(spark, sf)
    return rmsd(_moved(p), p, ["protein_id"], "vix").select("protein_id", r6("rmsd"), "atoms")


_IRMSD = """ SELECT a.protein_id, round(sqrt(avg((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))), 6) AS rmsd, count(*) AS atoms
FROM mv a JOIN pts b ON a.vix = b.vix WHERE b.chain = 'A' AND EXISTS (SELECT 1 FROM pts c WHERE c.chain = 'B' AND sqrt(({s}.x-c.x)*({s}.x-c.x)+({s}.y-c.y)*({s}.y-c.y)+({s}.z-c.z)*({s}.z-c.z)) {op} {r}) GROUP BY a.protein_id"""


@query("interface_rmsd", "WITH " + POINTS + f", {_M}" + _IRMSD.format(s="b", op="<", r=2.5))
def interface_rmsd_query(spark, sf):
    p = fixtures.points(spark, sf)
    a, b = p.filter("chain = 'A'"), p.filter("chain = 'B'")
    return interface_rmsd(_moved(a), a, b, ["protein_id"], "vix", "vix", 2.5).select("protein_id", r6("rmsd"), "atoms")


@query("interface_rmsd_moved_pose", "WITH " + POINTS + f", {_M}" + _IRMSD.format(s="a", op="<=", r=3.0))
def interface_rmsd_moved_pose(spark, sf):
    p = fixtures.points(spark, sf)
    a, b = p.filter("chain = 'A'"), p.filter("chain = 'B'")
    return interface_rmsd(_moved(a), a, b, ["protein_id"], "vix", "vix", 3.0, from_moved=True, closed=True).select("protein_id", r6("rmsd"), "atoms")


@query(
    "interface_center",
    "WITH " + POINTS + f""", i AS (SELECT a.* FROM pts a WHERE chain = 'A' AND EXISTS (SELECT 1 FROM pts b WHERE b.chain = 'B' AND {_D} < 2)),
m AS (SELECT protein_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM i GROUP BY protein_id),
v AS (SELECT p.protein_id, vix, x, y, z, sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)) AS d FROM pts p JOIN m ON m.protein_id = p.protein_id),
c AS (SELECT protein_id, count(*) FILTER (d < 4) AS n_near, arg_min(x, (d, vix)) AS x, arg_min(y, (d, vix)) AS y, arg_min(z, (d, vix)) AS z FROM v GROUP BY protein_id)
SELECT c.protein_id, n_near, round(CASE WHEN n_near < 3 THEN x ELSE mx END, 6) + 0.0 AS x, round(CASE WHEN n_near < 3 THEN y ELSE my END, 6) + 0.0 AS y, round(CASE WHEN n_near < 3 THEN z ELSE mz END, 6) + 0.0 AS z
FROM c JOIN m ON m.protein_id = c.protein_id""",
)
def interface_center(spark, sf):
    p = fixtures.points(spark, sf).select("protein_id", "chain", "vix", "x", "y", "z")
    other = p.filter("chain = 'B'").select(F.col("vix").alias("serial"), "x", "y", "z")
    # every protein of chain A meets the whole of chain B
    near = exists_within(p.filter("chain = 'A'"), other, "serial", 2.0, closed=False)
    c = interface_center_point(near.withColumn("serial", F.col("vix")), near.withColumn("serial", F.col("vix")), p, ["protein_id"], 1.0, 4.0, 3)
    return c.select("protein_id", "n_near", r6("x"), r6("y"), r6("z"))


@query(
    "angles_and_planes",
    "WITH " + POINTS + """, s AS (SELECT vix, x, y, z, nx, ny, nz, score FROM pts),
g AS (SELECT vix, acos(greatest(-1, least(1, (-nx*0 + -ny*0 + -nz*1)))) AS ang FROM s)
SELECT g.vix, round(ang, 6) AS angle, round(greatest(0, 1 - (abs(ang - 2*pi()/3)/(pi()/3))*(abs(ang - 2*pi()/3)/(pi()/3))), 6) AS penalty,
round(least(abs(atan2(ny, nx)), pi() - abs(atan2(ny, nx))), 6) AS plane FROM g JOIN s ON s.vix = g.vix""",
)
def angles_and_planes(spark, sf):
    """Angle between the reversed normal and z, its penalty, and the fold of the normal about the z axis."""
    p = fixtures.points(spark, sf)
    zero, up = (F.lit(0.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    back = tuple(-F.col(c) for c in ("nx", "ny", "nz"))
    ang = angle_at(back, zero, up)
    dev = F.abs(ang - 2 * math.pi / 3) / (math.pi / 3)
    # dihedral of x, origin, z, z + normal
    tip = (F.col("nx"), F.col("ny"), F.col("nz") + 1.0)
    plane = plane_deviation((F.lit(1.0), F.lit(0.0), F.lit(0.0)), zero, up, tip)
    return p.select("vix", r6(ang, "angle"), r6(F.greatest(F.lit(0.0), 1 - dev * dev), "penalty"), r6(plane, "plane"))


_SPHERE = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for a, b, c in sphere_points(24))


@query(
    "exposed_area",
    "WITH " + ATOMS + f""", ball AS (SELECT protein_id, vix, x, y, z, CASE WHEN element = 'H' THEN 1.2 ELSE 1.7 END + 1.4 AS r FROM atm),
sp(a, b, c) AS (VALUES {_SPHERE}),
pt AS (SELECT protein_id, vix, r, x + r * a AS x, y + r * b AS y, z + r * c AS z FROM ball, sp),
lit AS (SELECT p.protein_id, p.vix, p.r, NOT EXISTS (SELECT 1 FROM ball o WHERE o.protein_id = p.protein_id AND o.vix <> p.vix
  AND (o.x-p.x)*(o.x-p.x)+(o.y-p.y)*(o.y-p.y)+(o.z-p.z)*(o.z-p.z) < (o.r - 1e-9)*(o.r - 1e-9)) AS free FROM pt p)
SELECT protein_id, count(DISTINCT vix) AS atoms, round(sum(CASE WHEN free THEN 4 * pi() * r * r / 24 ELSE 0 END), 6) AS area FROM lit GROUP BY protein_id""",
)
def exposed_area_query(spark, sf):
    a = fixtures.atoms(spark, sf)
    r = F.when(F.col("element") == "H", 1.2).otherwise(1.7)
    out = exposed_area(a.withColumn("radius", r), ["protein_id"], "vix", "radius", n_points=24, on=["protein_id"])
    return out.groupBy("protein_id").agg(F.count("*").alias("atoms"), F.sum("area").alias("a")).select("protein_id", "atoms", r6("a", "area"))


# the two partners of a complex: every protein and its moved copy
@query("nearest_within_key", "WITH " + POINTS + f", {_M} SELECT protein_id, vix, n_vix, round(d, 6) AS n_dist FROM (SELECT a.protein_id, a.vix, b.vix AS n_vix, {_D} AS d FROM pts a JOIN mv b ON a.protein_id = b.protein_id QUALIFY row_number() OVER (PARTITION BY a.vix ORDER BY d, b.vix) = 1)")
def nearest_within_key(spark, sf):
    p = fixtures.points(spark, sf).select("protein_id", "vix", "x", "y", "z")
    return nearest(p, _moved(p), "vix", ["protein_id"]).select("protein_id", "vix", "n_vix", r6("n_dist"))


@query("interface_label", "WITH " + POINTS + f", {_M} SELECT a.vix, CASE WHEN min({_D})*min({_D}) >= 2.0 THEN 1.0 ELSE 0.0 END AS iface_label FROM pts a JOIN mv b ON a.protein_id = b.protein_id GROUP BY a.vix")
def interface_label(spark, sf):
    p = fixtures.points(spark, sf).select("protein_id", "vix", "x", "y", "z")
    return label_interface(p, _moved(p)).select("vix", "iface_label")


@query("pocket_labels", "WITH " + POINTS + f", lig AS (SELECT protein_id, vix, 1.5 - y AS x, x - 2 AS y, z + 0.25 AS z, CASE WHEN charge > 0 THEN 1 ELSE 0 END AS ix FROM pts) SELECT a.protein_id, ix AS ligand_ix, a.vix, ix + 1 AS ligand_class FROM pts a JOIN lig b ON a.protein_id = b.protein_id WHERE {_D} <= 3 GROUP BY ALL")
def pocket_labels(spark, sf):
    p = fixtures.points(spark, sf)
    ix = F.when(F.col("charge") > 0, 1).otherwise(0)
    lig = _moved(p).select("protein_id", ix.alias("ligand_ix"), (ix + 1).alias("ligand_class"), F.col("vix").alias("atom_ix"), "x", "y", "z")
    return pocket_points(p, lig)


@query("farthest_atom", "WITH " + POINTS + f", {_M}, n AS (SELECT a.protein_id, a.vix, min({_D}) AS d FROM pts a JOIN mv b ON a.protein_id = b.protein_id GROUP BY ALL) SELECT protein_id, vix AS serial, round(d, 6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY protein_id ORDER BY d DESC, vix) = 1")
def farthest_atom_query(spark, sf):
    p = fixtures.points(spark, sf).select("protein_id", F.col("vix").alias("serial"), "x", "y", "z")
    return farthest_atom(p, _moved(p), ["protein_id"]).select("protein_id", "serial", r6("distance"))


@query(
    "middle_atom",
    "WITH " + POINTS + f""", {_M}, i AS (SELECT a.* FROM pts a WHERE EXISTS (SELECT 1 FROM mv b WHERE a.protein_id = b.protein_id AND {_D} < 4)),
f AS (SELECT a.protein_id, a.vix, max({_D}) AS d FROM i a JOIN i b ON a.protein_id = b.protein_id GROUP BY ALL)
SELECT protein_id, vix AS serial, round(d, 6) AS reach FROM f QUALIFY row_number() OVER (PARTITION BY protein_id ORDER BY d, vix) = 1""",
)
def middle_atom_query(spark, sf):
    p = fixtures.points(spark, sf).select("protein_id", F.col("vix").alias("serial"), "x", "y", "z")
    return middle_atom(p, _moved(p), ["protein_id"], 4.0).select("protein_id", "serial", r6("reach"))


# peptides: hundred atoms each, in five placements: as they are (twice), and drifting further with the placement number
FRAGMENT_CUTOFF = 1.2
_FRAGMENTS = "WITH RECURSIVE " + ATOMS + """,
pl AS (SELECT (vix // 100) * 10 + k AS frag, resid, atom, x + greatest(k - 1, 0) * descr[12] * 5 AS x, y + greatest(k - 1, 0) * descr[13] * 5 AS y, z + greatest(k - 1, 0) * descr[14] * 5 AS z
  FROM atm, range(5) t(k)),
dots AS (SELECT x + 1 AS x, y, z FROM pts WHERE vix % 10 = 7),
near AS (SELECT a.frag, a.resid, count(*) AS n FROM pl a WHERE EXISTS (SELECT 1 FROM dots b WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 3) GROUP BY ALL),
res AS (SELECT d.frag, d.resid, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY d.frag ORDER BY d.resid) - 1 AS ord FROM (SELECT DISTINCT frag, resid FROM pl) d LEFT JOIN near ON near.frag = d.frag AND near.resid = d.resid),
win AS (SELECT frag, ord AS start FROM (SELECT frag, ord, sum(n) OVER w AS total, count(*) OVER w AS c FROM res WINDOW w AS (PARTITION BY frag ORDER BY ord ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
  WHERE c = 12 QUALIFY row_number() OVER (PARTITION BY frag ORDER BY total DESC, ord) = 1),
ca AS (SELECT pl.frag, ord - start AS pos, x, y, z FROM pl JOIN res ON res.frag = pl.frag AND res.resid = pl.resid JOIN win ON win.frag = pl.frag WHERE atom = 'CA' AND ord - start BETWEEN 0 AND 11),
rms AS (SELECT a.frag AS f, b.frag AS g, sqrt(sum((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) / 12) AS rmsd FROM ca a JOIN ca b ON a.pos = b.pos GROUP BY ALL HAVING count(*) = 12),
cls AS (SELECT f AS frag, min(g) AS class_id FROM rms WHERE rmsd = 0 GROUP BY f)"""


def _fragments(spark, sf):
    a = fixtures.atoms(spark, sf).join(fixtures.descriptors(spark, sf).select("vix", "desc"), "vix").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    drift = F.greatest(F.col("k") - 1, F.lit(0))
    moved = {c: F.col(c) + drift * F.col("desc")[i] * 5 for c, i in zip("xyz", (11, 12, 13))}
    a = a.withColumns({**moved, "frag": F.expr("(vix div 100) * 10 + k")}).select("frag", "resid", "atom", "x", "y", "z")
    dots = fixtures.points(spark, sf).filter("vix % 10 = 7").select(F.col("vix").alias("dot"), (F.col("x") + 1).alias("x"), "y", "z")
    v = materialize(fragment_vectors(touching_fragments(materialize(a), dots, "dot", "frag"), "frag"))
    return v, materialize(fragment_classes(v, "frag"))


@query(
    "fragment_rmsd_pairs",
    _FRAGMENTS + f" SELECT f AS class_id, g AS n_class_id, round(rmsd, 6) AS rmsd FROM rms WHERE f < g AND rmsd <= {FRAGMENT_CUTOFF} AND f IN (SELECT class_id FROM cls) AND g IN (SELECT class_id FROM cls)",
)
def fragment_rmsd_pairs(spark, sf):
    return rmsd_pairs(_fragments(spark, sf)[1], FRAGMENT_CUTOFF).select("class_id", "n_class_id", r6("rmsd"))


@query(
    "fragment_rmsd_clusters",
    _FRAGMENTS + f""", reach(f, g) AS (SELECT frag, frag FROM cls UNION SELECT reach.f, rms.g FROM reach JOIN rms ON rms.f = reach.g WHERE rmsd <= {FRAGMENT_CUTOFF})
SELECT cls.frag, class_id, min(g) AS cluster_id FROM cls JOIN reach ON reach.f = cls.frag GROUP BY ALL""",
)
def fragment_rmsd_clusters(spark, sf):
    v, classes = _fragments(spark, sf)
    return rmsd_clusters(v, classes, materialize(rmsd_pairs(classes, FRAGMENT_CUTOFF)), "frag")
