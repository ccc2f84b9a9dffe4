"""Mesh, geodesic, patch and model queries over lattice surfaces derived from the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry import fixtures
from facetry.catalog.registry import geodesic_sql, lattice_sql, normals_sql, query, r6
from facetry.functions.chem import flip_features, normalize_charge, shape_index
from facetry.operators import geodesic, mesh, patch
from facetry.operators.scale import large

CUTOFF = 2.6


def surface(spark, sf):
    v = fixtures.lattice_vertices(spark, sf)
    return v, fixtures.lattice_faces(v)


def with_normals(spark, sf):
    v, f = surface(spark, sf)
    return v.join(large(mesh.vertex_normals(v, f)), ["protein_id", "vix"]), f


def geo(spark, sf, cutoff=CUTOFF):
    v, f = surface(spark, sf)
    return geodesic.geodesics(mesh.edges(v, f), cutoff, v.select("protein_id", F.col("vix").alias("src")))


def members(spark, sf, most=200):
    return geodesic.patches(geo(spark, sf), most)


_W = "WITH RECURSIVE "


@query("mesh_edges", _W + lattice_sql() + " SELECT protein_id, src, dst, round(w, 6) AS w FROM edg")
def mesh_edges(spark, sf):
    return mesh.edges(*surface(spark, sf)).select("protein_id", "src", "dst", r6("w"))


@query("vertex_normals", _W + lattice_sql() + normals_sql() + " SELECT protein_id, vix, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz FROM vn")
def vertex_normals(spark, sf):
    return mesh.vertex_normals(*surface(spark, sf)).select("protein_id", "vix", r6("nx"), r6("ny"), r6("nz"))


@query("vertex_normals_compat", _W + lattice_sql() + normals_sql() + """, g AS (SELECT protein_id, sum((x-(x+y+z)/3)*ux) AS gx, sum((y-(x+y+z)/3)*uy) AS gy, sum((z-(x+y+z)/3)*uz) AS gz FROM un GROUP BY protein_id),
t AS (SELECT protein_id, CASE WHEN (gx>0)::INT+(gy>0)::INT+(gz>0)::INT < (gx<0)::INT+(gy<0)::INT+(gz<0)::INT THEN -1.0 ELSE 1.0 END AS s FROM g)
SELECT un.protein_id, vix, round(ux*s, 6) + 0.0 AS nx, round(uy*s, 6) + 0.0 AS ny, round(uz*s, 6) + 0.0 AS nz FROM un JOIN t ON t.protein_id = un.protein_id""")
def vertex_normals_compat(spark, sf):
    return mesh.vertex_normals(*surface(spark, sf), strict_compat=True).select("protein_id", "vix", r6("nx"), r6("ny"), r6("nz"))


_CURV = lattice_sql() + normals_sql() + """,
co AS (SELECT f.protein_id, unnest([[v0,v1,v2],[v1,v2,v0],[v2,v0,v1]]) AS t FROM fac f),
tri AS (SELECT c.protein_id, t[1] AS i, a.x AS ix, a.y AS iy, a.z AS iz, b.x AS jx, b.y AS jy, b.z AS jz, k.x AS kx, k.y AS ky, k.z AS kz
  FROM co c JOIN lat a ON a.protein_id=c.protein_id AND a.vix=t[1] JOIN lat b ON b.protein_id=c.protein_id AND b.vix=t[2] JOIN lat k ON k.protein_id=c.protein_id AND k.vix=t[3]),
len AS (SELECT *, sqrt((ix-jx)**2+(iy-jy)**2+(iz-jz)**2) AS ij, sqrt((ix-kx)**2+(iy-ky)**2+(iz-kz)**2) AS ik, sqrt((jx-kx)**2+(jy-ky)**2+(jz-kz)**2) AS jk FROM tri),
ang AS (SELECT *, acos((ij**2+ik**2-jk**2)/(2*ij*ik)) AS ai, acos((ij**2+jk**2-ik**2)/(2*ij*jk)) AS aj, acos((ik**2+jk**2-ij**2)/(2*ik*jk)) AS ak FROM len),
cv AS (SELECT protein_id, i AS vix, sum(ai) AS asum, sum(0.5*ij*ik*sin(ai)/3) AS area, sum((ix-kx)/tan(aj)+(ix-jx)/tan(ak)) AS lx, sum((iy-ky)/tan(aj)+(iy-jy)/tan(ak)) AS ly, sum((iz-kz)/tan(aj)+(iz-jz)/tan(ak)) AS lz FROM ang GROUP BY ALL),
cur AS (SELECT cv.protein_id, cv.vix, (lx*nx+ly*ny+lz*nz)/(4*area) AS h, (2*pi()-asum)/area AS k FROM cv JOIN vn ON vn.protein_id=cv.protein_id AND vn.vix=cv.vix)"""


@query("mesh_curvature", _W + _CURV + """, e AS (SELECT *, CASE WHEN h*h-k < 0 THEN 1e-8 ELSE h*h-k END AS el FROM cur)
SELECT protein_id, vix, round(h, 6) + 0.0 AS mean_curv, round(k, 6) + 0.0 AS gauss_curv, round(2/pi()*atan(((h+sqrt(el))+(h-sqrt(el)))/((h+sqrt(el))-(h-sqrt(el)))), 4) + 0.0 AS shape_index FROM e""")
def mesh_curvature(spark, sf):
    v, f = surface(spark, sf)
    c = mesh.curvatures(v, f, mesh.vertex_normals(v, f))
    si = F.round(shape_index(F.col("mean_curv"), F.col("gauss_curv")), 4) + 0.0
    return c.select("protein_id", "vix", r6("mean_curv"), r6("gauss_curv"), si.alias("shape_index"))


# vertices on a coarse raster of the points: many coincide
_DIRTY = """ raw AS (SELECT label AS protein_id, vec_id AS vix, round((embedding[1]::DOUBLE)*8) AS x, round((embedding[2]::DOUBLE)*8) AS y, round((embedding[3]::DOUBLE)*8) AS z, lead(vec_id) OVER w AS b, lead(vec_id, 2) OVER w AS c
  FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
rep AS (SELECT protein_id, vix, min(vix) OVER (PARTITION BY protein_id, x, y, z) AS k FROM raw),
fm AS (SELECT raw.protein_id, raw.vix AS fix, r0.k AS v0, r1.k AS v1, r2.k AS v2 FROM raw JOIN rep r0 ON r0.vix = raw.vix JOIN rep r1 ON r1.vix = b JOIN rep r2 ON r2.vix = c),
fd AS (SELECT * FROM fm WHERE v0 <> v1 AND v1 <> v2 AND v0 <> v2 QUALIFY row_number() OVER (PARTITION BY protein_id, list_sort([v0, v1, v2]) ORDER BY fix) = 1)"""


def _dirty(spark, sf):
    from pyspark.sql import Window

    e = fixtures.table(spark, sf, "embeddings")
    r = lambda i: F.round(F.col("embedding")[i].cast("double") * 8)
    v = e.select(F.col("label").alias("protein_id"), F.col("vec_id").alias("vix"), *[r(i).alias(c) for i, c in enumerate("xyz")])
    w = Window.partitionBy("protein_id").orderBy("vix")
    f = v.select("protein_id", F.col("vix").alias("fix"), F.col("vix").alias("v0"), F.lead("vix").over(w).alias("v1"), F.lead("vix", 2).over(w).alias("v2"))
    return mesh.clean(v, f.na.drop())


@query("mesh_clean_faces", "WITH" + _DIRTY + " SELECT protein_id, fix, v0, v1, v2 FROM fd")
def mesh_clean_faces(spark, sf):
    return _dirty(spark, sf)[1].select("protein_id", "fix", "v0", "v1", "v2")


@query("mesh_clean_vertices", "WITH" + _DIRTY + " SELECT DISTINCT protein_id, vix, x + 0.0 AS x, y + 0.0 AS y, z + 0.0 AS z FROM raw WHERE vix IN (SELECT unnest([v0, v1, v2]) FROM fd)")
def mesh_clean_vertices(spark, sf):
    return _dirty(spark, sf)[0].select("protein_id", "vix", *[(F.col(c) + 0.0).alias(c) for c in "xyz"])


# vertices in bunches on a line across the raster of the tolerance: steps of 0.0008 chain up, also over raster lines
_CHAIN = """ raw AS (SELECT label AS protein_id, vec_id AS vix, vec_id // 40 + (vec_id % 4) * 0.0008 + CASE WHEN vec_id % 8 = 3 THEN 0.3 ELSE 0 END AS x, round(embedding[2]::DOUBLE * 4) AS y, 0.0 AS z FROM embeddings),
link AS (SELECT a.protein_id, a.vix AS f, b.vix AS g FROM raw a JOIN raw b ON a.protein_id = b.protein_id WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 0.001),
reach(protein_id, f, g) AS (SELECT protein_id, vix, vix FROM raw UNION SELECT r.protein_id, r.f, l.g FROM reach r JOIN link l ON l.protein_id = r.protein_id AND l.f = r.g)
SELECT protein_id, f AS vix, min(g) AS keep_vix FROM reach GROUP BY ALL"""


@query("mesh_merge_chains", "WITH RECURSIVE" + _CHAIN)
def mesh_merge_chains(spark, sf):
    e = fixtures.table(spark, sf, "embeddings")
    i = F.col("vec_id")
    x = F.expr("vec_id div 40") + (i % 4) * 0.0008 + F.when(i % 8 == 3, 0.3).otherwise(0.0)
    v = e.select(F.col("label").alias("protein_id"), i.alias("vix"), x.alias("x"), F.round(F.col("embedding")[1].cast("double") * 4).alias("y"), F.lit(0.0).alias("z"))
    return mesh.merged(v).select("protein_id", "vix", F.col("_keep").alias("keep_vix"))


@query("submesh", _W + lattice_sql() + """, m AS (SELECT protein_id, vix, row_number() OVER (PARTITION BY protein_id ORDER BY vix) - 1 AS n FROM lat WHERE score > 0.45)
SELECT f.protein_id, f.fix, a.n AS v0, b.n AS v1, c.n AS v2 FROM fac f JOIN m a ON a.protein_id=f.protein_id AND a.vix=v0 JOIN m b ON b.protein_id=f.protein_id AND b.vix=v1 JOIN m c ON c.protein_id=f.protein_id AND c.vix=v2""")
def submesh(spark, sf):
    v, f = surface(spark, sf)
    return mesh.submesh(v, f, v.filter("score > 0.45"))[1]


@query("geodesic_patches", _W + geodesic_sql(CUTOFF) + " SELECT protein_id, src AS center_vix, v AS member_vix, round(CASE WHEN src = v THEN 1e-8 ELSE d END, 6) AS rho, row_number() OVER (PARTITION BY protein_id, src ORDER BY d, v) - 1 AS pos FROM geo QUALIFY pos < 12")
def geodesic_patches(spark, sf):
    return members(spark, sf, 12).select("protein_id", "center_vix", "member_vix", r6("rho"), F.col("pos").cast("bigint").alias("pos"))


@query("patch_shrink", _W + geodesic_sql(CUTOFF) + """, n AS (SELECT * FROM geo WHERE d > 0 AND d < 2.6), ks AS (SELECT k, 2.6*power(0.95, k) AS r FROM range(80) t(k)),
c AS (SELECT protein_id, src, k, r, count(*) AS m FROM n, ks WHERE d < r GROUP BY ALL),
b AS (SELECT protein_id, src, max(r) AS r FROM c WHERE m <= 9 GROUP BY ALL) SELECT n.protein_id, n.src, v, round(d, 6) AS d FROM n JOIN b ON b.protein_id=n.protein_id AND b.src=n.src WHERE d < r""")
def patch_shrink(spark, sf):
    return geodesic.shrink_to_fit(geo(spark, sf), CUTOFF, 9).select("protein_id", "src", "v", r6("d"))


@query("patch_mean_top_sites", _W + geodesic_sql(CUTOFF) + """, m AS (SELECT g.protein_id, src, avg(score) AS s FROM geo g JOIN lat l ON l.protein_id=g.protein_id AND l.vix=g.v GROUP BY ALL)
SELECT protein_id, src AS center_vix, round(s, 6) AS mean_score, (row_number() OVER (PARTITION BY protein_id ORDER BY s DESC, src) - 1)::INT AS site_ix FROM m QUALIFY site_ix < 3""")
def patch_mean_top_sites(spark, sf):
    means = geodesic.patch_mean(members(spark, sf), fixtures.lattice_vertices(spark, sf).select("protein_id", "vix", "score"))
    return geodesic.top_sites(means, 3).select("protein_id", "center_vix", r6("mean_score"), "site_ix")


_RINGS = """, mm AS (SELECT g.protein_id, src, CASE WHEN src = v THEN 1e-8 ELSE d END AS rho, charge FROM geo g JOIN lat l ON l.protein_id=g.protein_id AND l.vix=g.v),
rg AS (SELECT protein_id, src, floor(rho/0.26)::INT AS ring, quantile_cont(charge, 0.25) AS q25, quantile_cont(charge, 0.5) AS q50 FROM mm WHERE rho < 2.6 GROUP BY ALL),
rf AS (SELECT s.protein_id, s.vix AS src, k::INT AS ring, coalesce(q25, 0) AS q25, coalesce(q50, 0) AS q50 FROM lat s CROSS JOIN range(10) t(k) LEFT JOIN rg ON rg.protein_id=s.protein_id AND rg.src=s.vix AND rg.ring=k)"""


def rings(spark, sf):
    v = fixtures.lattice_vertices(spark, sf).select("protein_id", F.col("vix").alias("member_vix"), "charge")
    m = members(spark, sf).join(v, ["protein_id", "member_vix"])
    return patch.ring_percentiles(m, ["protein_id", "center_vix"], "rho", "charge", CUTOFF)


@query("ring_percentiles", _W + geodesic_sql(CUTOFF) + _RINGS + " SELECT protein_id, src AS center_vix, ring, round(q25, 6) + 0.0 AS q25, round(q50, 6) + 0.0 AS q50 FROM rf")
def ring_percentiles(spark, sf):
    return rings(spark, sf).select("protein_id", "center_vix", "ring", r6("q25"), r6("q50"))


@query("ring_label_argmax", _W + geodesic_sql(CUTOFF) + _RINGS + """, md AS (SELECT protein_id, src, quantile_cont(q25, 0.5) AS m FROM rf GROUP BY ALL)
SELECT protein_id, src AS center_vix, round(m, 6) + 0.0 AS median FROM md QUALIFY row_number() OVER (PARTITION BY protein_id ORDER BY m DESC, src) = 1""")
def ring_label_argmax(spark, sf):
    med = patch.ring_median(rings(spark, sf), ["protein_id", "center_vix"])
    return patch.interface_center(med, ["protein_id"], "center_vix").select("protein_id", "center_vix", r6("median"))


_DDC = """, pm AS (SELECT g.protein_id, src, v, CASE WHEN src = v THEN 1e-8 ELSE d END AS rho FROM geo g),
mn AS (SELECT p.protein_id, src, avg(nx) AS ax, avg(ny) AS ay, avg(nz) AS az FROM pm p JOIN vn ON vn.protein_id=p.protein_id AND vn.vix=p.v WHERE rho <= 2.5 GROUP BY ALL),
mu AS (SELECT protein_id, src, ax/sqrt(ax*ax+ay*ay+az*az) AS ix, ay/sqrt(ax*ax+ay*ay+az*az) AS iy, az/sqrt(ax*ax+ay*ay+az*az) AS iz FROM mn),
dj AS (SELECT p.protein_id, p.src, p.v, p.rho, sqrt((m.x-c.x)**2+(m.y-c.y)**2+(m.z-c.z)**2) AS dij, sqrt((m.x+m.nx-ix-c.x)**2+(m.y+m.ny-iy-c.y)**2+(m.z+m.nz-iz-c.z)**2) AS tip, sqrt((m.nx-ix)**2+(m.ny-iy)**2+(m.nz-iz)**2) AS turn
  FROM pm p JOIN vn m ON m.protein_id=p.protein_id AND m.vix=p.v JOIN vn c ON c.protein_id=p.protein_id AND c.vix=p.src JOIN mu ON mu.protein_id=p.protein_id AND mu.src=p.src),
dk AS (SELECT protein_id, src, v, rho, sign(tip-dij)*turn/CASE WHEN dij = 0 THEN 1e-8 ELSE dij END AS k FROM dj),
ddc AS (SELECT protein_id, src, v, rho, CASE WHEN abs(k) > 0.7 THEN 0 ELSE k END AS ddc FROM dk)"""


def _ddc(spark, sf):
    v, f = with_normals(spark, sf)
    return patch.distance_dependent_curvature(members(spark, sf), v)


@query("distance_dependent_curvature", _W + geodesic_sql(CUTOFF) + normals_sql() + _DDC + " SELECT protein_id, src AS center_vix, v AS member_vix, round(ddc, 6) + 0.0 AS ddc FROM ddc")
def distance_dependent_curvature(spark, sf):
    return _ddc(spark, sf).select("protein_id", "center_vix", "member_vix", r6("ddc"))


_HIST = _W + geodesic_sql(CUTOFF) + normals_sql() + _DDC + """, hb AS (SELECT protein_id, src, (floor((rho*3-1)/2)*15 + least(floor(10*(ddc+0.7)), 14))::INT AS bin FROM ddc WHERE rho*3 >= 1 AND rho*3 < 9),
hc AS (SELECT protein_id, src, bin, count(*)::DOUBLE AS c FROM hb GROUP BY ALL), hn AS (SELECT *, sqrt(sum(c*c) OVER (PARTITION BY protein_id, src)) AS n FROM hc)"""


@query("curvature_histogram", _HIST + " SELECT protein_id, src AS center_vix, bin, round(c/n, 6) AS value FROM hn")
def curvature_histogram(spark, sf):
    m = _ddc(spark, sf).withColumn("rho", F.col("rho") * 3)
    h = patch.curvature_histogram(m, ["protein_id", "center_vix"]).select("protein_id", "center_vix", F.posexplode("hist").alias("bin", "value"))
    return h.filter("value > 0").select("protein_id", "center_vix", "bin", r6("value"))


_POLAR = (
    _W + geodesic_sql(CUTOFF) + normals_sql()
    + f""",
mem AS (SELECT protein_id, src AS c, v, d, row_number() OVER (PARTITION BY protein_id, src ORDER BY d, v) AS pos FROM geo),
off AS (SELECT m.*, k.nx AS kx, k.ny AS ky, k.nz AS kz, e.x-k.x AS dx, e.y-k.y AS dy, e.z-k.z AS dz
  FROM mem m JOIN vn k ON k.protein_id=m.protein_id AND k.vix=m.c JOIN vn e ON e.protein_id=m.protein_id AND e.vix=m.v),
flat AS (SELECT *, dx-(dx*kx+dy*ky+dz*kz)*kx AS qx, dy-(dx*kx+dy*ky+dz*kz)*ky AS qy, dz-(dx*kx+dy*ky+dz*kz)*kz AS qz FROM off),
zero AS (SELECT protein_id, c, arg_min(qx, pos) AS ux, arg_min(qy, pos) AS uy, arg_min(qz, pos) AS uz FROM flat WHERE sqrt(qx*qx+qy*qy+qz*qz) > 1e-9 GROUP BY ALL),
own AS (SELECT f.protein_id, f.c, f.v, f.d, atan2(qx*(ky*uz-kz*uy)+qy*(kz*ux-kx*uz)+qz*(kx*uy-ky*ux)+0.0, qx*ux+qy*uy+qz*uz+0.0) AS t FROM flat f JOIN zero z ON z.protein_id=f.protein_id AND z.c=f.c),
one AS (SELECT i.protein_id, i.c, g.dst AS v, g.w AS d, i.v AS tag FROM own i JOIN edg g ON g.protein_id=i.protein_id AND g.src=i.v
  JOIN mem m ON m.protein_id=i.protein_id AND m.c=i.c AND m.v=g.dst WHERE i.d < {CUTOFF / 2} AND g.w <= {CUTOFF}),
two AS (SELECT o.protein_id, o.c, g.dst AS v, o.d + g.w AS d, o.tag FROM one o JOIN edg g ON g.protein_id=o.protein_id AND g.src=o.v
  JOIN mem m ON m.protein_id=o.protein_id AND m.c=o.c AND m.v=g.dst WHERE o.d + g.w <= {CUTOFF}),
lab AS (SELECT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY protein_id, c, v ORDER BY d, tag) = 1),
ang AS (SELECT o.protein_id, o.c, o.v, CASE WHEN o.d < {CUTOFF / 2} THEN o.t ELSE n.t END AS t FROM own o
  LEFT JOIN lab l ON l.protein_id=o.protein_id AND l.c=o.c AND l.v=o.v LEFT JOIN own n ON n.protein_id=o.protein_id AND n.c=o.c AND n.v=l.tag)
SELECT protein_id, c AS center_vix, v AS member_vix, round(cos(t), 6) + 0.0 AS cos_theta, round(sin(t), 6) + 0.0 AS sin_theta FROM ang"""
)


@query("patch_polar_angles", _POLAR)  # edges of the lattice are 1 or longer, so its labels travel two edges at most
def patch_polar_angles(spark, sf):
    v, f = with_normals(spark, sf)
    t = geodesic.polar_angles(members(spark, sf), v, mesh.edges(v, f), CUTOFF)
    return t.select("protein_id", "center_vix", "member_vix", r6(F.cos("theta"), "cos_theta"), r6(F.sin("theta"), "sin_theta"))


@query("patch_channels", _W + lattice_sql() + """ SELECT protein_id, vix, round(greatest(-3, least(3, charge*10))/3, 6) + 0.0 AS charge, round(-hbond, 6) + 0.0 AS hbond, round(hphob/4.5, 6) + 0.0 AS hphob, round(2*pi()-abs(score), 6) AS theta FROM lat""")
def patch_channels(spark, sf):
    v = fixtures.lattice_vertices(spark, sf)
    flip = flip_features("hbond", "hbond", "hbond", "charge", "h", "t")
    v = v.withColumn("h", F.col("hphob") / 4.5).withColumn("t", F.abs("score"))
    return v.select("protein_id", "vix", r6(normalize_charge(F.col("charge") * 10), "charge"), r6(flip["hbond"], "hbond"), r6(flip["hphob"], "hphob"), r6(flip["theta"], "theta"))


_Z2 = "1.1 + e[2]*0.5"
RADIUS = 2.2


def _facing(spark, sf):
    """Each lattice and a second one above it as the two partners of a pair."""
    v, f = surface(spark, sf)
    e = fixtures.table(spark, sf, "embeddings")
    z = e.select(F.floor(F.col("vec_id") / 100).cast("bigint").alias("protein_id"), (F.col("vec_id") % 100).cast("int").alias("vix"), (F.col("embedding")[1].cast("double") * 0.5 + 1.1).alias("z2"))
    up = v.join(z, ["protein_id", "vix"]).withColumn("z", F.col("z2")).drop("z2")
    shift = lambda d: d.withColumn("protein_id", F.col("protein_id") + F.lit(1 << 40))
    allv, allf = v.unionByName(shift(up)), f.unionByName(shift(f))
    allv = allv.join(mesh.vertex_normals(allv, allf), ["protein_id", "vix"])
    pairs = v.select(F.col("protein_id").alias("pair_id"), F.col("protein_id").alias("p1"), (F.col("protein_id") + F.lit(1 << 40)).alias("p2")).distinct()
    g = geodesic.geodesics(mesh.edges(allv, allf), RADIUS, allv.select("protein_id", F.col("vix").alias("src")))
    return pairs, geodesic.patches(g, 200), allv


def _sc_sql() -> str:
    d = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
    comp = f"-(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz)*exp(-0.25*{d}*{d})"
    rho = "CASE WHEN g.src = g.v THEN 1e-8 ELSE g.d END"

    def face(name, me, other, mine, theirs):
        return f""",
{name}m AS (SELECT c.protein_id, c1, c2, g.v, {rho} AS rho FROM cc c JOIN {me}geo g ON g.protein_id=c.protein_id AND g.src=c.{mine}),
{name}f AS (SELECT m.protein_id, m.c1, m.c2, m.v, m.rho, {comp} AS comp FROM {name}m m JOIN {other}geo o ON o.protein_id=m.protein_id AND o.src=m.{theirs}
  JOIN {me}vn a ON a.protein_id=m.protein_id AND a.vix=m.v JOIN {other}vn b ON b.protein_id=m.protein_id AND b.vix=o.v QUALIFY row_number() OVER (PARTITION BY m.protein_id, m.c1, m.v ORDER BY {d}, o.v) = 1),
{name}r AS (SELECT protein_id, c1, c2, floor(rho/0.22)::INT AS ring, quantile_cont(comp, 0.25) AS q25, quantile_cont(comp, 0.5) AS q50 FROM {name}f WHERE rho < 2.2 GROUP BY ALL),
{name}q AS (SELECT c.protein_id, c.c1, c.c2, k::INT AS ring, coalesce(q25, 0) AS q25, coalesce(q50, 0) AS q50 FROM cc c CROSS JOIN range(10) t(k) LEFT JOIN {name}r r ON r.protein_id=c.protein_id AND r.c1=c.c1 AND r.ring=k)"""

    return (
        _W + geodesic_sql(RADIUS, "a_") + normals_sql("a_") + "," + geodesic_sql(RADIUS, "b_", _Z2) + normals_sql("b_")
        + f""",
cc AS (SELECT a.protein_id, a.vix AS c1, b.vix AS c2 FROM a_vn a JOIN b_vn b ON a.protein_id=b.protein_id WHERE {d} < 1.5 QUALIFY row_number() OVER (PARTITION BY a.protein_id, a.vix ORDER BY {d}, b.vix) = 1)"""
        + face("x", "a_", "b_", "c1", "c2") + face("y", "b_", "a_", "c2", "c1")
        + """ SELECT protein_id AS pair_id, 1 AS side, c1 AS center_vix, ring, round(q25, 6) + 0.0 AS q25, round(q50, 6) + 0.0 AS q50 FROM xq
UNION ALL SELECT protein_id, 2, c2, ring, round(q25, 6) + 0.0, round(q50, 6) + 0.0 FROM yq QUALIFY row_number() OVER (PARTITION BY protein_id, c2, ring ORDER BY c1 DESC) = 1"""
    )


@query("shape_complementarity", _sc_sql())
def shape_complementarity(spark, sf):
    pairs, m, v = _facing(spark, sf)
    return patch.shape_complementarity(pairs, m, v, radius=RADIUS).select("pair_id", "side", "center_vix", "ring", r6("q25"), r6("q50"))
