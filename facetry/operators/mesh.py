"""Triangle meshes as tables: edges, normals, curvature, hygiene, sub-meshes.

``vertices``: protein_id, vix, x, y, z (and nx, ny, nz). ``faces``: protein_id, fix, v0, v1, v2.
Joins are on (protein_id, vix), so one huge protein still spreads over all tasks.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions.geometry import angle_at, cross3, dist, dot3, norm3, sub3, unit3
from facetry.operators.components import connected
from facetry.operators.scale import SEGMENT_ROWS, large, with_ordinals
from facetry.operators.spatial import XYZ, radius_pairs
from facetry.session import materialize

EPS = 1e-6
CORNERS = ("v0", "v1", "v2")


def edges(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Every mesh edge in both directions with its length."""
    pairs = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in permutations(CORNERS, 2)])
    e = faces.select("protein_id", F.explode(pairs).alias("e")).select("protein_id", "e.*").distinct()
    end = lambda side, p: large(vertices.select("protein_id", F.col("vix").alias(side), *[F.col(c).alias(p + c) for c in "xyz"]))
    e = e.join(end("src", "a"), ["protein_id", "src"]).join(end("dst", "b"), ["protein_id", "dst"])
    return e.select("protein_id", "src", "dst", dist("ax", "ay", "az", "bx", "by", "bz").alias("w"))


def with_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners as p0x .. p2z."""
    out = faces
    for i, v in enumerate(CORNERS):
        out = out.join(large(vertices.select("protein_id", F.col("vix").alias(v), *[F.col(c).alias(f"p{i}{c}") for c in "xyz"])), ["protein_id", v])
    return out


def _corner(i: int) -> tuple[str, str, str]:
    return tuple(f"p{i}{c}" for c in "xyz")


def vertex_normals(vertices: DataFrame, faces: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Normalised sum of the unit normals of the faces around a vertex, pointing outwards.

    Outwards is voted per protein: by the sign of (vertex - centroid) . normal, or with
    ``strict_compat`` by the three per-axis sums after removing each vertex's own mean.
    """
    f = with_corners(vertices, faces)
    n = unit3(cross3(sub3(_corner(1), _corner(0)), sub3(_corner(2), _corner(0))), EPS)
    f = f.select("protein_id", F.array(*CORNERS).alias("_v"), *[c.alias(f"f{a}") for a, c in zip("xyz", n)])
    s = f.select("protein_id", F.explode("_v").alias("vix"), "fx", "fy", "fz").groupBy("protein_id", "vix")
    s = s.agg(*[F.sum(f"f{a}").alias(f"s{a}") for a in "xyz"])
    base = vertices.select("protein_id", "vix", "x", "y", "z").join(large(s), ["protein_id", "vix"], "left").na.fill(0.0, ["sx", "sy", "sz"])
    base = base.select("protein_id", "vix", "x", "y", "z", *[c.alias(f"n{a}") for a, c in zip("xyz", unit3(("sx", "sy", "sz"), EPS))])
    if strict_compat:
        own = (F.col("x") + F.col("y") + F.col("z")) / 3
        axis = [F.sum((F.col(a) - own) * F.col(f"n{a}")).alias(f"g{a}") for a in "xyz"]
        votes = base.groupBy("protein_id").agg(*axis)
        up = sum(F.when(F.col(f"g{a}") > 0, 1).otherwise(0) for a in "xyz")
        down = sum(F.when(F.col(f"g{a}") < 0, 1).otherwise(0) for a in "xyz")
        votes = votes.select("protein_id", (up < down).alias("_flip"))
    else:
        # sum of (v - centroid) . n without a second pass: sum(v . n) - centroid . sum(n)
        votes = base.groupBy("protein_id").agg(
            F.sum(dot3(("x", "y", "z"), ("nx", "ny", "nz"))).alias("_vn"),
            *[F.avg(a).alias(f"_m{a}") for a in "xyz"],
            *[F.sum(f"n{a}").alias(f"_s{a}") for a in "xyz"],
        )
        votes = votes.select("protein_id", (F.col("_vn") - dot3(("_mx", "_my", "_mz"), ("_sx", "_sy", "_sz")) < 0).alias("_flip"))
    out = base.join(large(votes), "protein_id")
    turn = F.when(F.col("_flip"), -1.0).otherwise(1.0)
    return out.select("protein_id", "vix", *[(F.col(f"n{a}") * turn).alias(f"n{a}") for a in "xyz"])


def curvatures(vertices: DataFrame, faces: DataFrame, normals: DataFrame) -> DataFrame:
    """Mean and Gaussian curvature per vertex from cotangent sums and angle defects."""
    f = with_corners(vertices, faces)
    parts = []
    area = norm3(cross3(sub3(_corner(1), _corner(0)), sub3(_corner(2), _corner(0)))) / 2
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        cot_j = 1 / F.tan(angle_at(_corner(i), _corner(j), _corner(k)))
        cot_k = 1 / F.tan(angle_at(_corner(i), _corner(k), _corner(j)))
        # the angle at j lies opposite edge i-k and the other way round
        lap = [(F.col(f"p{i}{c}") - F.col(f"p{k}{c}")) * cot_j + (F.col(f"p{i}{c}") - F.col(f"p{j}{c}")) * cot_k for c in "xyz"]
        parts.append(
            F.struct(
                F.col(CORNERS[i]).alias("vix"),
                angle_at(_corner(j), _corner(i), _corner(k)).alias("angle"),
                (area / 3).alias("area"),
                *[v.alias(f"l{c}") for c, v in zip("xyz", lap)],
            )
        )
    s = f.select("protein_id", F.explode(F.array(*parts)).alias("c")).select("protein_id", "c.*").groupBy("protein_id", "vix")
    s = s.agg(F.sum("angle").alias("_angle"), F.sum("area").alias("_area"), *[F.sum(f"l{c}").alias(f"l{c}") for c in "xyz"])
    s = s.join(large(normals), ["protein_id", "vix"])
    mean = dot3(("lx", "ly", "lz"), ("nx", "ny", "nz")) / (4 * F.col("_area"))
    return s.select("protein_id", "vix", mean.alias("mean_curv"), ((2 * math.pi - F.col("_angle")) / F.col("_area")).alias("gauss_curv"), F.col("_angle").alias("angle_sum"))


def merged(vertices: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(protein_id, vix, _keep): vertices at most ``tolerance`` apart, also over several steps, become the one with the smallest number.

    Where they lie on any raster does not matter. Copies at the same place are counted once before distances are taken.
    """
    spots = vertices.groupBy("protein_id", *XYZ).agg(F.min("vix").alias("_spot"))
    at = materialize(spots.select("protein_id", "_spot", *XYZ))
    close = radius_pairs(at, at, tolerance, ["protein_id"], closed=True).filter(F.col("_spot") < F.col("n__spot"))
    low = connected(close, "_spot", "n__spot", ["protein_id"]).withColumnsRenamed({"node": "_spot", "component": "_low"})
    at = at.join(low, ["protein_id", "_spot"], "left").withColumn("_keep", F.coalesce("_low", "_spot"))
    return vertices.join(at, ["protein_id", *XYZ]).select("protein_id", "vix", "_keep")


def clean(vertices: DataFrame, faces: DataFrame, tolerance: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Merge vertices up to ``tolerance`` apart, drop degenerate and repeated faces and unused vertices."""
    to = merged(vertices, tolerance)
    f = faces
    for v in CORNERS:
        f = f.join(to.withColumnsRenamed({"vix": v, "_keep": f"_k{v}"}), ["protein_id", v]).drop(v).withColumnRenamed(f"_k{v}", v)
    f = f.filter((F.col("v0") != F.col("v1")) & (F.col("v1") != F.col("v2")) & (F.col("v0") != F.col("v2")))
    f = f.groupBy("protein_id", F.array_sort(F.array(*CORNERS)).alias("_set")).agg(F.min(F.struct("fix", *CORNERS)).alias("f"))
    f = f.select("protein_id", "f.*")
    used = f.select("protein_id", F.explode(F.array(*CORNERS)).alias("vix")).distinct()
    kept = vertices.join(to.filter(F.col("vix") == F.col("_keep")).select("protein_id", "vix"), ["protein_id", "vix"], "left_semi")
    return kept.join(used, ["protein_id", "vix"], "left_semi"), f


def submesh(vertices: DataFrame, faces: DataFrame, members: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Faces whose corners are all members, with vertices numbered again from 0."""
    kept = vertices.join(members.select("protein_id", "vix").distinct(), ["protein_id", "vix"], "left_semi")
    numbered = with_ordinals(kept, ["protein_id"], ["vix"], "new_vix", segment_rows)
    f = faces
    for v in CORNERS:
        f = f.join(numbered.select("protein_id", F.col("vix").alias(v), F.col("new_vix").alias(f"n{v}")), ["protein_id", v])
    return numbered, f.select("protein_id", "fix", *[F.col(f"n{v}").alias(v) for v in CORNERS])
