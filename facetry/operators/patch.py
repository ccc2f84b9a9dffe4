"""Per-patch features, ring summaries, shape complementarity and histogram fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.chem import normalize_charge, shape_index
from facetry.functions.geometry import dist, dot3, norm3
from facetry.operators.scale import large
from facetry.operators.spatial import nearest

RINGS = 10
PATCH = ["protein_id", "center_vix"]


def mean_center_normal(members: DataFrame, vertices: DataFrame, reach: float = 2.5) -> DataFrame:
    """Normalised mean normal over the members within ``reach`` of each centre."""
    n = vertices.select("protein_id", F.col("vix").alias("member_vix"), "nx", "ny", "nz")
    m = members.filter(F.col("rho") <= reach).join(large(n), ["protein_id", "member_vix"])
    a = m.groupBy(*PATCH).agg(*[F.avg(f"n{c}").alias(f"i{c}") for c in "xyz"])
    length = norm3(("ix", "iy", "iz"))
    return a.select(*PATCH, *[F.try_divide(F.col(f"i{c}"), length).alias(f"i{c}") for c in "xyz"])


def distance_dependent_curvature(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """Signed change of the normal per distance from the centre; beyond +-0.7 counts as 0."""
    at = lambda side, p: large(
        vertices.select("protein_id", F.col("vix").alias(side), *[F.col(c).alias(p + c) for c in "xyz"], *[F.col(f"n{c}").alias(f"{p}n{c}") for c in "xyz"])
    )
    m = members.join(at("member_vix", "m"), ["protein_id", "member_vix"]).join(at("center_vix", "c"), ["protein_id", "center_vix"])
    m = m.join(large(mean_center_normal(members, vertices)), PATCH)
    dij = dist("mx", "my", "mz", "cx", "cy", "cz")
    tip = dist(*[F.col(f"m{c}") + F.col(f"mn{c}") for c in "xyz"], *[F.col(f"i{c}") + F.col(f"c{c}") for c in "xyz"])
    turn = dist("mnx", "mny", "mnz", "ix", "iy", "iz")
    k = F.signum(tip - dij) * turn / F.when(dij == 0, F.lit(1e-8)).otherwise(dij)
    return m.select(*members.columns, F.when(F.abs(k) > 0.7, F.lit(0.0)).otherwise(k).alias("ddc"))


def patch_features(members: DataFrame, vertices: DataFrame, curv: DataFrame) -> DataFrame:
    """Five channels per member: shape index, distance-dependent curvature, hbond, charge, hydropathy."""
    si = curv.select("protein_id", "vix", shape_index(F.col("mean_curv"), F.col("gauss_curv")).alias("si"))
    v = vertices.join(large(si), ["protein_id", "vix"], "left").select(
        "protein_id",
        F.col("vix").alias("member_vix"),
        "si",
        F.coalesce("hbond", F.lit(0.0)).alias("hbond"),
        normalize_charge(F.coalesce("charge", F.lit(0.0))).alias("charge"),
        (F.coalesce("hphob", F.lit(0.0)) / 4.5).alias("hphob"),
    )
    return distance_dependent_curvature(members, vertices).join(large(v), ["protein_id", "member_vix"])


def ring_of(rho: Column, radius: float, rings: int = RINGS) -> Column:
    """Ring number by half-open borders ``radius * i / rings``; null outside."""
    edges = [radius / rings * i for i in range(rings)] + [radius]
    out = None
    for i in range(rings):
        c = (rho >= edges[i]) & (rho < edges[i + 1])
        out = F.when(c, F.lit(i)) if out is None else out.when(c, F.lit(i))
    return out


def ring_percentiles(df: DataFrame, keys: list[str], rho: str, value: str, radius: float, strict_compat: bool = False) -> DataFrame:
    """25th and 50th percentile per ring, 0 for empty rings (patches are bounded, so the built-in aggregate fits).

    ``strict_compat``: the older form that leaves the outermost ring at 0.
    """
    ring = ring_of(F.col(rho), radius)
    src = df.select(*keys, ring.alias("ring"), F.col(value).cast("double").alias("_v")).filter(F.col("ring").isNotNull())
    if strict_compat:
        src = src.filter(F.col("ring") < RINGS - 1)
    got = src.groupBy(*keys, "ring").agg(F.percentile("_v", F.array(F.lit(0.25), F.lit(0.5))).alias("_p"))
    got = got.select(*keys, "ring", F.col("_p")[0].alias("q25"), F.col("_p")[1].alias("q50"))
    # empty rings are filled from the present ones of the same patch: at most ten entries
    by = got.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ring", F.struct("q25", "q50")))).alias("_m"))
    groups = df.select(*keys).distinct().join(by, keys, "left")
    full = groups.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(RINGS - 1))).alias("ring"))
    e = F.try_element_at("_m", F.col("ring"))
    return full.select(*keys, "ring", F.coalesce(e["q25"], F.lit(0.0)).alias("q25"), F.coalesce(e["q50"], F.lit(0.0)).alias("q50"))


def ring_median(rings: DataFrame, keys: list[str], value: str = "q25") -> DataFrame:
    """Median over the rings of a patch; missing values count as 0."""
    v = F.when(F.col(value).isNull() | F.isnan(value), F.lit(0.0)).otherwise(F.col(value))
    return rings.groupBy(*keys).agg(F.percentile(v, F.lit(0.5)).alias("median"))


def interface_center(medians: DataFrame, group: list[str], vertex: str) -> DataFrame:
    """Vertex with the highest median, first one on ties."""
    b = medians.groupBy(*group).agg(F.max(F.struct("median", (-F.col(vertex)).alias("neg"))).alias("_b"))
    return b.select(*group, (-F.col("_b.neg")).alias(vertex), F.col("_b.median").alias("median"))


def complementarity(n1: tuple, n2: tuple, d: Column, w: float = 0.25) -> Column:
    """Opposed normals, damped by distance."""
    return -dot3(n1, n2) * F.exp(F.lit(-w) * d * d)


def shape_complementarity(
    pairs: DataFrame, members: DataFrame, vertices: DataFrame, interaction: float = 1.5, radius: float = 12.0, w: float = 0.25
) -> DataFrame:
    """Ring percentiles of complementarity for the interface vertices of both partners.

    ``pairs``: pair_id, p1, p2 (protein ids). Result: pair_id, side (1/2), center_vix, ring, q25, q50.
    A vertex of partner 2 that is nearest to several of partner 1 takes the last one's values.
    """
    v1 = pairs.select("pair_id", F.col("p1").alias("protein_id")).join(vertices, "protein_id")
    v2 = pairs.select("pair_id", F.col("p2").alias("protein_id")).join(vertices, "protein_id")
    keep = ["pair_id", "vix", "x", "y", "z"]
    near = nearest(v1.select(*keep), v2.select(*keep), "vix", ["pair_id"], 1, interaction, closed=False)
    centers = near.select("pair_id", F.col("vix").alias("c1"), F.col("n_vix").alias("c2"))

    def points(side: str, proteins: str) -> DataFrame:
        m = members.withColumnRenamed("protein_id", proteins)
        p = centers.join(pairs, "pair_id").join(m.withColumnRenamed("center_vix", side), [proteins, side])
        v = vertices.select(F.col("protein_id").alias(proteins), F.col("vix").alias("member_vix"), "x", "y", "z", "nx", "ny", "nz")
        return p.join(v, [proteins, "member_vix"]).select("pair_id", "c1", "c2", "member_vix", "rho", "x", "y", "z", "nx", "ny", "nz")

    a, b = points("c1", "p1"), points("c2", "p2")
    key = ["pair_id", "c1", "c2"]

    def facing(src: DataFrame, dst: DataFrame) -> DataFrame:
        # both patches of a centre are bounded, so their pairing is too
        d = dst.select(*key, F.col("member_vix").alias("o_vix"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *[F.col(f"n{c}").alias(f"on{c}") for c in "xyz"])
        j = src.join(d, key).withColumn("_d", dist("x", "y", "z", "ox", "oy", "oz"))
        best = j.groupBy(*key, "member_vix", "rho", "nx", "ny", "nz").agg(F.min(F.struct("_d", "o_vix", "onx", "ony", "onz")).alias("o"))
        comp = complementarity(("nx", "ny", "nz"), ("o.onx", "o.ony", "o.onz"), F.col("o._d"), w)
        return best.select(*key, "member_vix", "rho", comp.alias("comp"))

    r1 = ring_percentiles(facing(a, b), key, "rho", "comp", radius)
    r2 = ring_percentiles(facing(b, a), key, "rho", "comp", radius)
    side1 = r1.select("pair_id", F.lit(1).alias("side"), F.col("c1").alias("center_vix"), "ring", "q25", "q50")
    last = r2.groupBy("pair_id", "c2", "ring").agg(F.max_by(F.struct("q25", "q50"), "c1").alias("q"))
    side2 = last.select("pair_id", F.lit(2).alias("side"), F.col("c2").alias("center_vix"), "ring", "q.q25", "q.q50")
    return side1.unionByName(side2)


def curvature_histogram(members: DataFrame, keys: list[str], rho: str = "rho", curv: str = "ddc", flipped: bool = False) -> DataFrame:
    """L2-normalised counts over 4 distance and 15 curvature bins, as a 60-vector per patch.

    Null where no member falls into a bin. The border value 0.7 belongs to the last bin.
    """
    k = -F.col(curv) if flipped else F.col(curv)
    r = F.col(rho)
    src = members.select(*keys, r.alias("_r"), k.alias("_k"))
    inside = (F.col("_r") >= 1) & (F.col("_r") < 9) & (F.abs("_k") <= 0.7)
    bin_ = (F.floor((F.col("_r") - 1) / 2) * 15 + F.least(F.floor(10 * (F.col("_k") + 0.7)), F.lit(14))).cast("int")
    counts = src.filter(inside).groupBy(*keys, bin_.alias("_bin")).agg(F.count("*").cast("double").alias("_c"))
    vec = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_c"))).alias("_m"), F.sqrt(F.sum(F.col("_c") * F.col("_c"))).alias("_n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)) / F.col("_n"))
    return members.select(*keys).distinct().join(vec.select(*keys, dense.alias("hist")), keys, "left")


def label_interface(vertices: DataFrame, complex_vertices: DataFrame, min_square: float = 2.0) -> DataFrame:
    """A vertex is interface where the surface of the whole complex has moved away from it."""
    found = nearest(vertices.select("protein_id", "vix", "x", "y", "z"), complex_vertices, "vix", ["protein_id"], 1)
    return found.select("protein_id", "vix", F.when(F.col("n_dist") * F.col("n_dist") >= min_square, 1.0).otherwise(0.0).alias("iface_label"))


def interpolate(queries: DataFrame, known: DataFrame, known_id: str, values: list[str], on: list[str] = (), k: int = 4) -> DataFrame:
    """Inverse-square-distance mean of the ``k`` nearest known points; an exact hit gives its own value."""
    on = list(on)
    found = nearest(queries, known, known_id, on, k)
    vals = known.select(*on, F.col(known_id).alias(f"n_{known_id}"), *[F.col(v).alias(f"_k{v}") for v in values])
    j = found.join(vals, [*on, f"n_{known_id}"])
    w = F.when(F.col("n_dist") > 0, 1 / (F.col("n_dist") * F.col("n_dist")))
    agg = []
    for v in values:
        exact = F.min_by(F.when(F.col("n_dist") == 0, F.col(f"_k{v}")), F.when(F.col("n_dist") == 0, F.col("n_rank")))
        agg.append(F.coalesce(exact, F.sum(w * F.col(f"_k{v}")) / F.sum(w)).alias(v))
    ids = [c for c in queries.columns if c not in values]
    return j.groupBy(*ids).agg(*agg)


def pocket_points(vertices: DataFrame, ligand_atoms: DataFrame, radius: float = 3.0) -> DataFrame:
    """Vertices within ``radius`` of any atom of a ligand, with the ligand's class.

    ``ligand_atoms``: protein_id, ligand_ix, ligand_class, atom_ix, x, y, z.
    """
    names = ligand_atoms.select("protein_id", "ligand_ix", "ligand_class").distinct()
    q = vertices.select("protein_id", "vix", "x", "y", "z").join(names, "protein_id")
    found = nearest(q, ligand_atoms, "atom_ix", ["protein_id", "ligand_ix"], 1, radius)
    return found.select("protein_id", "ligand_ix", "vix", "ligand_class")


# Ligand names and their classes.
LIGAND_CLASSES = {"ADP": 1, "COA": 2, "FAD": 3, "HEM": 4, "NAD": 5, "NAP": 6, "SAM": 7}


def ligand_coordinates(atoms: DataFrame) -> DataFrame:
    """Coordinates of each listed ligand copy (a ligand is one residue, so the list is short)."""
    het = atoms.filter(F.col("resname").isin(list(LIGAND_CLASSES)))
    return het.groupBy("structure_id", "chain", "resid", "resname").agg(F.array_sort(F.collect_list(F.struct("serial", "x", "y", "z"))).alias("a")).select(
        "structure_id", "chain", "resid", "resname", F.transform("a", lambda p: F.array(p["x"], p["y"], p["z"])).alias("coords")
    )
