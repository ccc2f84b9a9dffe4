"""Surface preprocessing as set-based jobs over all proteins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions import chem
from facetry.functions.text import atom_key_parts
from facetry.operators.geodesic import geodesics, patches, polar_angles
from facetry.operators.mesh import curvatures, edges, vertex_normals
from facetry.operators.patch import patch_features
from facetry.operators.scale import large
from facetry.operators.spatial import radius_pairs
from facetry.session import materialize

RESIDUE = ["structure_id", "chain", "resid", "icode"]


def hydropathy(vertices: DataFrame) -> DataFrame:
    """Hydropathy of the residue a vertex belongs to (0 for unknown names)."""
    return vertices.withColumn("hphob", chem.hydropathy(F.col("resname")))


def satisfied_backbone(atoms: DataFrame, with_chain: bool = False) -> tuple[DataFrame, DataFrame]:
    """Residues whose backbone O, and whose backbone H, already form a hydrogen bond.

    Residues are told apart by number only, as published; ``with_chain`` uses the chain too.
    """
    res = RESIDUE if with_chain else ["structure_id", "resid", "icode"]
    pick = lambda name, p: atoms.filter(F.col("atom") == name).select(*RESIDUE, *[F.col(c).alias(p + c) for c in "xyz"])
    o = atoms.filter("atom = 'O'").select(*RESIDUE, "serial", "x", "y", "z").join(pick("C", "c"), RESIDUE)
    h = atoms.filter("atom = 'H'").select(*RESIDUE, "serial", "x", "y", "z").join(pick("N", "d"), RESIDUE)
    # at 2.5 around one oxygen there is only a handful of hydrogens
    j = radius_pairs(o, h, 2.5, ["structure_id"], closed=True)
    same = F.lit(True)
    for c in res[1:]:
        same = same & (F.col(c) == F.col(f"n_{c}"))
    d = lambda p: tuple(F.col(p + c) for c in "xyz")
    nho = chem.angle_deviation(d("n_d"), d("n_"), d(""), chem.math.pi)
    hoc = chem.angle_deviation(d("n_"), d(""), d("c"), 8 * chem.math.pi / 9)
    ok = j.filter(~same & (nho < chem.math.pi / 6) & (hoc < chem.math.pi / 9))
    co = ok.select(*res).distinct()
    hn = ok.select("structure_id", *[F.col(f"n_{c}").alias(c) for c in res[1:]]).distinct()
    return co, hn


def hydrogen_bonds(vertices: DataFrame, atoms: DataFrame, with_chain: bool = False) -> DataFrame:
    """Hydrogen-bond potential per vertex from the atom under it.

    ``vertices``: structure_id, vix, x..z and chain, resid, icode, resname, atom (from the atom key).
    """
    co, hn = satisfied_backbone(atoms, with_chain)
    res = co.columns
    at = lambda p: atoms.select(*RESIDUE, F.col("atom").alias(f"{p}_atom"), *[F.col(c).alias(p + c) for c in "xyz"])
    is_h = chem.is_polar_hydrogen(F.col("resname"), F.col("atom"))
    has = lambda name: F.max((F.col("atom") == name).cast("int")) == 1
    his = atoms.filter("resname = 'HIS'").groupBy(*RESIDUE).agg(has("HD1").alias("_hd1"), has("HE2").alias("_he2"))
    v = vertices.join(his, RESIDUE, "left")
    free = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    ring_n = (F.col("resname") == "HIS") & (((F.col("atom") == "ND1") & free("_hd1")) | ((F.col("atom") == "NE2") & free("_he2")))
    is_acc = ~is_h & (F.col("atom").startswith("O") | ring_n)
    v = v.withColumn("_kind", F.when(is_h, "donor").when(is_acc, "acceptor"))
    first = F.when(F.col("_kind") == "donor", chem.lookup(chem.HYDROGEN_DONOR, F.col("atom"))).otherwise(chem.lookup(chem.ACCEPTOR_BASE, F.col("atom")))
    v = v.withColumn("a_atom", first).withColumn("p_atom", chem.lookup(chem.ACCEPTOR_PLANE, F.col("atom"))).withColumn("b_atom", F.col("atom"))
    v = v.join(at("a"), [*RESIDUE, "a_atom"], "left").join(at("b"), [*RESIDUE, "b_atom"], "left").join(at("p"), [*RESIDUE, "p_atom"], "left")
    v = v.join(co.withColumn("_co", F.lit(True)), res, "left").join(hn.withColumn("_hn", F.lit(True)), res, "left")
    t = lambda p: tuple(F.col(p + c) for c in "xyz")
    taken = ((F.col("atom") == "H") & F.col("_hn").isNotNull()) | ((F.col("atom") == "O") & F.col("_co").isNotNull())
    donor = chem.hbond_donor_term(t("a"), t("b"), t(""))
    acceptor = F.when(F.col("p_atom").isNull(), chem.hbond_acceptor_term(t("a"), t("b"), t(""))).otherwise(chem.hbond_acceptor_term(t("a"), t("b"), t(""), t("p")))
    value = F.when(taken, 0.0).when(F.col("_kind") == "donor", donor).when(F.col("_kind") == "acceptor", acceptor)
    return v.select("structure_id", "vix", F.coalesce(value, F.lit(0.0)).alias("hbond"))


def ligand_hydrogen_bonds(vertices: DataFrame, directions: DataFrame) -> DataFrame:
    """Ligand form: deviation from the best of the given directions of an atom.

    ``directions``: structure_id, atom, kind (donor/acceptor), cone (boolean), ax..az (atom), and either
    dx..dz (a direction) or, for cones, dx..dz (axis) with the vertex ideally 60 degrees off it.
    """
    j = vertices.join(directions, ["structure_id", "atom"])
    u = [F.col(c) - F.col(f"a{c}") for c in "xyz"]
    dot = sum(a * F.col(f"d{c}") for a, c in zip(u, "xyz"))
    length = F.sqrt(sum(a * a for a in u)) * F.sqrt(sum(F.col(f"d{c}") * F.col(f"d{c}") for c in "xyz"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, length))))
    dev = F.when(F.col("cone"), F.abs(angle - chem.math.pi / 3)).otherwise(angle)
    best = j.groupBy("structure_id", "vix", "kind").agg(F.min(dev).alias("_d"))
    sign = F.when(F.col("kind") == "donor", 1.0).otherwise(-1.0)
    per = best.select("structure_id", "vix", "kind", (sign * chem.angle_penalty(F.col("_d"))).alias("v"))
    # an atom that is both counts as donor
    return per.groupBy("structure_id", "vix").agg(F.min_by("v", F.when(F.col("kind") == "donor", 0).otherwise(1)).alias("hbond"))


def vertex_chemistry(vertices: DataFrame, atoms: DataFrame, charges: DataFrame | None = None) -> DataFrame:
    """Vertices of a surface program with hydrogen bonds, hydropathy and electrostatics."""
    v = vertices.withColumns(atom_key_parts("atom_key")).withColumn("structure_id", F.col("protein_id"))
    hb = hydrogen_bonds(v, atoms).withColumnRenamed("structure_id", "protein_id")
    v = hydropathy(v).join(hb, ["protein_id", "vix"], "left")
    if charges is not None:
        v = v.join(charges, ["protein_id", "vix"], "left")
    return v.drop("structure_id")


def build_patches(vertices: DataFrame, faces: DataFrame, limits: dict[str, tuple[float, int]]) -> dict[str, DataFrame]:
    """Patch tables per radius with angles and five feature channels; paths are computed once, for the largest radius."""
    top = max(r for r, _ in limits.values())
    v = vertices
    if "nx" not in v.columns:
        v = materialize(v.join(large(vertex_normals(v, faces)), ["protein_id", "vix"]))
    links = materialize(edges(v, faces))
    geo = geodesics(links, top, v.select("protein_id", F.col("vix").alias("src")))
    curv = materialize(curvatures(v, faces, v.select("protein_id", "vix", "nx", "ny", "nz")))
    out = {}
    for name, (radius, most) in limits.items():
        m = polar_angles(patches(geo, most, radius), v, links, radius)
        out[name] = materialize(patch_features(m, v, curv))
    return out


# Radius and member limit of the two patch tables.
PATCH_LIMITS = {"interface": (9.0, 100), "descriptor": (12.0, 200)}
