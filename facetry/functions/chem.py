"""Chemistry look-ups and per-vertex chemistry terms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions.geometry import angle_deviation, angle_penalty, plane_deviation

# Atom radii used for surface generation.
SURFACE_RADII = {"N": 1.54, "O": 1.40, "C": 1.74, "H": 1.20, "S": 1.80, "P": 1.80, "Z": 1.39, "X": 0.77}
# Van der Waals radii used for contacts; other elements count as 1.2.
CONTACT_RADII = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "Cl": 1.75, "P": 1.80, "S": 1.80}
CONTACT_DEFAULT = 1.2
CONTACT_SLACK = 0.2
# Kyte-Doolittle hydropathy.
HYDROPATHY = {
    "ILE": 4.5, "VAL": 4.2, "LEU": 3.8, "PHE": 2.8, "CYS": 2.5, "MET": 1.9, "ALA": 1.8, "GLY": -0.4, "THR": -0.7, "SER": -0.8,
    "TRP": -0.9, "TYR": -1.3, "PRO": -1.6, "HIS": -3.2, "GLU": -3.5, "GLN": -3.5, "ASP": -3.5, "ASN": -3.5, "LYS": -3.9, "ARG": -4.5,
}
# Polar hydrogens of each residue.
POLAR_HYDROGENS = {
    "ALA": ["H"],
    "GLY": ["H"],
    "SER": ["H", "HG"],
    "THR": ["H", "HG1"],
    "LEU": ["H"],
    "ILE": ["H"],
    "VAL": ["H"],
    "ASN": ["H", "HD21", "HD22"],
    "GLN": ["H", "HE21", "HE22"],
    "ARG": ["H", "HH11", "HH12", "HH21", "HH22", "HE"],
    "HIS": ["H", "HD1", "HE2"],
    "TRP": ["H", "HE1"],
    "PHE": ["H"],
    "TYR": ["H", "HH"],
    "GLU": ["H"],
    "ASP": ["H"],
    "LYS": ["H", "HZ1", "HZ2", "HZ3"],
    "PRO": [],
    "CYS": ["H"],
    "MET": ["H"],
}
# Heavy atom carrying a polar hydrogen.
HYDROGEN_DONOR = {
    "H": "N", "HH11": "NH1", "HH12": "NH1", "HH21": "NH2", "HH22": "NH2", "HE": "NE", "HD21": "ND2", "HD22": "ND2", "HE21": "NE2",
    "HE22": "NE2", "HD1": "ND1", "HE2": "NE2", "HE1": "NE1", "HZ1": "NZ", "HZ2": "NZ", "HZ3": "NZ", "HH": "OH", "HG": "OG", "HG1": "OG1",
}
# Atom before an acceptor, and third atom of its plane.
ACCEPTOR_BASE = {
    "O": "C", "O1": "C", "O2": "C", "OXT": "C", "OT1": "C", "OT2": "C", "OD1": "CG", "OD2": "CG", "OE1": "CD", "OE2": "CD",
    "ND1": "CE1", "NE2": "CE1", "OH": "CZ", "OG": "CB", "OG1": "CB",
}
ACCEPTOR_PLANE = {
    "O": "CA", "OD1": "CB", "OD2": "CB", "OE1": "CG", "OE2": "CG", "ND1": "NE2", "NE2": "ND1", "OH": "CE1",
}


def is_polar_hydrogen(residue: Column, atom: Column) -> Column:
    names = lookup({k: ",".join(v) for k, v in POLAR_HYDROGENS.items()}, residue, "")
    return (names != "") & F.array_contains(F.split(names, ","), atom)


def lookup(table: dict, key: Column, default=None) -> Column:
    m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(m, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def table_frame(spark: SparkSession, table: dict, key: str, value: str) -> DataFrame:
    """A fixed look-up as a table, for joins."""
    return spark.createDataFrame(list(table.items()), f"{key} string, {value} {'double' if isinstance(next(iter(table.values())), float) else 'string'}")


def contact_radius(element: Column) -> Column:
    return lookup(CONTACT_RADII, element, CONTACT_DEFAULT)


def surface_radius(element: Column) -> Column:
    return lookup(SURFACE_RADII, element)


def hydropathy(resname: Column) -> Column:
    return lookup(HYDROPATHY, resname, 0.0)


def fragment_hydropathy(logp: Column) -> Column:
    """Hydropathy of a ligand fragment from its partition coefficient."""
    raw = F.lit(-6.2786) + F.exp(F.lit(0.4772) * logp + F.lit(1.8491))
    return F.least(F.lit(4.5), F.greatest(F.lit(-4.5), raw))


def normalize_charge(charge: Column, limit: float = 3.0) -> Column:
    clipped = F.greatest(F.lit(-limit), F.least(F.lit(limit), charge))
    return (clipped + limit) / (2 * limit) * 2 - 1


def written_charge(charge: Column) -> Column:
    return charge / 10.0


def flip_features(si, ddc, hbond, charge, hphob, theta) -> dict[str, Column]:
    """The complementary view of a patch: everything changes sign but hydropathy; the angle turns back."""
    neg = lambda c: -F.col(c)
    return {"si": neg(si), "ddc": neg(ddc), "hbond": neg(hbond), "charge": neg(charge), "hphob": F.col(hphob), "theta": F.lit(2 * math.pi) - F.col(theta)}


def shape_index(mean_curvature: Column, gauss_curvature: Column) -> Column:
    elem = mean_curvature * mean_curvature - gauss_curvature
    elem = F.when(elem < 0, F.lit(1e-8)).otherwise(elem)
    k1, k2 = mean_curvature + F.sqrt(elem), mean_curvature - F.sqrt(elem)
    # equal curvatures give +-1; a point without any curvature has no index
    flat = (k1 == k2) & (k1 + k2 == 0)
    return F.when(flat, F.lit(float("nan"))).otherwise(F.atan2(k1 + k2, k1 - k2) * (2 / math.pi))


def hbond_donor_term(donor, hydrogen, vertex) -> Column:
    """Positive: the vertex lies straight ahead of a polar hydrogen."""
    return angle_penalty(angle_deviation(donor, hydrogen, vertex, math.pi))


def hbond_acceptor_term(base, acceptor, vertex, plane=None) -> Column:
    """Negative: the vertex lies at 120 degrees to an acceptor, and in its plane where one is known."""
    term = angle_penalty(angle_deviation(base, acceptor, vertex, 2 * math.pi / 3))
    if plane is not None:
        term = term * angle_penalty(plane_deviation(plane, base, acceptor, vertex))
    return -term
