"""Fixed-format text: meshes, point lists, hit lines, structures, surface-tool input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.chem import SURFACE_RADII, is_polar_hydrogen, surface_radius
from facetry.functions.text import RESIDUE_LETTERS, fixed
from facetry.operators.filters import not_hydrogen_name


def write_files(rows: DataFrame, path: str, key: str, order: list[str], value: str = "value", mode: str = "errorifexists") -> None:
    """One text file per key with lines in order: rows are sorted on their way to the file, never collected."""
    parts = rows.select(F.col(key), *order, F.col(value).alias("value")).repartition(key).sortWithinPartitions(key, *order)
    parts.select(key, "value").write.mode(mode).partitionBy(key).text(path)


MESH_PROPERTIES = ("x", "y", "z", "nx", "ny", "nz", "charge", "hbond", "hphob", "iface_label")


def mesh_lines(vertices: DataFrame, faces: DataFrame, properties: tuple[str, ...] = MESH_PROPERTIES, digits: int = 2) -> DataFrame:
    """ASCII mesh per protein: protein_id, part, ix, value."""
    props = [p for p in properties if p in vertices.columns]
    nv = vertices.groupBy("protein_id").agg(F.count("*").alias("n"))
    nf = faces.groupBy("protein_id").agg(F.count("*").alias("m"))
    head = nv.join(nf, "protein_id", "left").na.fill(0, ["m"])
    text = F.concat(
        F.lit("ply\nformat ascii 1.0\nelement vertex "),
        F.col("n").cast("string"),
        *[F.lit(f"\nproperty float {p.replace('iface_label', 'iface')}") for p in props],
        F.lit("\nelement face "),
        F.col("m").cast("string"),
        F.lit("\nproperty list uchar int vertex_indices\nend_header"),
    )
    h = head.select("protein_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("ix"), text.alias("value"))
    v = vertices.select("protein_id", F.lit(1).alias("part"), F.col("vix").cast("bigint").alias("ix"), F.concat_ws(" ", *[fixed(F.coalesce(p, F.lit(0.0)), digits) for p in props]).alias("value"))
    f = faces.select("protein_id", F.lit(2).alias("part"), F.col("fix").cast("bigint").alias("ix"), F.concat_ws(" ", F.lit("3"), *[F.col(c).cast("string") for c in ("v0", "v1", "v2")]).alias("value"))
    return h.unionAll(v).unionAll(f)


def write_meshes(vertices: DataFrame, faces: DataFrame, path: str, **kw) -> None:
    write_files(mesh_lines(vertices, faces, **kw), path, "protein_id", ["part", "ix"])


def point_lines(points: DataFrame) -> DataFrame:
    return points.withColumn("value", F.concat_ws(", ", *[F.col(c).cast("string") for c in "xyz"]))


def hit_line(name="name", point="point_id") -> Column:
    """Score line of a hit: fields in fixed order, the score with four decimals."""
    c = lambda n: F.col(n).cast("string")
    pairs = [
        ("name", c(name)),
        ("point id", c(point)),
        ("score", fixed("score", 4)),
        *[(k, c(k)) for k in ("clashing_ca", "clashing_heavy", "desc_dist_score", "mean_desc_dist_score", "match_vix", "desc_dist", "iface_score")],
    ]
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in pairs])  # an empty value keeps its place


def scan_lines(hits: DataFrame) -> DataFrame:
    return hits.select(F.concat_ws(" ", "protein_id", fixed("score", 4), "pid").alias("value"))


def atom_line(serial: Column | str = "serial") -> Column:
    """Fixed-column atom record."""
    rec = F.when(F.col("hetflag") == " ", F.lit("ATOM")).otherwise(F.lit("HETATM"))
    # names of up to three letters start one column later
    name = F.when(F.length("atom") < 4, F.format_string(" %-3s", "atom")).otherwise(F.col("atom"))
    s = F.col(serial) if isinstance(serial, str) else serial
    return F.format_string(
        "%-6s%5d %4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s",
        rec, s.cast("int"), name, "altloc", "resname", "chain", "resid", "icode", "x", "y", "z", F.lit(1.0), F.lit(0.0), "element",
    )


def posed_structures(placed: DataFrame) -> DataFrame:
    """Atom lines of placed structures without hydrogens (by name)."""
    return placed.filter(not_hydrogen_name()).withColumn("value", atom_line())


def chain_extract(atoms: DataFrame, chains: list[str], het: bool = True) -> DataFrame:
    keep = F.col("chain").isin(chains)
    if not het:
        keep = keep & (F.col("hetflag") == " ")
    return atoms.filter(keep).withColumn("value", atom_line())


def seed_with_breaks(fragments: DataFrame, key: str = "structure_id") -> DataFrame:
    """Atom lines of a seed with a TER line after each fragment: key, order columns, value."""
    body = fragments.select(key, "fragment", F.lit(0).alias("end"), "serial", atom_line().alias("value"))
    ends = fragments.select(key, "fragment").distinct().select(key, "fragment", F.lit(1).alias("end"), F.lit(0).alias("serial"), F.lit("TER").alias("value"))
    return body.unionByName(ends)


def surface_input(atoms: DataFrame, keep_hetero: list[str] = ()) -> DataFrame:
    """Input of a surface program: ``x y z radius 1 atom_key``; atoms without a radius are left out."""
    known = list(RESIDUE_LETTERS) + list(keep_hetero)
    kind = F.substring("atom", 1, 1)
    src = atoms.filter(((F.col("hetflag") == " ") | F.col("resname").isin(list(keep_hetero))) & F.col("resname").isin(known) & kind.isin(list(SURFACE_RADII)))
    polar = is_polar_hydrogen(F.col("resname"), F.col("atom")) & ~F.col("resname").isin(list(keep_hetero) or [""])
    color = F.when(kind == "O", "Red").when(kind == "N", "Blue").when((kind == "H") & polar, "Blue").otherwise("Green")
    code = F.when(F.col("icode") == " ", F.lit("x")).otherwise(F.col("icode"))
    key = F.concat_ws("_", "chain", F.col("resid").cast("string"), code, "resname", "atom", color)
    return src.select("structure_id", "serial", F.format_string("%.6f %.6f %.6f %.6f 1 %s", "x", "y", "z", surface_radius(kind), key).alias("value"))
