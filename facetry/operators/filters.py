"""Predicates over structures, patches and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.text import RESIDUE_LETTERS

# Nucleotide residue names kept on request.
NUCLEOTIDES = ["A", "C", "G", "U", "DA", "DC", "DG", "DT", "DU"]


def candidate(score: str, dist: str, min_score: float, max_dist: float) -> Column:
    return (F.col(score) > min_score) & (F.col(dist) < max_dist)


def hit(min_score: float, min_desc_score: float | None = None) -> Column:
    keep = F.col("score") > min_score
    return keep if min_desc_score is None else keep & (F.col("desc_dist_score") > min_desc_score)


def clash_ok(max_ca: float, max_heavy: float) -> Column:
    return (F.col("clashing_ca") <= max_ca) & (F.col("clashing_heavy") <= max_heavy)


def listed(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")


def not_listed_by_prefix(df: DataFrame, id_col: str, held_out: DataFrame) -> DataFrame:
    """Drop ids whose first part names a held-out structure, in any letter case."""
    key = F.upper(F.split(F.col(id_col), "_")[0])
    bad = held_out.select(F.upper(F.split("id", "_")[0]).alias("_key")).distinct()
    return df.withColumn("_key", key).join(bad, "_key", "left_anti").drop("_key")


def data_names(name: Column) -> Column:
    """Names that are neither array nor text files."""
    return ~(name.contains(".npy") | name.contains(".txt"))


def chain_atoms(atoms: DataFrame, chains: list[str], modified: list[str] = (), ligand: str | None = None, nucleotides: bool = False, ligand_chain: str | None = None) -> DataFrame:
    """Atoms of the chains: regular residues, listed modified residues, one ligand (of ``ligand_chain`` if it lies in another chain), optionally nucleotides."""
    keep = F.col("hetflag") == " "
    if modified:
        keep = keep | F.col("resname").isin(list(modified))
    other = F.lit(False)
    if ligand and ligand_chain:
        other = (F.col("resname") == ligand) & (F.col("chain") == ligand_chain)
    elif ligand:
        keep = keep | (F.col("resname") == ligand)
    if nucleotides:
        keep = keep | F.col("resname").isin(NUCLEOTIDES)
    return atoms.filter((F.col("chain").isin(list(chains)) & keep) | other)


def first_altloc(atoms: DataFrame, letters: tuple[str, ...] = ("A", "1")) -> DataFrame:
    return atoms.filter((F.col("altloc") == " ") | F.col("altloc").isin(*letters))


def not_hydrogen_name() -> Column:
    """By atom name, as poses and clash counts do (drops e.g. mercury too)."""
    return ~F.col("atom").startswith("H")


def not_hydrogen_element() -> Column:
    return F.col("element") != "H"


def standard_residues(atoms: DataFrame) -> DataFrame:
    return atoms.filter(F.col("resname").isin(list(RESIDUE_LETTERS)))


def alpha_carbons(atoms: DataFrame) -> DataFrame:
    return atoms.filter(F.col("atom") == "CA")


def residue_range(atoms: DataFrame, start: Column, end: Column, zero_based: bool = False) -> DataFrame:
    """Residues start..end without hetero groups; ``zero_based`` reads the ends as positions from 0."""
    shift = 1 if zero_based else 0
    return atoms.filter(F.col("resid").between(start + shift, end + shift) & (F.col("hetflag") == " "))


def in_states(residues: DataFrame, sse: DataFrame, states: list[str], keys: tuple[str, ...] = ("structure_id", "chain", "resid")) -> DataFrame:
    return residues.join(sse.filter(F.col("state").isin(states)).select(*keys).distinct(), list(keys), "left_semi")


def assert_single(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """Fail the job where a key does not name exactly one distinct item (a count per key)."""
    c = df.groupBy(*keys).agg(F.count("*").alias("_c"))
    checked = c.filter(F.assert_true(F.col("_c") == 1, message).isNull())
    return df.join(checked.drop("_c"), keys, "left_semi")


def usable_patches(members: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Drop every patch that has a missing or NaN feature in any member."""
    bad = None
    for f in features:
        b = F.col(f).isNull() | F.isnan(f)
        bad = b if bad is None else bad | b
    broken = members.groupBy(*keys).agg(F.bool_or(bad).alias("_bad")).filter("_bad").drop("_bad")
    return members.join(broken, keys, "left_anti")


def usable_pairs(pairs: DataFrame, members: DataFrame, keys: list[str], features: list[str], roles: list[str]) -> DataFrame:
    """Keep (binder, positive, negative) index rows only if none of the three patches is broken."""
    bad = None
    for f in features:
        b = F.col(f).isNull() | F.isnan(f)
        bad = b if bad is None else bad | b
    broken = members.groupBy(*keys).agg(F.bool_or(bad).alias("_bad")).filter("_bad").select(F.struct(*keys).alias("_ref"))
    for role in roles:
        pairs = pairs.join(broken, pairs[role] == broken["_ref"], "left_anti")
    return pairs


def trainable(labels: DataFrame, key: str, label: str, max_vertices: int = 8000, max_share: float = 0.75, min_positives: int = 30) -> DataFrame:
    """Proteins small enough, with enough positives and not mostly positive."""
    s = labels.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return s.filter((F.col("n") <= max_vertices) & (F.col("pos") <= max_share * F.col("n")) & (F.col("pos") >= min_positives))


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without a result yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def chain_with_residue(atoms: DataFrame, resname: str) -> DataFrame:
    """First chain of the first model that holds a residue name; fails if there is none."""
    found = atoms.groupBy("structure_id").agg(
        F.min_by(F.when((F.col("model") == 0) & (F.col("resname") == resname), F.col("chain")), F.when((F.col("model") == 0) & (F.col("resname") == resname), F.col("serial"))).alias("chain")
    )
    return found.filter(F.assert_true(F.col("chain").isNotNull(), f"no residue {resname}").isNull())
