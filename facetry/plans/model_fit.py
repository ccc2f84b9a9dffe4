"""Fit predicted models onto structures: aligned range, crop, superposition, RMSD per chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.align.superpose import place, superpose
from facetry.functions.text import residue_letter
from facetry.operators.contact import rmsd
from facetry.operators.filters import residue_range
from facetry.operators.scale import with_ordinals


def sequences(residues: DataFrame, keys: list[str]) -> DataFrame:
    """One-letter sequence per chain (a chain is one row's worth of text)."""
    r = residues.select(*keys, "resid", residue_letter("resname").alias("_l")).filter(F.col("_l").isNotNull()).distinct()
    return r.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("resid", "_l"))), lambda s: s["_l"]), "").alias("sequence"))


def masked_sequence(residues: DataFrame, hotspots: DataFrame, keys: list[str]) -> DataFrame:
    """Sequence with every residue that is no hotspot shown as a gap."""
    hot = hotspots.select(*keys, "resid").distinct().withColumn("_hot", F.lit(True))
    r = residues.select(*keys, "resid", residue_letter("resname").alias("_l")).distinct().join(hot, [*keys, "resid"], "left")
    letter = F.when(F.col("_hot"), F.col("_l")).otherwise(F.lit("-"))
    r = r.filter(F.col("_l").isNotNull()).select(*keys, "resid", letter.alias("_s"))
    return r.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("resid", "_s"))), lambda s: s["_s"]), "").alias("seq"))


def aligned_columns(alignments: DataFrame, keys: list[str], test: str = "test", ref: str = "ref") -> DataFrame:
    """Aligned residue pairs of two gapped strings: keys, test_ix, ref_ix (from 0 in the ungapped strings)."""
    t, r = (F.filter(F.split(c, ""), lambda x: x != "") for c in (test, ref))
    start = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.array().cast("array<struct<test_ix:int,ref_ix:int>>").alias("out"))

    def step(s: Column, z: Column) -> Column:
        i = s["i"] + F.when(z["t"] != "-", 1).otherwise(0)
        j = s["j"] + F.when(z["r"] != "-", 1).otherwise(0)
        both = (z["t"] != "-") & (z["r"] != "-")
        pair = F.struct(i.alias("test_ix"), j.alias("ref_ix"))
        return F.struct(i.alias("i"), j.alias("j"), F.when(both, F.array_append(s["out"], pair)).otherwise(s["out"]).alias("out"))

    z = F.arrays_zip(t.alias("t"), r.alias("r"))
    ok = alignments.filter(F.assert_true(F.length(test) == F.length(ref), "aligned strings differ in length").isNull())
    return ok.select(*keys, F.explode(F.aggregate(z, start, step)["out"]).alias("p")).select(*keys, "p.*")


def aligned_range(alignments: DataFrame, keys: list[str], test: str = "test", ref: str = "ref") -> DataFrame:
    """First and last reference position that faces a residue; null where none does."""
    ends = aligned_columns(alignments, keys, test, ref).groupBy(*keys).agg(F.min("ref_ix").alias("first"), F.max("ref_ix").alias("last"))
    return alignments.select(*keys).distinct().join(ends, keys, "left")


def fit_models(structure_ca: DataFrame, model_ca: DataFrame, ranges: DataFrame, keys: list[str], positions_as_numbers: bool = True) -> DataFrame:
    """Crop each model to its aligned range, superpose its alpha carbons in order and report the RMSD.

    ``positions_as_numbers`` reads the 0-based alignment positions as residue numbers, as published;
    otherwise they are counted from residue 1.
    """
    cropped = residue_range(model_ca.join(ranges, keys), F.col("first"), F.col("last"), not positions_as_numbers).drop("first", "last")
    a = with_ordinals(structure_ca.select(*keys, "resid", "x", "y", "z"), keys, ["resid"], "ord")
    b = with_ordinals(cropped.select(*keys, "resid", "x", "y", "z"), keys, ["resid"], "ord")
    target = a.select(*keys, "ord", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    both = b.join(target, [*keys, "ord"])
    poses = superpose(both, keys)
    moved = place(both.select(*keys, "ord", "x", "y", "z"), poses, keys, normals=False)
    fixed_ = both.select(*keys, "ord", *[F.col(f"q{c}").alias(c) for c in "xyz"])
    return rmsd(moved, fixed_, keys, "ord").join(poses.select(*keys, "pose"), keys)
