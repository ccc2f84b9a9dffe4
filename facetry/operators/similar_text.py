"""Closest other design by global alignment of its hotspot string."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.text import alignment_score, strip_gaps
from facetry.session import materialize


def _slack(length: Column, above: float) -> Column:
    """Most score a string of this length may lose and still be more similar than ``above``."""
    return F.greatest(F.ceil(length * (1 - above) - 1e-9) - 1, F.lit(0)).cast("int")


def _aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Best global alignment: +1 per match, 0 per mismatch, -1 per gap position."""
    ramp = np.arange(len(b) + 1)
    row = -ramp
    for i, letter in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = -i
        new[1:] = np.maximum(row[:-1] + (b == letter), row[1:] - 1)
        row = np.maximum.accumulate(new + ramp) - ramp
    return int(row[-1])


def _block_best(df: pd.DataFrame) -> pd.DataFrame:
    """Best partner of each owner within one block of strings; shared letters bound a score from above."""
    codes = lambda s: np.frombuffer(s.encode("utf-32-le"), dtype="<u4")
    own, other = df[df["_side"] == 0], df[df["_side"] == 1]
    letters = sorted(set("".join(df["_text"])))
    counts = lambda part: np.array([[s.count(c) for c in letters] for s in part["_text"]]).reshape(len(part), len(letters))
    ca, cb = counts(own), counts(other)
    texts = [codes(s) for s in other["_text"]]
    names, strings, out = other["_name"].tolist(), other["_text"].tolist(), []
    for (name, text), have in zip(own[["_name", "_text"]].itertuples(index=False), ca):
        bound = np.minimum(have, cb).sum(axis=1)
        a, best = codes(text), None
        for j in np.argsort(-bound, kind="stable"):
            if best and bound[j] < best[0]:
                break
            if strings[j] != text:
                best = max(best or (-(10**9), names[j]), (_aligned(a, texts[j]), names[j]))
        if best:
            out.append((name, best[0] / len(text), best[1]))
    return pd.DataFrame(out, columns=["_id", "similarity", "closest"])


def _below(owners: DataFrame, others: DataFrame, block: int) -> DataFrame:
    """Best partner of ``owners`` (_id, _s) among ``others`` (_t, _t_id), block against block."""
    kind = dict(owners.dtypes)["_id"]
    parts = lambda df: max(1, -(-df.count() // block))
    left, right = parts(owners), parts(others)
    a = owners.select(F.col("_id").alias("_name"), F.col("_s").alias("_text"), F.pmod(F.xxhash64("_s"), F.lit(left)).alias("_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(right - 1).cast("long"))).alias("_b"), F.lit(0).alias("_side"))
    b = others.select(F.col("_t_id").alias("_name"), F.col("_t").alias("_text"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(left - 1).cast("long"))).alias("_a"), F.pmod(F.xxhash64("_t"), F.lit(right)).alias("_b"), F.lit(1).alias("_side"))
    best = a.unionByName(b).groupBy("_a", "_b").applyInPandas(_block_best, f"_id {kind}, similarity double, closest {kind}")
    return best.groupBy("_id").agg(F.max(F.struct("similarity", "closest")).alias("m")).select("_id", "m.similarity", "m.closest")


def closest_designs(designs: DataFrame, name: str = "description", seq: str = "seq", above: float = 0.7, block: int = 500) -> DataFrame:
    """Best other design per design: name, ``similarity`` (score / own length), ``closest``; the last name wins ties.

    Similarities over ``above`` are found through shared pieces, lower ones by comparing the designs left with all strings in
    blocks of both sides (0 for an empty string, null without any other). Copies of a string are settled among themselves, each by the last other name. Distinct strings
    are only aligned if one of the owner's ``slack + 1`` pieces turns up in the other string near its
    place, which every partner within the slack must satisfy.
    """
    d = designs.select(F.col(name).alias("_id"), strip_gaps(seq).alias("_s"))
    # last and last but one name of every string
    last = d.groupBy("_s").agg(F.max("_id").alias("_a"), F.count("*").alias("_n"))
    second = d.join(last.select("_s", "_a"), "_s").filter(F.col("_id") != F.col("_a")).groupBy("_s").agg(F.max("_id").alias("_b"))
    strings = last.join(second, "_s", "left")
    has_copy = d.join(strings, "_s").filter((F.col("_n") > 1) & (F.col("_s") != ""))
    copies = has_copy.select("_id", F.lit(1.0).alias("similarity"), F.when(F.col("_id") == F.col("_a"), F.col("_b")).otherwise(F.col("_a")).alias("closest"))

    owners = strings.filter((F.col("_n") == 1) & (F.col("_s") != "")).select(F.col("_a").alias("_id"), "_s").withColumn("_len", F.length("_s"))
    owners = owners.withColumn("_slack", _slack(F.col("_len"), above))
    start = lambda i: F.floor(i * F.col("_len") / (F.col("_slack") + 1)).cast("int")
    pieces = owners.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_slack"))))
    pieces = pieces.withColumn("_p", start(F.col("_i"))).withColumn("_l", start(F.col("_i") + 1) - F.col("_p"))
    # a slack under (1 - above) * len leaves pieces of at least 1 / (1 - above) letters, give or take one
    longest = math.ceil(1 / (1 - above)) + 1
    pieces = pieces.filter("_l > 0").withColumn("_l", F.least("_l", F.lit(longest)))
    pieces = pieces.withColumn("_piece", F.substring("_s", F.col("_p") + 1, F.col("_l")))
    others = strings.filter("_s <> ''").select(F.col("_s").alias("_t"), F.col("_a").alias("_t_id"))
    grams = others.withColumn("_q", F.explode(F.sequence(F.lit(0), F.length("_t") - 1))).withColumn("_gl", F.explode(F.sequence(F.lit(1), F.lit(longest))))
    grams = grams.filter(F.col("_q") + F.col("_gl") <= F.length("_t")).withColumn("_piece", F.substring("_t", F.col("_q") + 1, F.col("_gl"))).drop("_gl")
    # the place is part of the key, so a common piece does not bring all its owners together
    pieces = pieces.withColumn("_q", F.explode(F.sequence(F.col("_p") - F.col("_slack"), F.col("_p") + F.col("_slack"))))
    near = (F.abs(F.length("_t") - F.col("_len")) <= F.col("_slack")) & (F.col("_t") != F.col("_s"))
    pairs = pieces.join(grams, ["_piece", "_q"]).filter(near).select("_id", "_s", "_len", "_slack", "_t", "_t_id").distinct()
    scored = pairs.withColumn("_sc", alignment_score("_s", "_t")).filter(F.col("_sc") >= F.col("_len") - F.col("_slack"))
    best = scored.groupBy("_id", "_len").agg(F.max(F.struct("_sc", "_t_id")).alias("b"))
    found = best.select("_id", (F.col("b._sc") / F.col("_len")).alias("similarity"), F.col("b._t_id").alias("closest")).filter(F.col("similarity") > above)
    found = materialize(copies.unionByName(found))
    far = owners.select("_id", "_s").join(found.select("_id"), "_id", "left_anti")
    out = d.join(found.unionByName(_below(far, others, block)), "_id", "left")
    return out.select(F.col("_id").alias(name), F.when(F.col("_s") == "", 0.0).otherwise(F.col("similarity")).alias("similarity"), "closest")
