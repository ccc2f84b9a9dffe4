"""Selection, text and sampling operators against sequential restatements."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetry.functions import text
from facetry.operators import filters, ranking, select
from facetry.operators.sequence import trim_hotspots
from facetry.operators.similar_text import closest_designs
from facetry.params import SearchParams

TIERS = select.TierRules(tiers=[select.Tier(-1.5, 0.1, 9, 0, 0), select.Tier(-3, 0.1, 9, 0, 0), select.Tier(-5, 0.1, 9, 0, 0), select.Tier(-7.7, 0.1, 9, 0, 0), select.Tier(-10, 0.1, 9, 0, 0)])


def _cascade(nddg, rules, truncate):
    n = len(nddg)
    if n < rules.least:
        return list(nddg)
    limit = lambda t: int(t.nddg) if truncate else t.nddg
    last = list(nddg)
    for i, t in enumerate(rules.tiers):
        now = [x for x in nddg if x < limit(t)]
        if i and len(now) <= rules.least:
            return last
        if len(now) <= rules.most:
            return now
        last = now
    return []


@pytest.mark.parametrize("truncate", [True, False])
def test_tiers_equal_the_cascade(spark, truncate):
    rules = select.TierRules(TIERS.tiers, truncate=truncate)
    rng = np.random.default_rng(0)
    rows = []
    for seed, (n, spread) in enumerate([(0, 1), (3, 1), (5, 1), (6, 1), (40, 9), (41, 9), (200, 3), (200, 30), (300, 80), (120, 7), (90, 4), (60, 1)]):
        rows += [(seed, f"{seed}_{i}", float(-abs(rng.normal()) * spread), 0.5, 1, 1, 10.0) for i in range(n)]
    df = spark.createDataFrame(rows, "seed int, description string, nddg double, sc double, bunsh int, hbonds int, sasa double")
    got = select.tiered_selection(df, rules).toPandas().groupby("seed").nddg.apply(sorted)
    pdf = df.toPandas()
    for seed in range(12):
        want = sorted(_cascade(pdf[pdf.seed == seed].nddg.tolist(), rules, truncate))
        assert list(got.get(seed, [])) == want
    seeds = spark.range(12).select(F.col("id").cast("int").alias("seed"))
    out = {r.outcome: r.seeds for r in select.tier_outcomes(df, rules, seeds).collect()}
    assert out["None"] == 1 and sum(out.values()) >= 12


def test_optional_cutoff_and_fixed_cutoffs(spark):
    df = spark.createDataFrame([("a", 1.0, 70.0), ("b", 1.0, 50.0), ("c", 9.0, 90.0)], "description string, ddg double, dssp_ratio double")
    rules = {"ddg": (0.75, "<=")}
    assert [r.description for r in select.select_by_cutoffs(df, {"ddg": 2.0}, rules, {"dssp_ratio": 66}).collect()] == ["a"]
    assert select.select_by_cutoffs(df.drop("dssp_ratio"), {"ddg": 2.0}, rules, {"dssp_ratio": 66}).count() == 2


def test_best_attempt_keeps_the_earlier_tie(spark):
    df = spark.createDataFrame([(0, 2, 0.5, "b"), (0, 1, 0.5, "a"), (0, 0, 0.4, "c")], "k int, attempt int, score double, pose string")
    r = select.best_attempt(df, ["k"], "score", "attempt", ["pose"]).first()
    assert (r.score, r.attempt, r.pose) == (0.5, 1, "a")


def test_redundancy_mutual_pair(spark):
    df = spark.createDataFrame([("a", -5.0, 0.9, "b"), ("b", -4.0, 0.9, "a"), ("c", -1.0, 0.9, "zz"), ("d", -2.0, 0.7, "a")], "description string, nddg double, similarity double, closest string")
    assert {r.description for r in select.drop_redundant(df).collect()} == {"a", "c", "d"}


def _trim(h):
    if h[-1] - h[0] >= 15:
        while len(h) > 1:
            if h[1] - h[0] > 2:
                h = h[1:]
            elif h[-1] - h[-2] > 2:
                h = h[:-1]
            else:
                break
    return h


def test_trim_hotspots(spark):
    rng = np.random.default_rng(1)
    rows = [(sorted(rng.choice(40, rng.integers(1, 12), replace=False).tolist()),) for _ in range(60)] + [([1, 20],), ([3],)]
    got = spark.createDataFrame(rows, "h array<int>").withColumn("t", trim_hotspots(F.col("h"))).collect()
    assert all(r.t == _trim(list(r.h)) for r in got)


def _nw(a, b):
    m = np.zeros((len(a) + 1, len(b) + 1))
    m[:, 0], m[0] = -np.arange(len(a) + 1), -np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i, j] = max(m[i - 1, j - 1] + (a[i - 1] == b[j - 1]), m[i - 1, j] - 1, m[i, j - 1] - 1)
    return m[-1, -1]


def test_alignment_score(spark):
    rng = np.random.default_rng(2)
    rows = [("".join(rng.choice(list("ABC-"), rng.integers(0, 9))), "".join(rng.choice(list("ABC-"), rng.integers(0, 9)))) for _ in range(40)]
    got = spark.createDataFrame(rows, "a string, b string").withColumn("s", text.alignment_score("a", "b")).collect()
    assert all(r.s == _nw(r.a, r.b) for r in got)


@pytest.mark.parametrize("block", [500, 7])
def test_closest_designs_equals_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("ACDEFGHIK-"), 14)) for _ in range(12)]
    rows = []
    for i in range(70):
        s = list(base[i % 12])
        for _ in range(rng.integers(0, 6)):
            p = rng.integers(0, len(s))
            op = rng.integers(0, 3)
            s[p : p + 1] = [] if op == 0 else [rng.choice(list("ACDEFG"))] if op == 1 else [s[p], rng.choice(list("ACDEFG"))]
        rows.append((f"d{i:02d}", "--" + "".join(s) + "-"))
    rows += [("e1", "---"), ("e2", "")]
    got = {r.description: r for r in closest_designs(spark.createDataFrame(rows, "description string, seq string"), block=block).collect()}
    strip = {n: s.strip("-") for n, s in rows}
    hits = 0
    for n, s in strip.items():
        if not s:
            assert got[n].similarity == 0.0
            continue
        score, best = max((_nw(s, t), m) for m, t in strip.items() if m != n and t)
        hits += score / len(s) > 0.7
        assert got[n].closest == best and abs(got[n].similarity - score / len(s)) < 1e-12
    assert 20 < hits < 60


def test_id_parts_and_names(spark):
    df = spark.createDataFrame([("1ABC_A_",), ("1ABC_AB_C",), ("1ABC_A",)], "id string")
    p = text.pair_parts("id")
    assert [(r.a, r.b) for r in df.select(p["chains1"].alias("a"), p["chains2"].alias("b")).collect()] == [("A", None), ("AB", "C"), ("A", None)]
    n = spark.createDataFrame([("/x/bpd.pdb",)], "f string").select(text.stem("f").alias("s")).first()
    assert n.s == "bpd"
    k = spark.createDataFrame([("_12_x_ALA_CB_Green",)], "k string").select(*[c.alias(m) for m, c in text.atom_key_parts("k").items()]).first()
    assert (k.chain, k.resid, k.icode, k.resname, k.atom) == (" ", 12, " ", "ALA", "CB")


def test_recovery_listed_ranks_only(spark):
    rows = [("t1", 0.9, False, 0), ("t1", 0.8, True, 1), ("t1", 0.7, False, 2), ("t2", 0.9, True, 0), ("t2", 0.1, False, 1)]
    df = spark.createDataFrame(rows, "target string, score double, ok boolean, id int")
    curve = lambda **kw: {r.k: r.solved for r in ranking.recovery_curve(df, "target", "score", F.col("ok"), [0, 1, 3], "id", **kw).collect()}
    assert curve() == {0: 0, 1: 1, 3: 1}  # rank 2 is not looked at
    assert curve(listed_only=False) == {0: 0, 1: 1, 3: 2}


def test_infinite_rmsd_and_unranked(spark):
    df = spark.createDataFrame([("a", 0.5, float("inf")), ("a", 0.4, 1.0), ("b", 0.9, float("inf"))], "t string, s double, rmsd double")
    r = {x.t: x.rank for x in ranking.best_positive_rank(df, ["t"], "s", F.col("rmsd") < 2.0).collect()}
    assert r == {"a": 2, "b": None}
    assert ranking.best_positive_rank(df, ["t"], "s", F.col("rmsd") < 2.0, worst=1).filter("rank is not null").count() == 0


def test_similarity_mode_and_name_filters(spark):
    p = SearchParams().similarity_mode()
    assert not p.flip_normals and p.outward_shift == 0 and p.max_ca_clashes == float("inf") and p.min_score == -1
    df = spark.createDataFrame([("1ABC_A_B",), ("x.npy",), ("y.txt",)], "id string")
    assert df.filter(filters.data_names(F.col("id"))).count() == 1


def test_single_residue_assertion(spark):
    ok = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert filters.assert_single(ok, ["k"], "twice").count() == 2
    with pytest.raises(Exception, match="twice"):
        filters.assert_single(ok.union(ok), ["k"], "twice").collect()
