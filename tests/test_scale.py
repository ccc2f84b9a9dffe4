"""Order-dependent helpers against pandas, with one key holding a third of the rows and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetry.operators import scale
from facetry.operators.ranking import auc
from facetry.operators.sampling import repaired
from facetry.operators.sequence import best_window, fragments, state_runs


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n)),
            "v": np.where(rng.random(n) < 0.35, 7.0, rng.normal(size=n) * 10),
            "i": rng.permutation(n),
            "s": rng.choice(list("HHHE"), n),
            "w": rng.integers(0, 9, n).astype(float),
        }
    )
    return pdf, spark.createDataFrame(pdf)


def test_ordinals_split_heavy_ties(skewed):
    pdf, df = skewed
    got = scale.with_ordinals(df, ["k"], ["v", "i"], segment_rows=150).toPandas().set_index("i").pos
    want = pdf.sort_values(["k", "v", "i"])
    want = want.assign(pos=want.groupby("k").cumcount()).set_index("i").pos
    assert (got.sort_index() == want.sort_index()).all()


def test_running_without_keys(skewed):
    pdf, df = skewed
    got = scale.running(df, [], ["i"], {"c": F.col("w")}, 200).toPandas().sort_values("i")
    assert np.allclose(got.c, pdf.sort_values("i").w.cumsum())


@pytest.mark.parametrize("small", [0, 10**6])
def test_exact_percentiles(skewed, small):
    pdf, df = skewed
    got = scale.exact_percentiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 1.0, "d": 0.0}, accuracy=100, small_group=small)
    got = got.toPandas().set_index("k").sort_index()
    want = pdf.groupby("k").v.quantile([0.25, 0.5, 1.0, 0.0]).unstack()[[0.25, 0.5, 1.0, 0.0]]
    assert np.allclose(got[list("abcd")].values, want.values)


def test_top_k_large_and_small(skewed):
    pdf, df = skewed
    for k in (3, 1100):
        got = scale.top_k(df, ["k"], [F.desc("v"), F.col("i")], k).toPandas()
        want = pdf.sort_values(["v", "i"], ascending=[False, True]).groupby("k").head(k)
        assert set(got.i) == set(want.i)


@pytest.mark.parametrize("kind", ["string", "long", "decimal", "timestamp", "null"])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_segments_follow_the_real_order(spark, kind, keys):
    n = 400
    make = {
        "string": "concat('protein_00000', lpad(id % 57, 4, '0'))",
        "long": "9007199254740993 + id % 57",
        "decimal": "cast(12345678901234567890 as decimal(30,4)) + cast(id % 57 as decimal(30,4)) / 1000",
        "timestamp": "timestamp_micros(1700000000000000 + id % 57)",
        "null": "if(id % 3 = 0, null, 'same')",
    }[kind]
    df = spark.range(n).selectExpr("id", f"{make} as s", f"{n} - id as k", "if(id % 3 = 0, 'hot', concat('g', id % 11)) as g").repartition(7)
    rows = lambda size: sorted((r["id"], r["pos"]) for r in scale.with_ordinals(df, keys, ["s", "k"], "pos", size).collect())
    assert rows(50) == rows(10**6)


def test_auc_over_segments(skewed):
    pdf, df = skewed
    got = auc(df, ["k"], F.col("v"), F.col("s") == "H", segment_rows=100).toPandas().set_index("k").auc
    for k, g in pdf.groupby("k"):
        p, q = g.v[g.s == "H"].values, g.v[g.s != "H"].values
        want = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
        assert abs(got[k] - want) < 1e-12
    # any rising change of the score leaves it as it is
    other = auc(df, [], F.exp(F.col("v") / 50), F.col("s") == "H", segment_rows=100).first().auc
    assert abs(other - auc(df, [], F.col("v"), F.col("s") == "H").first().auc) < 1e-12


def test_best_window_over_blocks(skewed):
    pdf, df = skewed
    got = best_window(df, ["k"], ["i"], "w", 12, segment_rows=100).toPandas().set_index("k")
    for k, g in pdf.sort_values("i").groupby("k"):
        sums = np.convolve(g.w.values, np.ones(12), "valid") if len(g) >= 12 else []
        if len(sums):
            assert got.start[k] == int(np.argmax(sums)) and got.total[k] == max(sums)
        else:
            assert k not in got.index


def _runs(states, numbers, longer, compat):
    out, cur = [], []
    for j, (s, n) in enumerate(zip(states, numbers)):
        adjacent = j > 0 and numbers[j - 1] == n - 1
        if s == "H" and (adjacent or (not compat and not cur)):
            cur.append(j)
            continue
        if len(cur) > longer:
            out.append((cur[0], cur[-1]))
        cur = [j] if s == "H" and not compat else []
    if len(cur) > longer and not compat:
        out.append((cur[0], cur[-1]))
    return out


@pytest.mark.parametrize("compat", [False, True])
def test_state_runs(skewed, spark, compat):
    pdf, _ = skewed
    pdf = pdf.sort_values("i").assign(num=lambda d: d.groupby("k").cumcount() + (d.groupby("k").cumcount() // 17))
    df = spark.createDataFrame(pdf)
    got = state_runs(df, ["k"], ["i"], F.col("s") == "H", "num", 3, compat, segment_rows=90).toPandas()
    want = {(k, a, b) for k, g in pdf.groupby("k") for a, b in _runs(g.s.values, g.num.values, 3, compat)}
    assert want and {(r.k, r["first"], r["last"]) for _, r in got.iterrows()} == want


def test_fragments_over_segments(skewed):
    pdf, df = skewed
    got = fragments(df, ["k"], ["i"], F.col("s") == "E", segment_rows=120).toPandas().set_index("i").fragment.sort_index()
    d = pdf.sort_values("i")
    want = d.assign(f=d.groupby("k").s.transform(lambda s: (s == "E").cumsum().shift(fill_value=0) + 1)).set_index("i").f.sort_index()
    assert (got == want).all()


def test_repaired_uses_every_row_once(skewed):
    _, df = skewed
    left, right = df.select("k", F.col("i").alias("a")), df.select("k", F.col("i").alias("b"))
    got = repaired(left, right, ["k"], "a", "b", seed=4, segment_rows=100).toPandas()
    assert got.a.is_unique and got.b.is_unique and len(got) == df.count() and (got.a != got.b).mean() > 0.8


def test_percentiles_of_few_groups_leave_rows_in_place(skewed, capsys):
    """Whole columns as groups: rows meet their brackets where they are, instead of gathering by key in a few tasks."""
    pdf, df = skewed
    spark, conf = df.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        out = scale.exact_percentiles(df, ["k"], "v", {"a": 0.25, "b": 0.5}, accuracy=100, small_group=0)
        out.explain()
        got = out.toPandas().set_index("k").sort_index()
    finally:
        spark.conf.set(conf, old)
    assert "SortMergeJoin" not in capsys.readouterr().out
    assert np.allclose(got[["a", "b"]].values, pdf.groupby("k").v.quantile([0.25, 0.5]).unstack().values)


def test_best_window_ties_are_exact(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 are the same total, whatever the order of addition leaves in the last place."""
    rows = [(1, i, v) for i, v in enumerate([0.3, 0.2, 0.1, 0.0, 0.1, 0.2, 0.3])] + [(2, i, v) for i, v in enumerate([1e300, 1.0, 2.0, 3e300])]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    got = {r["k"]: (r["start"], r["total"]) for r in best_window(df, ["k"], ["i"], "v", 3).collect()}
    assert got[1][0] == 0 and got[1][1] == pytest.approx(0.6)
    assert got[2] == (1, 3e300)
