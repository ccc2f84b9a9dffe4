import math
import random
from collections import Counter, defaultdict

import pytest

from facetry.llm import quality
from facetry.llm.quality import classified, op2_quality, scores
from tests.llm import fixtures

LABELS = "doc_id long, quality int, toxic int"


def units(text):
    body = " ".join((text or "").split()).encode("utf-16-le")
    return [1, 1, 1, *[int.from_bytes(body[i : i + 2], "little") for i in range(0, len(body), 2)], 2]


def brute(trusted, texts):
    """Interpolated modified Kneser-Ney by its definition; log probability of each text."""
    grams = Counter(tuple(u[i : i + 4]) for u in map(units, trusted) for i in range(len(u) - 3))
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    stats = {}
    for k, table in levels.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = [0.0]
        for j in (1, 2, 3):
            d.append(min(j - 0.05, max(0.05, j - (j + 1) * y * n[j + 1] / n[j])) if y is not None and n[j] else 0.75 * j)
        contexts = defaultdict(list)
        for g, c in table.items():
            contexts[g[:-1]].append(c)
        stats[k] = d, {h: (sum(cs), sum(d[min(c, 3)] for c in cs)) for h, cs in contexts.items()}

    def p(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        d, contexts = stats[len(g)]
        if g[:-1] not in contexts:
            return p(g[1:])
        total, left = contexts[g[:-1]]
        c = levels[len(g)].get(g, 0)
        return (c - d[min(c, 3)]) / total + left / total * p(g[1:])

    return [sum(math.log(p(tuple(u[i : i + 4]))) for i in range(len(u) - 3)) for u in map(units, texts)]


@pytest.mark.parametrize("block,slice_", [(1 << 24, 1 << 20), (500, 60)])
def test_scores_follow_the_definition(spark, monkeypatch, block, slice_):
    monkeypatch.setattr(quality, "BLOCK_BYTES", block)
    monkeypatch.setattr(quality, "SLICE", slice_)
    monkeypatch.setattr(quality, "FOLDS", 10**12)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "an", "é", "is", "on", "🙂"]) for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(60)] + [None, "", "ZZ##", " \n"]
    langs = ["fr" if i % 3 == 0 else None if i % 3 == 1 else "en" for i in range(60)] + ["en", "fr", "en", "xx"]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 50)] + [(3, 1, 0), (50, 0, 0), (51, 1, 1), (None, 1, 0)], LABELS)
    got = {r["doc_id"]: r for r in scores(fixtures.docs(spark, texts, lang=langs), labels).collect()}
    assert len(got) == len(texts) and got[63]["logp"] is None or math.isnan(got[63]["logp"])
    for lang in ("fr", "en", None):
        own = [i for i in range(len(texts)) if langs[i] == lang]
        want = brute([texts[i] for i in own if i < 50], [texts[i] for i in own])
        for i, w in zip(own, want):
            assert got[i]["logp"] == pytest.approx(w, rel=1e-5, abs=1e-4)
            assert got[i]["n_units"] == len(units(texts[i])) - 3 and got[i]["role"] == int(i < 50)


def test_junk_goes_and_prose_stays(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # held out: half of the labels teach, the others test
    teach = labels.filter("doc_id % 2 = 0")
    got = {r["doc_id"]: r["kept"] for r in classified(docs, teach).select("doc_id", "kept").collect()}
    test = labels.filter("doc_id % 2 = 1").collect()
    good = [got[r["doc_id"]] for r in test if r["quality"] == 1]
    bad = [got[r["doc_id"]] for r in test if r["quality"] == 0]
    assert len(got) == docs.count()
    assert sum(good) / len(good) >= 0.95 and sum(bad) / max(1, len(bad)) <= 0.3


def test_nulls_repeats_and_empty(spark, tmp_path):
    docs = fixtures.docs(spark, ["abc", "abc", None, "x"], ids=[1, 1, None, 2]).withColumnRenamed("n_chars", "block")
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (2, 1, 0), (2, 0, 0)], LABELS)
    got = op2_quality(spark, fixtures.write(spark, tmp_path, documents=docs, labels=labels)).collect()
    assert len(got) == 4 and len({r["log_perplexity"] for r in got if r["doc_id"] == 1}) == 1
    none = op2_quality(spark, fixtures.write(spark, tmp_path / "n", documents=docs, labels=labels.limit(0))).collect()
    assert len(none) == 4 and all(r["kept"] for r in none)
    assert op2_quality(spark, fixtures.write(spark, tmp_path / "e", documents=docs.limit(0), labels=labels)).count() == 0
