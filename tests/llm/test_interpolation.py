"""Deleted interpolation against a model written out with dictionaries and with weights from every single event."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetry.llm import interpolation
from facetry.llm.interpolation import interpolated_scores, op11_interpolation
from tests.llm.fixtures import docs, write


def tokens(text):
    return (text or "").encode().lower().split() + ["end"]


def counted(texts, order):
    counts, kinds = [Counter() for _ in range(order + 1)], set()
    for t in texts:
        line = ["start"] * (order - 1) + tokens(t)
        kinds.update(line[order - 1 :])
        for i in range(order - 1, len(line)):
            for n in range(1, order + 1):
                counts[n][tuple(line[i - n + 1 : i + 1])] += 1
                counts[n - 1][tuple(line[i - n + 1 : i]), "context"] += 1
    return counts, len(kinds)


def events(text, model, order):
    """Per token: order of the longest known context, its bucket, estimates from the uniform one upwards."""
    counts, kinds = model
    line = ["start"] * (order - 1) + tokens(text)
    for i in range(order - 1, len(line)):
        p, longest, bucket = [1 / (kinds + 1)], 0, 0
        for n in range(1, order + 1):
            seen = counts[n - 1][tuple(line[i - n + 1 : i]), "context"]
            p.append(counts[n][tuple(line[i - n + 1 : i + 1])] / seen if seen else 0.0)
            if seen:
                longest, bucket = n, int(math.log2(seen))
        yield longest, bucket, p


def maximised(rows, prior):
    w = list(prior)
    for _ in range(interpolation.ROUNDS):
        new = [x for x in prior]
        for p in rows:
            total = sum(a * b for a, b in zip(w, p))
            new = [s + a * b / total for s, a, b in zip(new, w, p)]
        new = [x / (len(rows) + 1) for x in new]
        done = max(abs(a - b) for a, b in zip(new, w)) < interpolation.TOLERANCE
        w = new
        if done:
            break
    return w


def brute(rows, order):
    part = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 10
    stays, out = [t for i, t in rows if part(i) > 1], [t for i, t in rows if part(i) == 1]
    model, every = counted(stays, order), counted(stays + out, order)
    seen = [e for t in out for e in events(t, model, order)]
    pooled, weights = {}, {}
    for longest in range(order + 1):
        own = [p[: longest + 1] for m, _, p in seen if m == longest]
        even = [1 / (longest + 1)] * (longest + 1)
        pooled[longest] = maximised(own, even) if own else even
        for b in {b for m, b, _ in seen if m == longest}:
            weights[longest, b] = maximised([p[: longest + 1] for m, k, p in seen if (m, k) == (longest, b)], pooled[longest])
    n, v = sum(len(tokens(t)) for t in stays + out), every[1]
    result = []
    for i, t in rows:
        score = sum(math.log10(sum(a * b for a, b in zip(weights.get((m, k), pooled[m]), p))) for m, k, p in events(t, every, order))
        c = [every[0][1][(w,)] for w in tokens(t)]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        result.append((i, part(i) == 0, len(c), sum(x > 0 for x in c), n, base, score))
    return result


def sample(n=150):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    texts[5:8] = [None, "", " \t\n "]
    texts[20] = texts[21] = texts[30]
    texts[40] = "Ärger  UND mehr W1 w1\tw2"
    texts[41] = " ".join(rng.choice(words) for _ in range(20_000))
    return texts


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_model_written_out(spark, monkeypatch, order):
    monkeypatch.setattr(interpolation, "BLOB_BYTES", 4_000)
    monkeypatch.setattr(interpolation, "SHARD_BYTES", 30_000)
    texts = sample()
    rows = list(zip([*range(len(texts) - 2), 3, None], texts))
    df = docs(spark, texts, ids=[i for i, _ in rows]).repartition(3)
    got = interpolated_scores(df.withColumn("blob", F.lit("x")).withColumn("n", F.lit(1)), order).collect()
    order_of = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=order_of), sorted(brute(rows, order), key=order_of), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=2e-3)  # weights come from cells a quarter of an octave wide


def test_weights_of_single_events_are_those_of_plain_maximisation():
    rng = np.random.default_rng(3)
    ratios = rng.pareto(0.6, (300, 2)) * (rng.random((300, 2)) > 0.3)
    bucket = rng.integers(0, 3, 300)
    logs = np.where(ratios > 0, np.log2(np.where(ratios > 0, ratios, 1)), 0.0)
    df = pd.DataFrame({"longest": 2, "bucket": bucket, "steps": (ratios > 0).astype(int).tolist(), "n": 1, "logs": logs.tolist()})
    got = {r.bucket: r.weights for r in interpolation._weights(df).itertuples()}
    rows = [[1.0, *r] for r in ratios.tolist()]
    pooled = maximised(rows, [1 / 3] * 3)
    assert got[-1] == pytest.approx(pooled, abs=1e-6)
    for b in range(3):
        assert got[b] == pytest.approx(maximised([r for r, k in zip(rows, bucket) if k == b], pooled), abs=1e-6)
        assert sum(got[b]) == pytest.approx(1)


def test_probabilities_of_all_tokens_after_a_context_add_up(spark):
    texts = ["a b", "a c", "b a b", "c"] * 30
    got = {}
    for last in ("a", "b", "c", "unknown"):
        rows = texts + ["a b " + last, "a b"]
        df = docs(spark, rows, ids=[*range(len(texts)), None, None])
        scored = interpolated_scores(df).filter("doc_id is null").orderBy("n_tokens").collect()
        assert scored[0]["n_tokens"] == 3
        got[last] = scored
    # p(a b x end) / p(end | b, x) isn't at hand, so compare with the model written out
    for last, rows in got.items():
        want = [r for r in brute([*enumerate(texts), (None, "a b " + last), (None, "a b")], 3) if r[0] is None]
        assert sorted(r["score"] for r in rows) == pytest.approx(sorted(r[6] for r in want), rel=2e-3)


def test_model_beats_the_base_on_unseen_documents(spark, sf):
    rows = op11_interpolation(spark, sf).filter("held_out").collect()
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_no_training_text_and_no_rows(spark, tmp_path):
    only = interpolated_scores(docs(spark, ["a b", None], ids=[None, None])).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in only) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    folder = write(spark, tmp_path, documents=docs(spark, []))
    assert op11_interpolation(spark, folder).collect() == []
