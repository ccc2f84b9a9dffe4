import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from facetry.llm.packing import CAPACITY, encoder, piece_bounds
from tests.llm import fixtures
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_line_dedup import brute as kept_lines
from tests.llm.test_near_dups import brute as groups


def corpus(rng):
    word = lambda: rng.choice(["th", "an", "re", "on"]) + rng.choice(["is", "er", "ing", "or", "ed"]) + rng.choice(["", "s", "ly", "tion"])
    say = lambda n: " ".join(word() for _ in range(n))
    texts = ["\n".join(say(rng.randint(15, 40)) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts = [f"{t}\nshared footer line" if i % 3 == 0 else t for i, t in enumerate(texts)]
    item = say(14)
    texts += [texts[1], texts[2] + " more", f"{say(30)} {item.upper()}\n{say(20)}", None, "", say(3000)]
    return texts, item


def test_against_brute_force(spark, tmp_path):
    texts, item = corpus(random.Random(9))
    docs = fixtures.docs(spark, texts)
    junk = ["$%$%#@!{} " * 40, "|||### ### |||" * 30]
    docs = docs.unionByName(fixtures.docs(spark, junk, ids=[900, 901]))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(55)], "doc_id long, quality int, toxic int")
    folder = fixtures.write(spark, tmp_path, documents=docs, labels=labels, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, seen, folder))
        assert after.schema == seen.schema or after.columns == seen.columns
        before = {r["doc_id"]: r["text"] for r in seen.collect()}
        now = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "quality":
            assert set(before) - set(now) >= {900, 901} and len(set(before) - set(now)) <= 8
        elif name == "line_dedup":
            want = dict(zip(before, kept_lines(list(before.values()), 10, 0.5)))
            assert now == {i: None if before[i] is None else "\n".join(want[i]) for i in before}
            assert "shared footer line" not in str(now.values())
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after.collect())
        elif name == "near_dups":
            assert set(now) == {i for i, (_, root) in groups(before.items(), 5, 80, 100).items() if root == i} and 60 not in now
        else:
            assert set(now) == {i for i, t in before.items() if not hits(t, [(1, item)], 10)[1]} and 62 not in now
        assert name == "line_dedup" or all(now[i] == before[i] for i in now)
        seen = after
    enc, want = encoder(), []
    for r in seen.collect():
        ids = np.array([*enc.encode_ordinary(r["text"] or ""), 0], dtype="<u4")
        want += [(r["doc_id"], i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(piece_bounds(len(ids), CAPACITY))]
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(want)


def test_repeats_nulls_and_empty(spark, tmp_path):
    docs = fixtures.docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, None, "q"], ids=[1, 1, None, None, 4, 5])
    tables = {"labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([], "item_id long, text string")}
    for name in ("_h", "n_hit", "g", "n_lines", "h.x"):  # names that operators use inside
        docs = docs.withColumn(name, F.lit(7))
    big = 2**62 + 1
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 5, F.lit(big)).otherwise(F.col("doc_id"))).coalesce(1)
    got = corpus_pipeline.run(spark, fixtures.write(spark, tmp_path, documents=docs, **tables))
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([1, None, 4, big], key=str)
    assert corpus_pipeline.run(spark, fixtures.write(spark, tmp_path / "e", documents=docs.filter(F.lit(False)), **tables)).count() == 0
