"""Spelling variants against deletion neighbourhoods, and the gram bound against every single edit."""

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from facetry.llm import spelling
from facetry.llm.spelling import class_longest, decomposed, op13_spelling, probes, variants, words
from tests.llm.fixtures import docs, write


def counted(rows):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                c[w] += 1
    return {w: n for w, n in c.items() if n >= 5}


def brute(count):
    by, near = defaultdict(set), defaultdict(set)
    for w in count:
        by[w].add(w)
        for k in range(len(w)):
            by[w[:k] + w[k + 1 :]].add(w)
    for group in by.values():
        for a in group:
            for b in group:
                same = sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))
                if a != b and same:
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w, n in count.items():
        if near[w]:
            f = min(near[w], key=lambda x: (-count[x], x))
            if count[f] >= 5 * n:
                form[w] = f
    out = []
    for w, n in count.items():
        r = w
        while r in form:
            r = form[r]
        out.append((w, form.get(w), r, n, len(near[w]), count[form[w]] if w in form else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def vocabulary(n=1_500, seed=3, letters="abcdé"):
    rng, out = random.Random(seed), {}
    while len(out) < n:
        w = rng.choice(["abcabc", "dddddd", "abéabé", "", ""]) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))
        if len(w) >= 6:
            out[w] = rng.choice([5, 6, 7, 25, 30, 200, 1_000, 5_000])
    out["z" * 300] = 9
    out["z" * 301] = 50
    out["z" * 150 + "y" + "z" * 149] = 9
    return out


def frame(spark, count):
    return spark.createDataFrame(list(count.items()), "word string, n long")


def test_dense_vocabulary_equals_deletion_neighbourhoods(spark):
    count = vocabulary()
    want = brute(count)
    assert sum(r[4] for r in want) > 2_000 and any(r[2] != r[1] and r[1] for r in want)
    assert rows_of(variants(frame(spark, count))) == want


def test_long_lists_are_cut_into_parts(spark):
    count = vocabulary(600, seed=8)
    assert rows_of(variants(frame(spark, count), longest_list=5)) == brute(count)


def test_a_bounded_dictionary_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FREQUENT", 40)
    count = vocabulary(500, seed=9)
    assert len(spelling.frequent_grams(frame(spark, count))) <= 40
    assert rows_of(variants(frame(spark, count))) == brute(count)


def test_every_edit_leaves_a_gram_of_the_probe():
    rng = random.Random(6)
    for _ in range(60):
        base = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 13))) for _ in range(12)]
        grams = Counter(w[p : p + n] for w in base for n in range(2, 6) for p in range(len(w) - n + 1))
        frequent = {g: n for g, n in grams.items() if n > 3 and all(grams[g[:k]] > 3 for k in range(2, len(g)))}
        for w in base:
            mine = probes(w, frequent)
            longest = class_longest(len(w))
            for other in {w[:i] + x + w[j:] for i in range(len(w) + 1) for x in ("a", "b", "c") for j in (i, i + 1) if j <= len(w)} - {w}:
                theirs = {(p - d, other[p:e]) for p, e, _ in decomposed(other, frequent, longest) for d in range(len(other) - len(w) + 1)}
                assert theirs & set(mine)


def test_texts_equal_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(op13_spelling(spark, sf)) == brute(counted([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]))


def test_nulls_repeats_slips_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    text = "HOUSES houses ÉCLAIR éclair houzes×house÷ short " + "Wörter " * 3
    texts = [None, "", "1234 ...", *[text] * 400, "x" * 200_000]
    ids = [1, 2, 3, *range(10, 408), None, None, 9]
    df = docs(spark, texts, ids=ids).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    count = counted(list(zip(ids, texts)))
    assert dict(map(tuple, words(df).collect())) == count
    assert any(len(w) == 6 and w not in ("houses", "éclair", "Wörter") for w in count)
    assert rows_of(variants(words(df))) == brute(count)


def test_no_rows(spark, tmp_path):
    folder = write(spark, tmp_path, documents=docs(spark, []))
    assert op13_spelling(spark, folder).collect() == []
