import random
import re

import numpy as np
import pytest

from facetry.llm.near_dups import Shingler, components, near_duplicates, op5_near_dups
from tests.llm import fixtures

WORD = re.compile("[^\x20\x09-\x0d]+")


def sets(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    s = {i: sets(t, k) for i, t in rows}
    parent = {i: i for i in s}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(s)
    for x in ids:
        for y in ids:
            if x < y and s[x] and s[y] and den * len(s[x] & s[y]) >= num * len(s[x] | s[y]):
                parent[max(root(x), root(y))] = min(root(x), root(y))
    return {i: (len(s[i]), root(i)) for i in ids}


def texts(rng, n):
    vocab = [f"w{i}" for i in range(400)] + ["É", "THE", "the"]
    out = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = list(rng.choice([base, out[-1]]))
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(copy)
    return [rng.choice([" ", "\n", "\t "]).join(t) for t in out]


@pytest.mark.parametrize("k,num,seed,block", [(3, 85, 1, 400), (5, 80, 2, 3)])
def test_against_brute_force(spark, k, num, seed, block):
    rng = random.Random(seed)
    made = texts(rng, 40) + [None, "", " \n", "One", "one", "one two", "a b c", "x" * 50_000]
    rng.shuffle(made)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(fixtures.docs(spark, made), k=k, num=num, block=block).collect()}
    assert got == brute(list(enumerate(made)), k, num, 100)


@pytest.mark.parametrize("edits,block", [(1, 400), (2, 400), (2, 7)])
def test_family_whose_members_are_close_to_the_center_alone(spark, edits, block):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    made = []
    for i in range(40):
        copy = list(base)
        for e in range(edits):
            copy[rng.randrange(60)] = f"edit{i}-{e}"
        made.append(" ".join(copy))
    made.append(" ".join(base))  # the center comes last
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(fixtures.docs(spark, made), k=3, num=85, block=block).collect()}
    assert got == brute(list(enumerate(made)), 3, 85, 100)


def test_nulls_repeats_and_empty(spark, tmp_path):
    docs = fixtures.docs(spark, ["a b c d", "a b c d", "A b\nc d", None, "q r s", "q r s", ""], ids=[7, 3, None, None, None, None, 9]).withColumnRenamed("n_chars", "n")
    got = op5_near_dups(spark, fixtures.write(spark, tmp_path, documents=docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, 2, 3, False), (3, 2, 3, True), (None, 2, 3, False), (None, 0, None, True), (None, 1, None, True), (None, 1, None, True), (9, 0, 9, True)], key=str)
    assert op5_near_dups(spark, fixtures.write(spark, tmp_path / "e", documents=docs.limit(0))).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 90)] + [(5, 100)]
    got = dict(components(spark.createDataFrame(path, "a long, b long")).collect())
    assert got == {i: 5 for i in [*range(10, 90), *range(100, 161)]}


def test_shingle_hashes_are_those_of_the_words():
    s = Shingler(3)
    a, b = s("The cat SAT on"), s("the\tcat sat\n on ")
    assert (a == b).all() and len(a) == 2
    assert len(np.intersect1d(s("x the cat sat"), a)) == 1 and len(s("long " + "é" * 9000 + " z")) == 1
