"""Prefix trie against a dictionary of all prefixes, and its searches against plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import prefix_trie as trie
from tests.llm.fixtures import write

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    conv = defaultdict(list)
    for c, k, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        conv[c].append((role or "", text or ""))
    built = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple((conv[c - c % 5] if c - c % 5 in conv else [])[:h] + own[h:])
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(nodes[p]) if built[c] == p)
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, block=trie.BLOCK):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("x")).withColumn("turns", F.lit(1))
    made = trie.prefix_trie(trie.spliced(trie.turns_in_order(df)), block)
    assert made.columns == trie.RESULT
    return sorted(map(tuple, made.collect()), key=str)


def sample(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue  # a conversation that isn't there
        for k in range(rng.choice([1, 2, 2, 5, 9, 12])):
            # a third of all conversations opens alike, many go on alike
            text = "hot" if k == 0 and c % 3 == 0 else rng.choice(["a", "b", "é" * 3, None, ""])
            rows.append((c, k if rng.random() < 0.95 else None, rng.choice(["user", "user", "user", None]), text))
    return rows


@pytest.mark.parametrize("block", [2, 5, 16, 8_192])
def test_nodes_equal_a_dictionary_of_prefixes(spark, block):
    rows = sample(160)
    assert got(spark, rows, block) == brute(rows)


def test_many_ranges_give_the_same_nodes(spark, monkeypatch):
    monkeypatch.setattr(trie, "ROWS_PER_RANGE", 9)
    rows = sample(200, seed=2)
    assert got(spark, rows, 4) == brute(rows)


def test_copies_long_conversations_ties_and_nulls(spark):
    rows = [(c, k, "user", f"same {k}") for c in range(300) for k in range(10)]
    rows += [(1_000, k, "user", "long") for k in range(2_000)] + [(1_001, k, "assistant", "long") for k in range(2_001)]
    rows += [(None, 0, "user", "lost"), (2_000, None, None, None), (2_001, 0, "user", "x"), (2_001, 0, "user", "x"), (2_001, 0, "a", "y"), (-7, 0, "user", "minus")]
    want = [r for r in brute([r for r in rows if r[0] != -7])]
    assert got(spark, [r for r in rows if r[0] != -7], 64) == want
    assert got(spark, [(-7, 0, "user", "minus")])[0][3] == 1


def test_first_of_group_absent_and_turnless_conversations(spark):
    # 7 has h = 1 and its group's first (5) is absent: nothing is left of its single turn or its first one
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(40)}
    rows = [(c, 0, "user", "t") for c in range(40) if c % 5 and h[c]]
    want = brute(rows)
    assert got(spark, rows) == want == [(min(r[0] for r in rows), 0, None, len(rows), 0, 1, 0, want[0][7])]


def test_search_in_the_sparse_table_equals_loops():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64):
        values = rng.integers(0, 5, n)
        table = trie.SparseTable(values)
        at, least = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        for i, d, l, r in zip(at, least, table.leftmost(at, least), table.rightmost(at, least)):
            a = b = i
            while a > 0 and values[a] >= d:
                a -= 1
            while b + 1 < n and values[b + 1] >= d:
                b += 1
            assert (l, r) == (a, b)


def test_no_rows(spark, tmp_path):
    folder = write(spark, tmp_path, conversations=spark.createDataFrame([], SCHEMA))
    assert trie.op12_prefix_trie(spark, folder).collect() == []
