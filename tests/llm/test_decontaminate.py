import hashlib
import random
import re

import pytest

from facetry.llm.decontaminate import decontaminate, op6_decontamination
from tests.llm import fixtures

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def brute(text, items, window):
    lower = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = lower(text), set(), set()
    for item, body in items:
        w = lower(body)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            part = w[i : i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(item)
    return len(words), sorted(hit), found


@pytest.mark.parametrize("window,block", [(3, 1 << 20), (3, 20), (10, 1 << 20)])
def test_against_brute_force(spark, window, block):
    rng = random.Random(window)
    vocab = ["a", "B", "é9", "c-d", "Ω", "x", "y.z"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(1, 6))) for i in range(12)] + [(100, None), (101, "..."), (3, "a B"), (102, "É É É É")]
    texts = [say(rng.randint(0, 40)) for _ in range(40)] + [None, "", "!!", "É É É É É", items[0][1].upper(), "a" * 100_000, say(5000)]
    bench = spark.createDataFrame(items, ITEMS)
    got = {r["doc_id"]: r for r in decontaminate(fixtures.docs(spark, texts), bench, window=window, block_bytes=block).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute(t, items, window)
        assert (got[i]["n_words"], got[i]["n_hit"]) == (n, len(hit)), (i, t)
        assert got[i]["items"] == sorted(map(str, found))
        covered = sum(len(WORD.findall(t.lower()[s["start"] : s["end"]])) for s in got[i]["spans"]) if t else 0
        assert covered == len(hit)


def test_query_nulls_and_empty_tables(spark, tmp_path):
    docs = fixtures.docs(spark, [None, "one Two three", "one Two three"], ids=[None, 1, 1])
    bench = spark.createDataFrame([(20, "two"), (3, "TWO three"), (None, "one")], ITEMS)
    got = op6_decontamination(spark, fixtures.write(spark, tmp_path, documents=docs, benchmark=bench)).collect()
    want = hashlib.sha256(b"20,3").hexdigest()
    assert sorted((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"] == want, r["contaminated"]) for r in got) == [(0, 0, 0, False, False), (3, 3, 2, True, True), (3, 3, 2, True, True)]
    clean = op6_decontamination(spark, fixtures.write(spark, tmp_path / "b", documents=docs, benchmark=bench.limit(0))).collect()
    assert not any(r["contaminated"] for r in clean) and len(clean) == 3
    assert op6_decontamination(spark, fixtures.write(spark, tmp_path / "e", documents=docs.limit(0), benchmark=bench)).count() == 0
