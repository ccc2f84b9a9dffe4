import math
from collections import Counter

import pytest

from facetry.llm.licenses import LEAST, LICENCE_FILE, TEMPLATES, inherited, op10_licenses, scan, terms
from pyspark.sql import functions as F
from tests.llm import fixtures

FILES = [
    ("LICENSE", "Released under the MIT License."),
    ("a/COPYING.txt", TEMPLATES["GPL-3.0"][1]),
    ("a/b/x.py", "print(1)"),
    ("a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\ncode here"),
    ("ab/z.py", "nothing"),
    ("a/b/LICENSE", "no licence text at all"),
    ("d/LICENCE", "All rights reserved."),
    ("d/e/f/g/h.c", None),
    ("d/e/w.c", "the the the software is under of and"),
    ("top.py", ""),
    (None, "Licensed under CC BY-NC 4.0."),
    (None, "free text"),
    ("p/long.txt", "word " * 30_000 + "\n\n" + TEMPLATES["BSD-3-Clause"][1].replace("; ", ";\n").replace(", ", ",\n")),
]


def brute(texts):
    """TF-IDF with full term tables over lines and paragraphs."""
    forms = [(name, terms(t)) for name, ts in TEMPLATES.items() for t in ts]
    vocabulary = {t for _, f in forms for t in f}
    df, n = Counter(t for x in texts if x for t in set(terms(x))), len(texts)
    idf = lambda t: math.log((1 + n) / (1 + (df[t] if t in vocabulary else 1))) + 1
    vec = lambda ts: {t: k * idf(t) for t, k in Counter(ts).items()}
    dot = lambda a, b: sum(a[t] * b.get(t, 0) for t in a)
    out = []
    for text in texts:
        each = (text or "").split("\n")
        blocks = "\n".join("\n" if not terms(x) else x for x in each).split("\n\n")
        best = (0, None)
        for unit in [*each, *blocks]:
            u = vec(terms(unit))
            if len(vocabulary & set(u)) >= 3:
                for name, f in forms:
                    v = vec(f)
                    s = dot(u, v) / math.sqrt(dot(u, u) * dot(v, v))
                    if (-round(s, 9), name) < (-round(best[0], 9), best[1] or ""):
                        best = (s, name)
        out.append(best if best[0] >= LEAST else (None, None))
    return out


def test_scores_and_inheritance(spark):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(FILES)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in inherited(scan(df.repartition(4)), F.col("path").rlike(LICENCE_FILE)).collect()}
    for i, (score, name) in enumerate(brute([t for _, t in FILES])):
        assert (got[i]["score"] is None) == (score is None)
        if score is not None:
            assert got[i]["score"] == pytest.approx(score) and got[i]["licence"] == name and got[i]["source"] == "own"
    by = {FILES[i][0]: (r["licence"], r["source"], r["from_dir"]) for i, r in got.items() if FILES[i][0]}
    assert by["a/b/x.py"] == by["a/b/LICENSE"] == ("GPL-3.0", "inherited", "a")
    assert by["a/b/c/y.py"][:2] == ("Apache-2.0", "own")
    assert by["ab/z.py"] == by["top.py"] == ("MIT", "inherited", "")
    assert by["d/e/f/g/h.c"] == by["d/e/w.c"] == ("Proprietary", "inherited", "d")
    assert by["p/long.txt"][:2] == ("BSD-3-Clause", "own")
    assert (got[10]["licence"], got[11]["source"]) == ("CC-BY-NC-4.0", "none")


def test_query_nulls_repeats_and_empty(spark, tmp_path):
    texts = ["Released under the MIT License.\nbody", "plain", "plain", None, "x"]
    docs = fixtures.docs(spark, texts, ids=[1, 2, 2, None, 700], source=["s", "s", "s", None, "s"]).withColumnRenamed("n_chars", "path")
    got = op10_licenses(spark, fixtures.write(spark, tmp_path, documents=docs)).collect()
    assert sorted(((r["doc_id"], r["licence"], r["source"]) for r in got), key=str) == sorted([(1, "MIT", "own"), (2, "MIT", "inherited"), (2, "MIT", "inherited"), (None, None, "none"), (700, None, "none")], key=str)
    assert op10_licenses(spark, fixtures.write(spark, tmp_path / "e", documents=docs.limit(0))).count() == 0


NOTICES = [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nsome preamble"),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    (None, "Licensed under CC BY 3.0."),
    (None, "Licensed under the Foo License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", TEMPLATES["BSD-3-Clause"][1] + "\n\nRedistributions in binary form must reproduce the above copyright notice."),
    ("BSD-3-Clause", TEMPLATES["BSD-3-Clause"][1] + "\n\nRedistributions in binary form must reproduce the above copyright notice.\n\nNeither the name may be used to endorse products."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Some words about nothing much at all come before it here. Released under the MIT License. More words of the text follow on the very same line."),
    ("MPL-2.0", "Own words come first in here, quite a few. This Source Code Form is subject to the terms of\nthe Mozilla Public License, v. 2.0. Other words follow again here."),
]


def test_versions_variants_and_sentences(spark):
    texts = [t for _, t in NOTICES] + ["filler text"] * 200
    df = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in scan(df.repartition(4)).collect()}
    assert [got[i]["licence"] for i in range(len(NOTICES))] == [name for name, _ in NOTICES]
    assert got[0]["opens"] and not got[14]["opens"] and got[14]["line"] == 0


def test_query_inherits_from_directories_of_all_depths(spark, tmp_path):
    texts = {1: "Released under the MIT License.\nbody", 2: "plain", 3: "deep", 505: "Licensed under CC BY 4.0.\nbody", 1002: "plain", 5050: "All rights reserved.\nbody", 7: "other language"}
    docs = fixtures.docs(spark, list(texts.values()), ids=list(texts), lang=["en"] * 6 + ["de"])
    got = {r["doc_id"]: (r["licence"], r["source"], r["from_dir"]) for r in op10_licenses(spark, fixtures.write(spark, tmp_path, documents=docs)).collect()}
    assert got[2] == got[3] == ("MIT", "inherited", "s/en/0")
    assert got[1002] == ("CC-BY-4.0", "inherited", "s/en")
    assert got[7] == ("Proprietary", "inherited", "s")
    assert (got[1][:2], got[505][:2], got[5050][:2]) == (("MIT", "own"), ("CC-BY-4.0", "own"), ("Proprietary", "own"))
