"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

1. A pass over the whole texts counts in how many of them each template term occurs, so all weights come from all texts.
2. A second pass scores units: lines, paragraphs (runs of lines between blank ones, often the whole text) and their sentences that share at least ``MIN_SHARED``
   terms with the templates. Only templates count whose name, variant and version the unit states too (``agrees``): the GPL is not taken for the LGPL. A unit's score is the largest cosine of TF-IDF vectors to a template. Terms of no template weigh as if one text held them. The
   vocabulary is that of the templates, so the weights are a few hundred numbers. A text's own licence is that of its best unit at ``LEAST`` or more.
3. A licence file gives its licence to its directory (best score, then name). Directories, not files, are joined with all directories above them, the nearest one
   with a licence wins, and files without a licence of their own take it by a join on their directory.

Defined results: null, empty and blank texts have no licence of their own but inherit; a null path has no directory and inherits nothing; repeated
rows get equal results; ties go to the licence that sorts first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import filled, materialize, table, unfilled

MIN_SHARED = 3
LEAST = 0.7
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.\-_][^/]*)?$"


def _gnu(title: str, short: str, version: str) -> tuple[str, ...]:
    """Notices of the GNU licences, which differ in title and version."""
    terms_of = f"under the terms of the GNU {title} as published by the Free Software Foundation"
    either = f"either version {version} of the License, or (at your option) any later version."
    return (
        f"Licensed under the GNU {title}, version {version}.",
        f"Licensed under the {short} {version}.",
        f"This program is free software; you can redistribute it and/or modify it {terms_of}; {either}",
        f"This library is free software; you can redistribute it and/or modify it {terms_of}; {either}",
        f"This program is free software; you can redistribute it and/or modify it {terms_of}; version {version} of the License.",
    )


# fixed values: notices and short statements of common licences
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        *_gnu("General Public License", "GPL", "3"),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "GPL-2.0": (*_gnu("General Public License", "GPL", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "LGPL-3.0": (*_gnu("Lesser General Public License", "LGPL", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-2.1": (*_gnu("Lesser General Public License", "LGPL", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "AGPL-3.0": (*_gnu("Affero General Public License", "AGPL", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "Licensed under the Simplified BSD License.", "BSD 2-Clause License"),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "Proprietary": ("All rights reserved.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
_SENTENCE = re.compile(r"(?<=[.!?])(?<!\b[vV]\.)\s+")  # not behind "v." of a version
_BINARY = re.compile(r"binary\s+form\s+must\s+reproduce", re.I)
_ENDORSE = re.compile(r"\bendorse\b", re.I)
_TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


# terms that name a licence: a unit has to hold those of the template
_NAMES = frozenset(["apache", "mit", "isc", "bsd", "mozilla", "gnu", "gpl", "lgpl", "agpl", "lesser", "affero", "commons", "cc"])
_GNU_KINDS = frozenset(["lesser", "affero", "lgpl", "agpl"])
_CC_KINDS = {"nc": "nc", "noncommercial": "nc", "sa": "sa", "sharealike": "sa", "nd": "nd", "noderivatives": "nd", "noderivs": "nd"}


def _kinds(names: set[str], held: set[str]) -> set[str]:
    """Variants that a text states, of the licence family that ``names`` belong to."""
    if names & {"gnu", "gpl", "lgpl", "agpl"}:
        return held & _GNU_KINDS
    if names & {"cc", "commons"}:
        pairs = (({"non", "commercial"}, "nc"), ({"share", "alike"}, "sa"), ({"no", "derivatives"}, "nd"))
        return {k for t, k in _CC_KINDS.items() if t in held} | {k for both, k in pairs if both <= held}
    return set()


def _numbers(held: Iterable[str]) -> set[str]:
    return {t.removesuffix(".0") for t in held if t[0].isdigit()}


def _demands(name: str, form: Counter) -> tuple[set[str], set[str], set[str]]:
    """What a unit has to state to match a template: name terms, variants, version."""
    names = set(form) & _NAMES
    version = _numbers(terms(name)) if names else set()
    return names, _kinds(names, set(form)), version & _numbers(form)


_FORMS = [(name, Counter(terms(t))) for name, texts in TEMPLATES.items() for t in texts]
_DEMANDS = [_demands(name, form) for name, form in _FORMS]


def agrees(held: set[str], demands: tuple[set[str], set[str], set[str]], numbers: set[str]) -> bool:
    """Whether a unit with the terms ``held`` states the same licence, variant and version as a template."""
    names, kinds, version = demands
    return names <= held and version <= numbers and _kinds(names, held) == kinds


VOCABULARY = frozenset(t for _, form in _FORMS for t in form)


def units(text: str) -> Iterator[tuple[int, bool, Counter]]:
    """(line, whether the text opens with it, term counts) of lines, paragraphs and their sentences that share enough terms with the templates; line 0 is the first with words."""
    block: list[tuple[int, str, list[str]]] = []
    first = None
    # terms between blank lines form a paragraph; the last one is closed by a blank line that is put behind
    for i, line in enumerate([*text.split("\n"), ""]):
        t = terms(line)
        if t:
            first = i if first is None else first
            block.append((i, line, t))
            if len(VOCABULARY.intersection(t)) >= MIN_SHARED:
                yield i - first, i == first, Counter(t)
        elif block:
            at = block[0][0] - first
            own = Counter(y for _, _, x in block for y in x)
            if len(VOCABULARY.intersection(own)) >= MIN_SHARED:
                if len(block) > 1:
                    yield at, at == 0, own
                yield from _sentences(block, first)
            block = []


def _sentences(block: list[tuple[int, str, list[str]]], first: int) -> Iterator[tuple[int, bool, Counter]]:
    """Sentences of a paragraph, also over several lines; those that are the whole paragraph or a line are units already."""
    whole = "\n".join(x for _, x, _ in block)
    cuts = [0, *(m.end() for m in _SENTENCE.finditer(whole)), len(whole)]
    row, seen = 0, 0
    for a, b in zip(cuts, cuts[1:]):
        row, seen = row + whole.count("\n", seen, a), a
        t = terms(whole[a:b])
        if len(VOCABULARY.intersection(t)) >= MIN_SHARED and t != block[row][2]:
            line = block[row][0] - first
            yield line, line == 0 and not terms(whole[:a]), Counter(t)


def weights(df: dict[str, int], n: int) -> tuple[dict[str, float], float]:
    """IDF per template term and for all others."""
    idf = lambda k: math.log((1 + n) / (1 + k)) + 1
    return {t: idf(df.get(t, 0)) for t in VOCABULARY}, idf(1)


def _vectors(idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    out = []
    for name, form in _FORMS:
        v = {t: k * idf[t] for t, k in form.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append((name, {t: x / norm for t, x in v.items()}))
    return out


def best_match(counts: dict[str, int], idf: dict[str, float], other: float, vectors: list[tuple[str, dict[str, float]]]) -> tuple[float, str]:
    """Largest cosine and its licence."""
    v = {t: k * idf.get(t, other) for t, k in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    best = (0.0, "")
    held = set(counts)
    numbers = _numbers(held)
    for (name, w), demands in zip(vectors, _DEMANDS):
        if not agrees(held, demands, numbers):
            continue
        score = sum(x * v[t] for t, x in w.items() if t in v) / norm
        if (-round(score, 9), name) < (-round(best[0], 9), best[1]) and score > 0:
            best = (score, name)
    return best


def may_match(counts: Counter, idf: dict[str, float], other: float) -> bool:
    """False if the terms beyond the templates alone keep every cosine below ``LEAST``."""
    shared = sum((k * idf[t]) ** 2 for t, k in counts.items() if t in idf)
    rest = other * other * sum(k * k for t, k in counts.items() if t not in idf)
    return shared >= LEAST * LEAST * (shared + rest) * (1 - 1e-9)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, path, licence, score, line (of the best unit, 0 being the first with words) and whether the text opens with it, of each row of ``docs`` (doc_id, path, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = Counter(), 0
        for part in batches:
            for text in part["text"]:
                n += 1
                if text:
                    held.update(VOCABULARY.intersection(terms(text)))
        yield pd.DataFrame([*held.items(), ("", n)], columns=["term", "n"])

    totals = docs.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    held = {r["term"]: int(r["n"]) for r in totals.collect()}  # at most the templates' terms
    idf, other = weights(held, held.pop("", 0))
    vectors = _vectors(idf)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for doc, path, text in zip(part["doc_id"], part["path"], part["text"]):
                found = ((i, o, best_match(c, idf, other, vectors)) for i, o, c in units(text or "") if may_match(c, idf, other))
                best = min(((-round(x, 9), name, i, not o) for i, o, (x, name) in found), default=(0.0, None, None, True))
                hit = -best[0] >= LEAST
                name = best[1]
                # the clauses of both BSD licences begin alike; the third one is about endorsement
                if hit and name == "BSD-3-Clause" and _BINARY.search(text) and not _ENDORSE.search(text):
                    name = "BSD-2-Clause"
                rows.append((doc, path, name if hit else None, -best[0] if hit else None, best[2] if hit else None, hit and not best[3]))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "licence", "score", "line", "opens"]).astype({"doc_id": "Int64", "line": "Int64"})

    rows = docs.select(filled("doc_id").alias("doc_id"), "path", "text")
    made = rows.mapInPandas(score, "doc_id long, path string, licence string, score double, line int, opens boolean")
    return materialize(made.select(unfilled("doc_id"), *made.columns[1:]))


def _folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def inherited(scanned: DataFrame, is_licence_file: Column) -> DataFrame:
    """``scanned`` with ``licence`` filled from above, ``source`` (own, inherited or none) and ``from_dir``."""
    at = scanned.withColumn("dir", _folder(F.col("path")))
    giving = at.filter(is_licence_file & F.col("licence").isNotNull() & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct(-F.col("score"), "licence")).alias("b"))
    giving = giving.select(F.col("dir").alias("above"), F.col("b.licence").alias("given"))
    dirs = at.select("dir").filter("dir is not null").distinct()
    parts = F.split("dir", "/")
    # "a/b" lies below "a/b", "a" and "" (the root)
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above"), k.alias("depth")))
    up = F.array_distinct(F.when(F.col("dir") == "", F.array(F.struct(F.lit("").alias("above"), F.lit(0).alias("depth")))).otherwise(up))
    found = dirs.select("dir", F.explode(up).alias("u")).select("dir", "u.*").join(giving, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("g"))
    out = at.join(found, "dir", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("licence", "g.given").alias("licence"),
        "score",
        "line",
        F.when(own, F.lit("own")).when(F.col("g").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("source"),
        F.when(~own, F.col("g.above")).alias("from_dir"),
    )


def laid_out(place: Column, doc_id: Column, opens: Column) -> Column:
    """Path of a document of ``place`` (source, lang): files lie in source/lang/(id div 500), each fourth one a directory (id div 50) deeper;
    documents that open with a statement are licence files, most of them there, some in source/lang or in source."""
    number = lambda n: F.coalesce(F.expr(f"doc_id div {n}").cast("string"), F.lit("-"))
    source, lang, name = place[0], place[1], F.coalesce(doc_id.cast("string"), F.lit("-"))
    licence = F.concat(F.lit("LICENSE."), name)
    leaf = F.concat_ws("/", source, lang, number(500))
    return (
        F.when(opens & (F.pmod(doc_id, F.lit(50)) == 0), F.concat_ws("/", source, licence))
        .when(opens & (F.pmod(doc_id, F.lit(10)) == 5), F.concat_ws("/", source, lang, licence))
        .when(opens, F.concat_ws("/", leaf, licence))
        .when(F.pmod(doc_id, F.lit(4)) == 3, F.concat_ws("/", leaf, number(50), name))
        .otherwise(F.concat_ws("/", leaf, name))
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in directories of several depths; those whose best match is their opening line or sentence are licence files."""
    docs = table(spark, sf_dir, "documents")
    place = F.concat_ws("\x00", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    scanned = scan(docs.select("doc_id", place.alias("path"), "text"))
    path = laid_out(F.split("path", "\x00"), F.col("doc_id"), F.col("opens"))
    got = inherited(scanned.withColumn("path", path), F.col("path").rlike(LICENCE_FILE))
    return got.select("doc_id", "licence", F.round("score", 6).alias("score"), "source", "from_dir")
