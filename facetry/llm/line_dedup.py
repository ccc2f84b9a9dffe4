"""Line dedup with log templates: lines that recur across documents, also with varying fields, are dropped.

The template tree has a fixed depth: a line's token count, then its leading ``DEPTH`` tokens, lead to a leaf. Within the leaf a line has a few
templates: the line itself with tokens that hold digits as wildcards, and (from ``LEAST_TOKENS`` tokens on) that line with every other token
behind the leading ones as wildcard (odd or even places), or with the first or second half of them. Two lines share
a template if they agree in all that is left; as the tree is fixed, the result does not depend on the order of lines, and any number of
tasks can build it at once.

A template recurs if the texts that hold it amount to at least ``MIN_DOCS`` independent ones, or fewer for long ones: ``MIN_DOCS`` times ``SHORT`` over the
number of its tokens without wildcards, rounded up, but 2 at least (from 50 such tokens on with the values below). Where in the text it stands and what its neighbours are does not
matter, so blocks of many lines go as single lines do. A text counts as 1/q: q is the number of documents that share the rarer lines of the text, up to a
``1/REST`` of its characters (each line in its most frequent template). A text whose other lines are its own counts in full; n copies of a text, exact or with small edits,
count as one text together, however many they are (finding copies is the task of near-duplicate detection), and cannot save a line that other texts hold too.
Texts that share over three quarters of their characters count as copies of each other.

Texts are known by a 64-bit hash in the counts. Defined results: a null text stays null; blank lines stay; an empty table gives no rows; repeated
rows get the same result; other columns pass through, but ``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import materialize, table

DEPTH = 2
LEAST_TOKENS = 8
MIN_DOCS = 10
SHORT = 10  # up to so many fixed tokens a template needs MIN_DOCS
REST = 4
ONE = 1 << 32  # a text in full, in whole numbers so that sums do not depend on the order
FLUSH = 100_000  # rows that a task holds before it hands them on
_DIGIT = re.compile("[0-9]")
_FIELD = re.compile(r"[^\s]*[0-9][^\s]*")
_ANY = "\x00"


def _hash(text: str, kind: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), kind)


def _forms(line: str) -> list[tuple[int, int]]:
    """Hashes of the templates of a line and their tokens without wildcards, the closest template first; none for a blank line."""
    t = (_FIELD.sub(_ANY, line) if _DIGIT.search(line) else line).split()
    if not t:
        return []
    n, fixed = len(t), [x != _ANY for x in t]
    out = [(_hash(" ".join(t), 0), sum(fixed))]
    if n >= LEAST_TOKENS:
        half = DEPTH + (n - DEPTH) // 2
        for kind, places in enumerate((slice(DEPTH, n, 2), slice(DEPTH + 1, n, 2), slice(DEPTH, half), slice(half, n)), 1):
            u = t.copy()
            u[places] = [_ANY] * len(range(*places.indices(n)))
            out.append((_hash(" ".join(u), kind), out[0][1] - sum(fixed[places])))
    return out


def templates(line: str) -> list[int]:
    return [g for g, _ in _forms(line)]


def _met(text: str | None) -> list[tuple[int, int, int, int, int]]:
    """(template, fixed tokens, line, characters of the line, 1 at the template's first place) for all different lines of a text."""
    lines: dict[int, tuple[list[tuple[int, int]], int]] = {}
    for line in text.split("\n") if text else ():
        own = _forms(line)
        if own:
            before = lines.get(own[0][0])
            lines[own[0][0]] = (own, len(line) + (before[1] if before else 0))
    seen: set[int] = set()
    out = []
    for i, (own, size) in enumerate(lines.values()):
        for g, fixed in own:
            out.append((g, fixed, i, size, int(g not in seen)))
            seen.add(g)
    return out


def _frame(found: list[tuple[int, list[tuple[int, int, int, int, int]]]]) -> pd.DataFrame:
    n = [len(f) for _, f in found]
    g, fixed, line, size, first = zip(*(x for _, f in found for x in f))
    total = [sum({i: s for _, _, i, s, _ in f}.values()) for _, f in found]
    return pd.DataFrame(
        {
            "g": np.array(g, np.uint64).view(np.int64),
            "h": np.repeat(np.array([h for h, _ in found], np.int64), n),
            "fixed": np.minimum(np.array(fixed, np.int64), 2**15 - 1).astype(np.int16),
            "line": np.array(line, np.int32),
            "size": np.array(size, np.int64),
            "first": np.array(first, np.int8),
            "total": np.repeat(np.array(total, np.int64), n),
        }
    )


def held_weights(met: DataFrame) -> DataFrame:
    """(h, g, fixed, w, docs) of each different text and template that is in two documents at least: documents with that text and what they count for."""
    often = materialize(met.groupBy("g").agg(F.sum("first").alias("n")).filter("n >= 2"))
    hits = met.join(often, "g").groupBy("h", "g", "line").agg(F.sum("first").alias("docs"), *[F.first(c).alias(c) for c in ("fixed", "size", "total", "n")])
    each = hits.repartition("h").groupBy("h", "line").agg(F.max("n").alias("n"), F.first("size").alias("size"), F.first("total").alias("total"), F.collect_list(F.struct("g", "fixed", "docs")).alias("gs"))
    # the lines of one text
    text = each.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("n", "size", "gs"))).alias("ls"), F.first("total").alias("total"), F.sum("size").alias("met"))
    start, more = "named_struct('chars', total - met, 'q', 1L)", "named_struct('chars', a.chars + x.size, 'q', x.n)"
    rarer = F.expr(f"aggregate(ls, {start}, (a, x) -> if(a.chars * {REST} >= total, a, {more})).q")
    flat = text.select("h", rarer.alias("q"), F.explode(F.flatten(F.col("ls.gs"))).alias("x"))
    return flat.select("h", "x.g", "x.fixed", "x.docs", (F.col("x.docs") * F.expr(f"{ONE} div q")).alias("w"))


def recurring(held: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Templates (g) that recur."""
    stats = held.groupBy("g").agg(F.sum("w").alias("w"), F.sum("docs").alias("docs"), F.max("fixed").cast("long").alias("fixed"))
    fewer = F.when(F.col("fixed") <= SHORT, min_docs).otherwise(F.greatest(F.ceil(min_docs * SHORT / F.col("fixed")), F.lit(min(2, min_docs))))
    return stats.filter(F.col("w") + F.col("docs") >= fewer * ONE).select("g")  # each document was rounded down by less than 1


def line_dedup(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines cut out of ``text``, and ``n_lines`` and ``n_dropped`` of each row."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found, size = [], 0
            for h, t in zip(df["h"].tolist(), df["text"]):
                rows = _met(t)
                if rows:
                    found.append((h, rows))
                    size += len(rows)
                if size >= FLUSH:
                    yield _frame(found)
                    found, size = [], 0
            if found:
                yield _frame(found)

    hashed = F.xxhash64(text)
    schema = "g long, h long, fixed short, line int, size long, first byte, total long"
    met = materialize(docs.select(hashed.alias("h"), F.col(text).alias("text")).mapInPandas(find, schema))
    held = materialize(held_weights(met))
    again = materialize(recurring(held, min_docs))
    cut = held.select("g", "h").join(again, "g").groupBy("h").agg(F.collect_set("g").alias("__cut"))  # at most the templates of one text

    @F.pandas_udf("text string, n_dropped long")
    def apply(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        out = []
        for t, gone in zip(texts, cuts):
            if t is None:
                out.append((None, 0))
                continue
            lines = t.split("\n")
            gone = {int(x) & (2**64 - 1) for x in gone}
            kept = [x for x in lines if gone.isdisjoint(templates(x))]
            out.append(("\n".join(kept), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_dropped"])

    made = docs.select(*names).withColumn("__h", hashed).join(cut.withColumnRenamed("h", "__h"), "__h", "left")
    touched = F.col("__cut").isNotNull()  # other texts do not travel to Python
    made = made.withColumn("__new", apply(F.when(touched, F.col(text)), F.col("__cut")))
    new_text = F.when(touched, F.col("__new.text")).otherwise(F.col(text)).alias(text)
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    n_dropped = F.when(touched, F.col("__new.n_dropped")).otherwise(0).cast("long").alias("n_dropped")
    return made.select(*[new_text if c == text else F.col(f"`{c}`") for c in names], n_lines.cast("long").alias("n_lines"), n_dropped)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
