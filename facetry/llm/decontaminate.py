"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows.

Words are runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII. A window is ``window`` consecutive
words of an item; an item with fewer words is one window. Each text is normalised to ``" word word ... "`` and scanned once;
the end of a match tells which words were hit, and those words are mapped back to character offsets of the original text.

The automaton is made in each task from the benchmark's windows. A benchmark beyond ``AUTOMATON_BYTES`` is cut into
several automata that scan the same text one after the other, each within that size; the rest of the plan stays the same.

Defined results: null and word-less texts have no words and no hits; null and word-less items have no windows; items with
equal texts are all reported; a repeated item_id is reported once; null item_ids are left out of the item list but
their windows hit; an empty benchmark contaminates nothing; repeated documents are separate rows; other
columns pass through, but columns with the names of results are replaced by them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.llm.common import table

WINDOW = 10
AUTOMATON_BYTES = 32 << 20
BENCHMARK_BYTES = 256 << 20  # more than this is no benchmark: refuse instead of filling the driver

# every ASCII byte that is no word byte becomes a space, A-Z become a-z, bytes beyond ASCII stay
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same words in the original text


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows_of(text: str | None, window: int) -> list[bytes]:
    words = words_of(text)
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


def pattern_blocks(benchmark: DataFrame, window: int, block_bytes: int = AUTOMATON_BYTES) -> list[dict[str, tuple[str, ...]]]:
    """Windows with the items that hold them, in blocks of bounded size; the benchmark's own size is checked first."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BENCHMARK_BYTES:
        raise ValueError(f"the benchmark holds {size} bytes; split it into tables of at most {BENCHMARK_BYTES}")
    holders: dict[str, set[str]] = {}
    for item, text in items.toLocalIterator():
        for w in windows_of(text, window):
            holders.setdefault(w.decode("latin-1"), set()).update([] if item is None else [item])
    blocks: list[dict[str, tuple[str, ...]]] = [{}]
    room = block_bytes
    for w in sorted(holders):
        if room < len(w) and blocks[-1]:
            blocks.append({})
            room = block_bytes
        blocks[-1][w] = tuple(sorted(holders[w]))
        room -= len(w)
    return blocks


def automata(blocks: list[dict[str, tuple[str, ...]]]) -> list:
    import ahocorasick

    out = []
    for block in blocks:
        if block:
            a = ahocorasick.Automaton()
            for w, items in block.items():
                a.add_word(w, (len(w), items))
            a.make_automaton()
            out.append(a)
    return out


def scan(text: str | None, machines: list) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, the places of hit words, and the items found."""
    words = words_of(text)
    if not words:
        return 0, np.zeros(0, dtype=np.int64), set()
    line = b" " + b" ".join(words) + b" "
    line_text = line.decode("latin-1")
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    for a in machines:
        for end, (length, holders) in a.iter(line_text):
            found.append((end - length + 1, end))
            items.update(holders)
    if not found:
        return len(words), np.zeros(0, dtype=np.int64), items
    spaces = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 0x20)  # word i lies between spaces i and i + 1
    bounds = np.searchsorted(spaces, np.array(found))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, bounds[:, 0], 1)
    np.add.at(edge, bounds[:, 1], -1)
    return len(words), np.flatnonzero(np.cumsum(edge)[:-1] > 0), items


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets [start, end) of runs of hit words in the original text."""
    if not len(hit):
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    out: list[tuple[int, int]] = []
    last = -2
    for i in hit.tolist():
        if i == last + 1:
            out[-1] = (out[-1][0], at[i][1])
        else:
            out.append(at[i])
        last = i
    return out


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted item ids found) and ``spans`` of hit text."""
    blocks = pattern_blocks(benchmark, window, block_bytes)
    docs = docs.select(*[c for c in docs.columns if c not in FOUND.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata(blocks)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        for batch in batches:
            rows = []
            for t in batch.column(text).to_pylist():
                n, hit, items = scan(t, machines)
                rows.append((n, len(hit), sorted(items), [{"start": a, "end": b} for a, b in spans(t, hit)] if len(hit) else []))
            made = [pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *FOUND.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *FOUND.fields]))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


