"""Approximate nearest neighbours by inner product: a forest of hash prefixes.

Each tree gives a vector a long string of sign bits of random projections; a tree is the sorted array of those strings. A query descends
each tree to the entries that share its longest prefixes, then all trees ascend together, one bit less at a time.

1. Equal vectors form a class; ids come back at the end (only the ``k + 1`` smallest ids of a class can be among the ``k`` nearest).
2. Descent: in ``PROBE_TREES`` trees the ``PROBE`` entries around the query's place in the sorted array, i.e. its longest matches, are
   scored. The k-th best score so far bounds the true one from below.
3. Ascent: that score tells how long a prefix an entry at least as near shares with the query. The trees ascend together to the longest
   length at which such an entry is missed in all trees with a chance of at most ``MISS``, and every entry with that prefix is scored:
   no number of candidates is fixed, so dense regions stay high in the trees and spread-out data is searched widely.

Trees are cut into arrays by their first bits and, where many entries share them (copies with noise), by hash into parts of about
``ARRAY_ROWS``; queries visit every part that they need. Only the best of each visit leave a task. Projections act on vectors divided by
their length; for vectors of different lengths an entry's chance is reckoned at the largest length, which only widens the search.

Defined results: vectors that are null, zero, of another dimension than most, or hold null or non-finite numbers take no part; null ids take no
part; rows with equal id and vector count once; an id with several vectors has several candidates; ties go to the smaller id; fewer candidates
give fewer rows; an empty table gives none; other columns are ignored. Recall is measured in the tests against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.llm.common import materialize, table

TREES = 24
BITS = 32
PROBE_TREES = 6
PROBE = 256
MISS = 0.06
ARRAY_ROWS = 20_000
SEED = 11


def planes(dim: int, trees: int = TREES) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(trees, dim, BITS))


def _read(vectors: pd.Series, dim: int) -> np.ndarray:
    raw = b"".join(vectors)
    kind = "<f4" if len(raw) == 4 * dim * len(vectors) else "<f8"
    return np.frombuffer(raw, dtype=kind).reshape(len(vectors), dim).astype(np.float64)


def _strings(x: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Sign bits as a number, the first plane being the highest bit."""
    bits = (x @ plane > 0).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, float]:
    """(id, class, vector, norm) of the rows that take part, once each; their dimension and the largest length. ``vector`` holds the numbers as bytes."""
    width = "float" if dict(df.dtypes)[vector_col] == "array<float>" else "double"
    v = F.col(vector_col).cast(f"array<{width}>")
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0).cast(width)).alias("v")).filter(F.col("id").isNotNull() & ok)
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = shape["dim"] if shape else 0

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = [np.asarray(v, dtype="<f4" if width == "float" else "<f8") for v in part["v"]]
            yield pd.DataFrame({"id": part["id"], "vector": [y.tobytes() for y in x], "norm": [float(np.linalg.norm(y.astype(np.float64))) for y in x]})

    packed = rows.filter(F.size("v") == dim).mapInPandas(pack, "id long, vector binary, norm double").distinct()
    packed = materialize(packed.select("id", F.xxhash64("vector").alias("class"), "vector", "norm"))
    return packed, dim, packed.agg(F.max("norm")).first()[0] or 0.0


def _placed(vectors: DataFrame, dim: int, trees: range, route: int, keep: list[str]) -> DataFrame:
    """Each vector once per tree with its string and the array (first ``route`` bits) that holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plane = planes(dim)
        for df in batches:
            if not len(df):
                continue
            x = _read(df["vector"], dim)
            for t in trees:
                s = _strings(x, plane[t])
                yield df[keep].assign(tree=t, array=s >> (BITS - route), string=s)

    types = dict(vectors.dtypes)
    return vectors.select(*keep).mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", tree int, array long, string long")


def _top(queries: np.ndarray, entries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, entries and scores of the best ``k`` entries of each query, smaller ``ids`` first among equal scores."""
    score = queries @ entries.T
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] > k else np.full(len(score), -np.inf)
    row, at = np.nonzero(score >= least[:, None])
    value = score[row, at]
    order = np.lexsort((ids[at], -value, row))
    row, at, value = row[order], at[order], value[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], at[keep], value[keep]


FOUND = "query long, class long, id long, score double"


def _frame(q: list, c: list, i: list, s: list) -> pd.DataFrame:
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, dtype=kind)
    return pd.DataFrame({"query": cat(q, np.int64), "class": cat(c, np.int64), "id": cat(i, np.int64), "score": cat(s, np.float64)})


def _sorted(entries: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings in order, classes, their smallest ids and vectors."""
    order = np.argsort(entries["string"].to_numpy(), kind="stable")
    return entries["string"].to_numpy()[order], entries["class"].to_numpy()[order], entries["id"].to_numpy()[order], _read(entries["vector"], dim)[order]


def _descend(dim: int, k: int):
    """Scores the entries whose strings share the longest prefixes with each query (its neighbours in the sorted array)."""

    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries):
            return _frame([], [], [], [])
        strings, classes, ids, x = _sorted(entries, dim)
        q, c, d, s = [], [], [], []
        for query, vector, string in zip(queries["class"], _read(queries["vector"], dim), queries["string"]):
            at = int(np.searchsorted(strings, string))
            lo, hi = max(0, at - PROBE), min(len(strings), at + PROBE)
            common = strings[lo:hi] ^ string
            near = lo + (np.argpartition(common, PROBE - 1)[:PROBE] if len(common) > PROBE else np.arange(len(common)))
            score = x[near] @ vector
            best = np.lexsort((ids[near], -score))[: k + 1]
            q.append(np.full(len(best), query)), c.append(classes[near][best]), d.append(ids[near][best]), s.append(score[best])
        return _frame(q, c, d, s)

    return run


def _ascend(dim: int, k: int):
    """Scores every entry that shares the query's prefix of its own length, query groups with one prefix at once."""

    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(queries):
            return _frame([], [], [], [])
        strings, classes, ids, x = _sorted(entries, dim)
        q, c, d, s = [], [], [], []
        for (length, prefix), g in queries.assign(prefix=queries["string"].to_numpy() >> (BITS - queries["length"].to_numpy())).groupby(["length", "prefix"]):
            lo, hi = np.searchsorted(strings, [prefix << (BITS - length), (prefix + 1) << (BITS - length)])
            for a in range(lo, hi, 8192):
                b = min(hi, a + 8192)
                for i in range(0, len(g), 256):
                    part = g.iloc[i : i + 256]
                    row, best, score = _top(_read(part["vector"], dim), x[a:b], ids[a:b], k + 1)
                    q.append(part["class"].to_numpy()[row]), c.append(classes[a:b][best]), d.append(ids[a:b][best]), s.append(score)
        out = _frame(q, c, d, s)  # of several steps the best remain
        return out.sort_values(["score", "id"], ascending=[False, True]).groupby("query").head(k + 1) if len(out) else out

    return run


def _visits(entries: DataFrame, queries: DataFrame, array_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cuts full arrays into parts by hash and sends each query to all parts of its array."""
    sizes = entries.groupBy("tree", "array").agg(F.ceil(F.count(F.lit(1)) / array_rows).cast("long").alias("parts"))
    entries = entries.join(sizes, ["tree", "array"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))).drop("parts")
    queries = queries.join(sizes, ["tree", "array"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return entries, queries, ["tree", "array", "part"]


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k + 1`` classes of each query; a class stands in the order by its smallest id."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    once = found.groupBy("query", "class", "id").agg(F.max("score").alias("score"))
    return once.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1).drop("r")


def nearest(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", array_rows: int = ARRAY_ROWS, miss: float = MISS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found per query; ``is_query`` is a condition on ``id``."""
    packed, dim, longest = usable(rows, id_col, vector_col)
    if not dim:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_id = Window.partitionBy("class", "vector").orderBy("id")
    few = packed.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    made = materialize(few.groupBy("class", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("id")))
    asked = packed.filter(is_query(F.col("id"))).select("id", "class", "vector", "norm")
    wanted = materialize(asked.select("class", "vector", "norm").distinct())
    route = max(0, min(BITS - 1, math.ceil(math.log2(max(1, made.count() / array_rows)))))

    probe = range(PROBE_TREES)
    entries, queries, at = _visits(_placed(made, dim, probe, route, ["class", "id", "vector"]), _placed(wanted, dim, probe, route, ["class", "vector"]), array_rows)
    first = queries.groupBy(*at).cogroup(entries.groupBy(*at)).applyInPandas(_descend(dim, k), FOUND)
    first = materialize(_best(first, k))
    kth = first.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("got"))
    known = wanted.join(kth.withColumnRenamed("query", "class"), "class", "left")
    # chance that an entry at this angle agrees in a bit; length l is short enough if (1 - p ** l) ** TREES <= miss
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least") / (F.col("norm") * longest)))
    agree = 1 - F.acos(cosine) / math.pi
    length = F.floor(F.log(F.lit(1 - miss ** (1 / TREES))) / F.log(agree))
    length = F.when(F.col("got") <= k, F.lit(0)).when(agree >= 1, F.lit(BITS)).when(agree <= 0, F.lit(0)).otherwise(F.least(F.lit(BITS), length))
    known = known.select("class", "vector", F.coalesce(length, F.lit(0)).cast("int").alias("length"))

    every = range(TREES)
    searches = _placed(known, dim, every, route, ["class", "vector", "length"])
    if route:  # a prefix shorter than the arrays' own leads to all arrays below it
        below = F.expr(f"shiftleft(1L, greatest(0, {route} - length)) - 1")
        start = F.expr(f"shiftleft(shiftright(string, {BITS} - least(length, {route})), greatest(0, {route} - length))")
        searches = searches.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), below))).withColumn("array", start + F.col("_i")).drop("_i")
    entries, queries, at = _visits(_placed(made, dim, every, route, ["class", "id", "vector"]), searches, array_rows)
    more = queries.groupBy(*at).cogroup(entries.groupBy(*at)).applyInPandas(_ascend(dim, k), FOUND)
    best = materialize(_best(first.unionByName(more), k))

    out = best.join(made.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    out = out.join(asked.select(F.col("class").alias("query"), F.col("id").alias("query_id")), "query").filter("vec_id != query_id")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
