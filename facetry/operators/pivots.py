"""Exact fingerprint search over a table of pivot distances.

Pivots are chosen from the data (farthest first over a bounded sample) and every row's distances to them are written once with the row.
By the triangle inequality a match at distance < r differs by less than r in its distance to every pivot, and lies in no cell (rows with the
same nearest pivot) whose own bounds exclude it. Only pairs that pass all bounds are measured, as matrix products
of blocks. The pivots decide how much is measured, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.operators.vector_search import BROADCAST_BYTES
from facetry.session import materialize

PIVOTS = 16
SAMPLE_ROWS = 8_192
ROWS, COLUMNS = 1_024, 1_024  # of a block that is measured at once
EXACT = 65_536  # pairs whose distance is taken at once
PART_ROWS = 8_192
SLACK = 1e-9  # distances of the two sides may be rounded differently


@dataclass
class PivotIndex:
    """``rows``: the database with ``row``, ``pivot_dists`` and ``cell``; ``near``, ``far``: smallest and largest distance of a cell's rows to its pivot."""

    rows: DataFrame
    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray


def choose_pivots(database: DataFrame, n: int = PIVOTS, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``n`` vectors far from each other, out of the ``sample_rows`` rows of smallest hash."""
    some = database.select("desc").filter(F.col("desc").isNotNull()).distinct().orderBy(F.xxhash64("desc")).limit(sample_rows).collect()
    x = np.array([r["desc"] for r in some], dtype=np.float64)
    if not len(x):
        return x.reshape(0, 0)
    chosen = [int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    reach = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(np.argmax(reach)))
        reach = np.minimum(reach, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(vectors.to_numpy()).astype(np.float64).reshape(len(vectors), dim) if len(vectors) else np.zeros((0, dim))


def _flat(vectors: pa.Array) -> np.ndarray:
    """Rows of equally long vectors as a matrix, without a Python object per row."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all rows of ``y``, by a product; good to about 1e-8 of the vectors' length."""
    sq = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=-1))


def build_index(database: DataFrame, n: int = PIVOTS, pivots: np.ndarray | None = None) -> PivotIndex:
    """Writes ``database`` (``desc``: array<double>, ``score``, keys) with its pivot distances, rows of a cell side by side."""
    pivots = choose_pivots(database, n) if pivots is None else np.asarray(pivots, dtype=np.float64)
    count = len(pivots)

    @F.pandas_udf("array<double>")
    def to_pivots(desc: pd.Series) -> pd.Series:
        x = _matrix(desc, pivots.shape[1])
        return pd.Series(list(np.stack([_exact(x, p) for p in pivots], axis=1)))

    rows = database.filter(F.col("desc").isNotNull()).withColumn("pivot_dists", to_pivots("desc") if count else F.array().cast("array<double>"))
    own = F.array_min("pivot_dists")
    rows = rows.withColumn("cell", (F.array_position("pivot_dists", own) - 1).cast("int") if count else F.lit(0))
    spread = F.xxhash64(*[c for c in database.columns if c != "desc"])
    rows = rows.repartitionByRange(F.col("cell"), own, spread).sortWithinPartitions("cell").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows)
    near, far = np.full(max(1, count), np.inf), np.zeros(max(1, count))
    for r in rows.groupBy("cell").agg(F.min(F.array_min("pivot_dists")).alias("a"), F.max(F.array_min("pivot_dists")).alias("b")).collect():  # a row per pivot
        near[r["cell"]], far[r["cell"]] = r["a"], r["b"]
    return PivotIndex(rows, pivots, near, far)


def visits(near: np.ndarray, far: np.ndarray, to_pivots: np.ndarray, max_dist: float) -> np.ndarray:
    """Which cells (columns) can hold a match of each target (rows)."""
    reach = max_dist + SLACK
    inside = (to_pivots - far < reach) & (near - to_pivots < reach)
    return inside & ((to_pivots - to_pivots.min(axis=1, keepdims=True)) / 2 < reach)


def _met(x: np.ndarray, xp: np.ndarray, t: np.ndarray, tp: np.ndarray, max_dist: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per block of rows ``x`` and targets ``t``: (row, target, distance) of its matches, and how many pairs had to be measured."""
    reach = max_dist + SLACK
    for a in range(0, len(x), ROWS):
        for b in range(0, len(t), COLUMNS):
            ok = np.ones((len(x[a : a + ROWS]), len(t[b : b + COLUMNS])), dtype=bool)
            for p in range(xp.shape[1]):
                ok &= np.abs(xp[a : a + ROWS, p, None] - tp[None, b : b + COLUMNS, p]) < reach
            rows, cols = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            if not len(rows):
                continue
            near = distances(x[a + rows], t[b + cols]) < max_dist + 1e-6
            i, j = np.nonzero(near & ok[np.ix_(rows, cols)])
            i, j = a + rows[i], b + cols[j]
            d = np.concatenate([np.empty(0), *[_exact(x[i[k : k + EXACT]], t[j[k : k + EXACT]]) for k in range(0, len(i), EXACT)]])
            keep = d < max_dist
            yield i[keep], j[keep], d[keep], int(ok.sum())


def _targets(targets: DataFrame) -> tuple[DataFrame, int, int]:
    """Written targets with ``_t``, their number and bytes."""
    t = materialize(targets.filter(F.col("t_desc").isNotNull()).withColumn("_t", F.monotonically_increasing_id()))
    size = t.agg(F.count("*").alias("n"), F.max(F.size("t_desc")).alias("dim")).first()
    return t, size["n"], size["n"] * ((size["dim"] or 0) * 8 + 128)


def pivot_match(index: PivotIndex, targets: DataFrame, max_dist: float, min_score: float | None = None) -> DataFrame:
    """All (target, database row) with distance < ``max_dist`` and score > ``min_score``: columns of both but the vectors, and ``desc_dist``.

    Targets that fit a broadcast (their size is counted) go to the rows. A larger set is cut into blocks that
    meet parts of at most about ``PART_ROWS`` rows of the cells which they visit.
    """
    t, n, size = _targets(targets)
    rows = index.rows if min_score is None else index.rows.filter(F.col("score") > min_score)
    keep = [c for c in rows.columns if c not in ("desc", "pivot_dists", "cell", "row")]
    keys = t.drop("t_desc")
    if not n or not len(index.pivots):
        return rows.limit(0).select(*keep).join(keys.drop("_t"), F.lit(True)).withColumn("desc_dist", F.lit(0.0))
    dim, pivots, near, far = index.pivots.shape[1], index.pivots, index.near, index.far
    if size <= BROADCAST_BYTES:
        some = t.select("_t", "t_desc").toPandas()
        ids, own = some["_t"].to_numpy(), _matrix(some["t_desc"], dim)
        own_p = np.stack([_exact(own, p) for p in pivots], axis=1)
        seen = visits(near, far, own_p, max_dist)

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, xp = (_flat(batch.column(c)) for c in ("desc", "pivot_dists"))
                cells, others = batch.column("cell").to_numpy(zero_copy_only=False), batch.select(keep)
                for c in np.unique(cells):
                    at, to = np.flatnonzero(cells == c), np.flatnonzero(seen[:, c])
                    # the matches of a block leave before the next one is measured
                    for i, j, d, _ in _met(x[at], xp[at], own[to], own_p[to], max_dist):
                        for k in range(0, len(i), EXACT):
                            some = slice(k, k + EXACT)
                            columns = others.take(pa.array(at[i[some]])).columns
                            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids[to[j[some]]]), pa.array(d[some])], names=[*keep, "_t", "desc_dist"])

        may = F.array(*[F.lit(bool(v)) for v in seen.any(axis=0)])
        kind = T.StructType([f for f in rows.select(*keep).schema] + [T.StructField("_t", T.LongType()), T.StructField("desc_dist", T.DoubleType())])
        found = rows.filter(F.element_at(may, F.col("cell") + 1)).select(*keep, "desc", "pivot_dists", "cell").mapInArrow(met, kind)
        return found.join(F.broadcast(keys), "_t").select(*keep, *keys.drop("_t").columns, "desc_dist")

    @F.pandas_udf("struct<dists:array<double>,cells:array<int>>")
    def visited(desc: pd.Series) -> pd.DataFrame:
        x = _matrix(desc, dim)
        xp = np.stack([_exact(x, p) for p in pivots], axis=1)
        return pd.DataFrame({"dists": list(xp), "cells": [np.flatnonzero(v).astype(np.int32) for v in visits(near, far, xp, max_dist)]})

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # at most PART_ROWS x COLUMNS pairs, kept as numbers only
        out = list(_met(_matrix(left["desc"], dim), _matrix(left["pivot_dists"], len(pivots)), _matrix(right["t_desc"], dim), _matrix(right["_p"], len(pivots)), max_dist)) if len(left) and len(right) else []
        pick = lambda k, ids=None: np.concatenate([ids[f[k]] if ids is not None else f[k] for f in out]) if out else []
        return pd.DataFrame({"row": pick(0, left["row"].to_numpy()), "_t": pick(1, right["_t"].to_numpy()), "desc_dist": pick(2)})

    sizes = materialize(rows.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")))
    asked = t.withColumn("_v", visited("t_desc")).withColumn("cell", F.explode("_v.cells")).withColumn("block", F.pmod(F.xxhash64("_t"), F.lit(-(-n // COLUMNS))).cast("int"))
    asked = materialize(asked.select("_t", "t_desc", F.col("_v.dists").alias("_p"), "cell", "block"))
    blocks = asked.select("cell", "block").distinct()
    left = rows.select("row", "desc", "pivot_dists", "cell").join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).join(blocks, "cell")
    left = left.select("row", "desc", "pivot_dists", *[(F.col(c) + 0).alias(c) for c in ("cell", "part", "block")])
    right = asked.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = ["cell", "part", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, "row long, _t long, desc_dist double")
    return found.join(rows.select("row", *keep), "row").join(keys, "_t").select(*keep, *keys.drop("_t").columns, "desc_dist")


def measured_share(index: PivotIndex, targets: DataFrame, max_dist: float) -> dict[str, float]:
    """Pairs of all rows and targets, the share in visited cells, the share measured after all bounds, and the share found (targets that fit a broadcast)."""
    t, n, _ = _targets(targets)
    own = _matrix(t.select("t_desc").toPandas()["t_desc"], index.pivots.shape[1])
    own_p = np.stack([_exact(own, p) for p in index.pivots], axis=1)
    seen = visits(index.near, index.far, own_p, max_dist)
    dim, width = index.pivots.shape

    def count(batches):
        for df in batches:
            x, xp, cells = _matrix(df["desc"], width), _matrix(df["pivot_dists"], dim), df["cell"].to_numpy()
            visited = measured = matched = 0
            for c in np.unique(cells):
                at, to = np.flatnonzero(cells == c), np.flatnonzero(seen[:, c])
                visited += len(at) * len(to)
                for i, _, _, m in _met(x[at], xp[at], own[to], own_p[to], max_dist):
                    measured, matched = measured + m, matched + len(i)
            yield pd.DataFrame({"pairs": [len(df) * n], "visited": [visited], "measured": [measured], "matched": [matched]})

    got = index.rows.select("desc", "pivot_dists", "cell").mapInPandas(count, "pairs long, visited long, measured long, matched long")
    got = got.agg(*[F.sum(c).alias(c) for c in ("pairs", "visited", "measured", "matched")]).first()
    return {"pairs": got["pairs"], **{c: got[c] / max(1, got["pairs"]) for c in ("visited", "measured", "matched")}}
