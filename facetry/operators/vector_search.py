"""Fingerprint search: threshold match and nearest-in-database, exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.functions.vector import as_double, vec_dist, vec_norm
from facetry.operators.scale import SEGMENT_ROWS, top_k, with_ordinals
from facetry.session import materialize

BROADCAST_BYTES = 64 << 20
SALT_TARGETS = 10_000
PART_ROWS = 8_192  # database rows that meet a block of targets where targets are many
PAIRS = 1 << 20  # distances of a block that is measured at once
BLOCK_ROWS = 1 << 10  # database rows of such a block where pairs are cut by distance
OUT_ROWS = 1 << 15  # pairs that leave a task at once


def _pivot_distance(desc: Column, pivot: list[float] | None) -> Column:
    """Distance to a fixed vector; the origin when none is given."""
    return vec_norm(desc) if pivot is None else vec_dist(desc, F.array(*[F.lit(float(v)) for v in pivot]))


def threshold_match(
    database: DataFrame,
    targets: DataFrame,
    max_dist: float,
    min_score: float | None = None,
    pivots: list[list[float] | None] = (None,),
) -> DataFrame:
    """All (target, database row) with vector distance < ``max_dist`` and row score > ``min_score``.

    ``database``: ``desc`` (array<double>), ``score``, keys. ``targets``: ``t_desc``, keys. Both keep their columns but for the vectors.
    The distances of both sides to a pivot differ by less than ``max_dist`` for every match. Targets are few sites: while they fit a
    broadcast the database never moves; blocks of its rows meet the targets whose distances to the pivots are near enough, in matrix
    products. A larger set is shuffled: bands of that width turn the distance test into an equi-join over two
    or three bands per pivot, with the database salted so that one band may hold most of it.
    """
    if min_score is not None:
        database = database.filter(F.col("score") > min_score)
    targets = materialize(targets.withColumn("_t", F.monotonically_increasing_id()))
    size = targets.agg(F.count("*").alias("n"), F.max(F.size("t_desc")).alias("dim")).first()
    bytes_ = (size["n"] or 0) * ((size["dim"] or 0) * 8 + 128)
    if bytes_ <= BROADCAST_BYTES:
        return _scan_within(database, targets, max_dist, pivots)
    targets = targets.drop("_t")
    bands = []
    for i, pivot in enumerate(pivots):
        reuse = pivot is None and "norm" in database.columns
        d = F.col("norm") if reuse else _pivot_distance(F.col("desc"), pivot)
        database = database.withColumn(f"_band{i}", F.floor(d / max_dist).cast("long"))
        t = F.floor(_pivot_distance(F.col("t_desc"), pivot) / max_dist).cast("long")
        # norms of the two sides may be rounded differently, so three bands
        targets = targets.withColumn(f"_band{i}", F.explode(F.sequence(t - 1, t + 1)))
        bands.append(f"_band{i}")
    salts = max(1, -(-size["n"] // SALT_TARGETS))
    salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    database = database.withColumn("_salt", F.pmod(F.xxhash64("desc"), F.lit(salts)).cast("int"))
    pairs = database.join(salted, [*bands, "_salt"]).drop("_salt")
    return pairs.withColumn("desc_dist", vec_dist("desc", "t_desc")).filter(F.col("desc_dist") < max_dist).drop(*bands, "desc", "t_desc")


def scan_distances(database: DataFrame, targets: DataFrame) -> DataFrame:
    """Distance of every database row to every target.

    Measuring all rows is what a full ranking asks for. Targets are a list of sites: while they fit
    a broadcast the database stays where it is, otherwise both sides meet in salted parts.
    """
    targets = materialize(targets)
    size = targets.agg(F.count("*").alias("n"), F.max(F.size("t_desc")).alias("dim")).first()
    small = (size["n"] or 0) * ((size["dim"] or 0) * 8 + 128) <= BROADCAST_BYTES
    parts = 1 if small else max(1, -(-size["n"] // SALT_TARGETS))
    scattered = database.withColumn("_scan", F.pmod(F.xxhash64("desc"), F.lit(parts)).cast("int"))
    everywhere = targets.withColumn("_scan", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    scanned = scattered.join(F.broadcast(everywhere) if small else everywhere, "_scan")
    keep = [c for c in database.columns if c != "desc"]
    return scanned.withColumn("desc_dist", vec_dist("desc", "t_desc")).select(*keep, *[c for c in targets.columns if c != "t_desc"], "desc_dist")


def _matrix(vectors, dim: int) -> np.ndarray:
    return np.concatenate(vectors).astype(np.float64).reshape(len(vectors), dim) if len(vectors) else np.zeros((0, dim))


def known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull())


def first_nearest(x: pa.Array, t: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of the nearest of a few vectors ``t`` to every vector of ``x``, ties by position, distances as :func:`vec_dist` adds.

    A missing distance (no vector, other lengths) comes back as -1 and goes first, as SQL sorts it; NaN goes last.
    """
    length = lambda v: pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    lx, lt = length(x), length(t)
    d = np.full((len(lx), len(lt)), -1.0)
    for n in np.intersect1d(lx[lx >= 0], lt[lt >= 0]):
        i, j = np.nonzero(lx == n)[0], np.nonzero(lt == n)[0]
        a, b = (v.take(pa.array(k)).flatten().to_numpy(zero_copy_only=False).reshape(len(k), n) for v, k in ((x, i), (t, j)))
        sq = np.zeros((len(i), len(j)))
        for c in range(n):
            gap = a[:, c, None] - b[:, c]
            sq += gap * gap
        d[np.ix_(i, j)] = np.sqrt(sq)
    last = np.isnan(d)
    best = np.where(last, np.inf, d).argmin(axis=1)
    best = np.where(last[np.arange(len(d)), best], last.argmin(axis=1), best)
    return best, d[np.arange(len(d)), best]


def _error(x: np.ndarray) -> float:
    """Share of two squared lengths by which the matrix product may miss the squared distance."""
    return 8 * (x.shape[1] + 4) * np.finfo(float).eps


def _exact(x: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the rows ``i`` of ``x`` and ``j`` of ``t``, term by term, as :func:`vec_dist` adds."""
    sq = np.zeros(len(i))
    for c in range(x.shape[1]):
        d = x[i, c] - t[j, c]
        sq += d * d
    return np.sqrt(sq)


def _within(x: np.ndarray, t: np.ndarray, max_dist: float, pivots: list[np.ndarray | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, target, distance) of all rows of ``x`` and ``t`` closer than ``max_dist``, block by block.

    Rows of a block are alike in their distance to the first pivot; only targets that every pivot leaves in reach meet them.
    """
    error = _error(x)
    far = lambda v: [np.sqrt(((v if p is None else v - p) ** 2).sum(axis=1)) for p in pivots]
    own, size, ways, seen = (x * x).sum(axis=1), (t * t).sum(axis=1), far(x), far(t)
    order = np.argsort(ways[0], kind="stable") if ways else np.arange(len(x))
    for a in range(0, len(x), BLOCK_ROWS):
        i0 = order[a : a + BLOCK_ROWS]
        near = np.ones(len(t), bool)
        for w, s in zip(ways, seen):  # what is not a number is left to the distance itself
            low, high = w[i0].min(), w[i0].max()
            slack = max_dist + error * (high + max_dist)
            near &= ~(s < low - slack) & ~(s > high + slack)
        js = np.nonzero(near)[0]
        for b in range(0, len(js), PAIRS // BLOCK_ROWS):
            j0 = js[b : b + PAIRS // BLOCK_ROWS]
            least = (own[i0, None] + size[j0]) * (1 - error) - 2.0 * (x[i0] @ t[j0].T)
            i, j = np.nonzero(~(least > max_dist * max_dist * (1 + error)))
            if len(i):
                i, j = i0[i], j0[j]
                d = _exact(x, t, i, j)
                keep = d < max_dist
                yield i[keep], j[keep], d[keep]


def _scan_within(database: DataFrame, targets: DataFrame, max_dist: float, pivots: list[list[float] | None]) -> DataFrame:
    """Matches of targets that fit a broadcast (numbered ``_t``); every task scans its rows where they are."""
    asked = targets.filter(known("t_desc")).select("_t", as_double("t_desc").alias("t_desc")).toPandas()
    dims = asked["t_desc"].map(len).to_numpy()
    own = {int(n): (asked["_t"].to_numpy()[dims == n], _matrix(asked["t_desc"].to_numpy()[dims == n], int(n))) for n in np.unique(dims)}
    at = [None if p is None else np.array(p, dtype=np.float64) for p in pivots]
    own = {n: v for n, v in own.items() if all(p is None or len(p) == n for p in at)}  # vectors of other lengths have no distance
    keep = [c for c in database.columns if c != "desc"]
    names = [*keep, "_t", "desc_dist"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.list_value_length(batch.column("desc"))
            for n, (ids, t) in own.items():
                part = batch.filter(pc.equal(length, n))
                x, others = part.column("desc").flatten().to_numpy(zero_copy_only=False).reshape(len(part), n), part.select(keep)
                for i, j, d in _within(x, t, max_dist, at):
                    for a in range(0, len(i), OUT_ROWS):
                        b = slice(a, a + OUT_ROWS)
                        yield pa.RecordBatch.from_arrays([*others.take(pa.array(i[b])).columns, pa.array(ids[j[b]]), pa.array(d[b])], names=names)

    kind = T.StructType([*database.select(*keep).schema, T.StructField("_t", T.LongType()), T.StructField("desc_dist", T.DoubleType())])
    found = database.filter(known("desc")).withColumn("desc", as_double("desc")).select(*keep, "desc").mapInArrow(scan, kind)
    asked_for = [c for c in targets.columns if c not in ("_t", "t_desc")]
    return found.join(F.broadcast(targets.drop("t_desc")), "_t").select(*keep, *asked_for, "desc_dist")


def _nearest_in(x: np.ndarray, t: np.ndarray, k: int, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, target, distance) of the ``k`` nearest rows of ``x`` to every row of ``t``, ties by the smaller row, block by block.

    A matrix product with its error bound only narrows the search; what is left is measured term by term.
    ``bound``: squared distance per target within which ``k`` rows were seen; rows beyond it are left out, and it is lowered here.
    """
    error = _error(x)
    own = (x * x).sum(axis=1)
    step = max(1, PAIRS // max(1, len(x)))
    for a in range(0, len(t), step):
        some = t[a : a + step]
        sizes = (some * some).sum(axis=1)[:, None] + own
        least = sizes * (1 - error) - 2.0 * (some @ x.T)
        if len(x) >= k:
            kth = np.partition(least + 2 * error * sizes, k - 1, axis=1)[:, k - 1]
            bound[a : a + step] = np.fmin(bound[a : a + step], kth)
        j, i = np.nonzero(~(least > bound[a : a + step, None]))
        d = _exact(x, some, i, j)
        order = np.lexsort((i, d, j))
        i, j, d = i[order], j[order], d[order]
        keep = np.arange(len(j)) - np.searchsorted(j, j) < k
        yield i[keep], a + j[keep], d[keep]


def rank_database(database: DataFrame, targets: DataFrame, target_keys: list[str], k: int, order_ids: list[str]) -> DataFrame:
    """Nearest ``k`` database rows per target, ties by ``order_ids``; rows without a vector as long as the targets' have no distance and no rank.

    All pairs are measured, as exactness asks without structure in the data, but block by block: no pair is kept, sorted or shuffled
    beyond the ``k`` per target of a batch. Targets that fit a broadcast (their size is counted) go to the
    rows; a larger set is cut into blocks that meet parts of the database.
    """
    t = materialize(targets.filter(known("t_desc")).withColumn("_t", F.monotonically_increasing_id()))
    size = t.agg(F.count("*").alias("n"), F.max(F.size("t_desc")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0
    keep = [c for c in database.columns if c != "desc"]
    rows = database.filter(known("desc") & (F.size("desc") == dim)).withColumn("desc", as_double("desc"))
    keys = t.drop("t_desc")
    order = [F.col("desc_dist"), *[F.col(c) for c in order_ids]]
    names = [*keep, *[c for c in targets.columns if c != "t_desc"], "desc_dist"]
    if n * (dim * 8 + 128) <= BROADCAST_BYTES:
        asked = t.select("_t", "t_desc").toPandas()
        ids, own = asked["_t"].to_numpy(), _matrix(asked["t_desc"].to_numpy(), dim)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bound = np.full(len(own), np.inf)
            for batch in batches:
                x, others = batch.column("desc").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim), batch.select(keep)
                for i, j, d in _nearest_in(x, own, k, bound):
                    yield pa.RecordBatch.from_arrays([*others.take(pa.array(i)).columns, pa.array(ids[j]), pa.array(d)], names=[*keep, "_t", "desc_dist"])

        kind = T.StructType([*rows.select(*keep).schema, T.StructField("_t", T.LongType()), T.StructField("desc_dist", T.DoubleType())])
        # rows of a batch stand in the order that breaks ties
        found = rows.sortWithinPartitions(*order_ids).select(*keep, "desc").mapInArrow(scan, kind)
        return top_k(found.join(F.broadcast(keys), "_t").select(*names), target_keys, order, k)

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, own = _matrix(left["desc"].to_numpy(), dim), _matrix(right["t_desc"].to_numpy(), dim)
        out = [(left["_row"].to_numpy()[i], right["_t"].to_numpy()[j], d) for i, j, d in _nearest_in(x, own, k, np.full(len(own), np.inf))] if len(x) else []
        return pd.DataFrame(dict(zip(("_row", "_t", "desc_dist"), map(np.concatenate, zip(*out)))) if out else {"_row": [], "_t": [], "desc_dist": []})

    # numbers in the order that breaks ties
    rows = materialize(rows.repartitionByRange(*order_ids).sortWithinPartitions(*order_ids).withColumn("_row", F.monotonically_increasing_id()))
    parts, blocks = max(1, -(-rows.count() // PART_ROWS)), -(-n // SALT_TARGETS)
    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.select("_row", "desc", dealt("_row", parts).alias("_part"), every(blocks).alias("_block"))
    right = t.select("_t", "t_desc", dealt("_t", blocks).alias("_block"), every(parts).alias("_part"))
    near = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInPandas(meet, "_row long, _t long, desc_dist double")
    return top_k(near.join(rows.select("_row", *keep), "_row").join(keys, "_t").select(*names), target_keys, order, k)


def partner_ranks(database: DataFrame, targets: DataFrame, partner: tuple[str, str], left_out: Column | None = None) -> DataFrame:
    """1 + number of rows outside the partner that are nearer to a target than the partner's nearest row; null where the partner has no row.

    ``partner``: the columns of database and targets that are equal for rows of a target's partner. ``left_out`` (over columns of both)
    names pairs that don't count. The partner's distance comes first, from an equi-join; then each task counts
    what is nearer, so one number per target and task is shuffled and no pair.
    """
    own, of = partner
    keys = [c for c in targets.columns if c != "t_desc"]
    asked = materialize(targets.withColumn("_t", F.monotonically_increasing_id()))
    counted = F.lit(True) if left_out is None else ~left_out
    meant = database.join(asked, F.col(own) == F.col(of)).filter(counted)
    best = materialize(meant.groupBy("_t").agg(F.min(vec_dist("desc", "t_desc")).alias("_best")))
    scanned = scan_distances(database, asked.join(best, "_t")).filter(counted & (F.col(own) != F.col(of)) & (F.col("desc_dist") < F.col("_best")))
    nearer = scanned.groupBy("_t").agg(F.count("*").alias("_n"))
    rank = F.when(F.col("_best").isNotNull(), F.coalesce("_n", F.lit(0)) + 1)
    return asked.join(best, "_t", "left").join(nearer, "_t", "left").select(*keys, rank.alias("rank"))


def match_lists(candidates: DataFrame, keys: list[str], per_row: int = 100_000, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Matches of a protein as aligned lists, ``per_row`` at a time (``part``): for output only."""
    m = with_ordinals(candidates.select(*keys, "vix", "desc_dist", "score"), keys, ["vix"], "_i", segment_rows)
    m = m.withColumn("part", F.floor(F.col("_i") / per_row))
    m = m.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("vix", "desc_dist", "score"))).alias("m"))
    return m.select(*keys, "part", F.col("m.vix").alias("vix_list"), F.col("m.desc_dist").alias("dist_list"), F.col("m.score").alias("score_list"))


def scan_counters(database: DataFrame) -> DataFrame:
    return database.agg(F.countDistinct("protein_id").alias("proteins"), F.count("*").alias("fragments"))
