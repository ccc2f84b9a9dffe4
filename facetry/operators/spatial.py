"""Spatial joins in three dimensions: balls, radius pairs, nearest neighbours.

Points are DataFrames with ``x, y, z`` doubles, an id, and optional ``on`` columns that have to
be equal on both sides (protein, pose, pair). Columns of the right side come back with ``n_``.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.functions.geometry import dist
from facetry.operators.scale import top_k
from facetry.session import materialize

XYZ = ("x", "y", "z")
LEAF_POINTS = 128
BLOCK_ROWS = 10_000
MAX_DEPTH = 24
STEP = 2
SAMPLE_POINTS = 1_000_000
SHARES = sorted({i / 16 for i in range(1, 16)} | {t for e in (2, 3, 4, 5) for t in (10.0**-e, 1 - 10.0**-e)})
ACCURACY = 100_000


def ball(points: DataFrame, center: tuple[float, float, float], radius: float) -> DataFrame:
    """Points closer than ``radius`` to one point; the box test reaches the file scan."""
    box = reduce(lambda a, b: a & b, [F.col(c).between(v - radius, v + radius) for c, v in zip(XYZ, center)])
    d = dist(*XYZ, *[F.lit(float(v)) for v in center])
    return points.filter(box).withColumn("dist", d).filter(F.col("dist") < radius)


def _cells(df: DataFrame, side: float) -> DataFrame:
    for c in XYZ:
        df = df.withColumn(f"_c{c}", F.floor(F.col(c) / F.lit(side)).cast("long"))
    return df


def _prefixed(df: DataFrame, on: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in on else F.col(c).alias(f"n_{c}") for c in df.columns])


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, on: list[str] = (), closed: bool = False, block: int = BLOCK_ROWS) -> DataFrame:
    """Every pair within ``radius`` (strict unless ``closed``): the pairs themselves are the result.

    Cells twice as wide as the radius turn the range test into an equi-join: a point of the right side is
    sent to the cells its box touches, two per axis. Crowded cells
    are cut into blocks on both sides, so one join key never stands for more than ``block`` x
    ``block`` pairs. Use :func:`nearest` where only existence, the minimum or a few neighbours are
    wanted.
    """
    on = list(on)
    key = [*on, "_cx", "_cy", "_cz"]
    side, reach = 2 * radius, radius * (1 + 1e-9)  # a little more, as the box is rounded in another way than the distance
    near = _prefixed(right, on)
    for c in XYZ:
        ends = [F.floor((F.col(f"n_{c}") + F.lit(r)) / F.lit(side)).cast("long") for r in (-reach, reach)]
        near = near.withColumn(f"_c{c}", F.explode(F.sequence(*ends)))
    cells = _cells(left, side)
    size = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    both = size(cells, "_nl").join(size(near, "_nr"), key)
    worst = both.agg(F.max("_nl").alias("l"), F.max("_nr").alias("r")).first()
    if max(worst["l"] or 0, worst["r"] or 0) > block:
        parts = lambda n: F.ceil(F.col(n) / block).cast("int")
        crowd = materialize(both.select(*key, parts("_nl").alias("_pl"), parts("_nr").alias("_pr")))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if not c.startswith("_")]), F.col(n)).cast("int")
        cells = cells.join(crowd, key).withColumn("_bl", mine(left, "_pl")).withColumn("_br", every("_pr")).drop("_pl", "_pr")
        near = near.join(crowd, key).withColumn("_br", mine(near, "_pr")).withColumn("_bl", every("_pl")).drop("_pl", "_pr")
        key = [*key, "_bl", "_br"]
    pairs = cells.join(near, key)
    d = dist(*XYZ, "n_x", "n_y", "n_z")
    hit = (F.col("dist") <= radius) if closed else (F.col("dist") < radius)
    return pairs.withColumn("dist", d).filter(hit).drop("_cx", "_cy", "_cz", "_bl", "_br")


def _spread(points: DataFrame) -> tuple[int, dict[str, Column]]:
    """Number of points, and per axis a column in [0, 1) that rises with the coordinate and deals the points about evenly.

    It runs straight between quantiles of the data (a bounded sketch), closer ones towards both ends, so that neither a far outlier nor a
    dense spot leaves most points in a few cells. Only the cut into cells depends on it, never a distance.
    """
    q = [F.percentile_approx(c, F.array(*[F.lit(x) for x in SHARES]), F.lit(ACCURACY)).alias(f"q_{c}") for c in XYZ]
    ext = points.agg(F.count("*").alias("n"), *q, *[f(c).alias(f"{f.__name__}_{c}") for c in XYZ for f in (F.min, F.max)]).first()
    out = {}
    for c in XYZ:
        low, high = ext[f"min_{c}"], ext[f"max_{c}"]
        if low is None or not low < high:
            out[c] = F.lit(0.0)
            continue
        at = {float(low): 0.0} | {float(v): p for v, p in zip(ext[f"q_{c}"], SHARES) if low < v < high} | {float(high): 1.0}
        knots = sorted(at.items())
        part = lambda a, b: F.least(F.greatest((F.col(c) - F.lit(a)) / F.lit(b - a), F.lit(0.0)), F.lit(1.0))
        out[c] = sum(part(a, b) * F.lit(pb - pa) for (a, pa), (b, pb) in zip(knots, knots[1:])) * F.lit(1 - 1e-9)
    return ext["n"], out


def _placed(df: DataFrame, spread: dict[str, Column]) -> DataFrame:
    return df.select("*", *[u.alias(f"_u{c}") for c, u in spread.items()])


def _code(level: int) -> list[Column]:
    """Cell of a placed point; halving steps, so a cell's parent is its number shifted to the right."""
    return [F.floor(F.col(f"_u{c}") * F.lit(float(1 << level))).cast("long").alias(f"_c{c}") for c in XYZ]


def _depth(points: DataFrame, on: list[str], n: int, spread: dict[str, Column], leaf: int) -> int:
    """Smallest octree depth at which no cell holds more than about ``leaf`` points (planning only)."""
    if n <= 8 * leaf:  # so few that testing all of them costs less than another level
        return STEP
    share = min(1.0, SAMPLE_POINTS / n)
    sample = points if share == 1.0 else points.filter(F.pmod(F.xxhash64(*XYZ), F.lit(1 << 30)) < int(share * (1 << 30)))
    levels = list(range(STEP, MAX_DEPTH + 1, STEP))
    per_level = [F.struct(F.lit(lv).alias("lv"), *_code(lv)) for lv in levels]
    counts = (
        _placed(sample, spread).select(*on, F.explode(F.array(*per_level)).alias("c"))
        .groupBy(*on, "c")
        .count()
        .groupBy("c.lv")
        .agg(F.max("count").alias("most"))
        .collect()  # one row per level
    )
    most = {r["lv"]: r["most"] / share for r in counts}
    for lv in levels:
        if most.get(lv, 0) <= leaf:
            return lv
    return MAX_DEPTH


def nearest(
    queries: DataFrame,
    targets: DataFrame,
    target_id: str,
    on: list[str] = (),
    k: int = 1,
    within: float | None = None,
    closed: bool = True,
    leaf: int = LEAF_POINTS,
    farthest: bool = False,
) -> DataFrame:
    """The ``k`` nearest targets of every query, exact, ties by ``target_id``.

    Adds ``n_<target_id>``, ``n_dist`` and ``n_rank``; queries with nothing within ``within`` are
    left out. A table of cells (count and true bounding box) is walked from coarse to fine; a cell
    survives only if it can still beat the best bound seen, so a cell that holds a large share of
    all points is split until its parts are small instead of being joined as a whole. Copies of a
    point are searched once. ``farthest`` (k = 1) walks the same table for the other end, with a first
    bound by the outermost points.
    """
    on = list(on)
    if farthest and (k != 1 or within is not None):
        raise ValueError("farthest supports k=1 without a bound")
    at = [*on, *XYZ]
    places = queries.select(*at).distinct()
    t = targets.select(*at, F.col(target_id).alias("n_id"))
    if k == 1:
        ids = t.groupBy(*at).agg(F.min("n_id").alias("n_id"))
    else:
        ids = top_k(t, at, [F.col("n_id")], k, "_copy").drop("_copy")
    ids = materialize(ids)  # read once per level below

    n, spread = _spread(ids)
    depth = _depth(ids.select(*at), on, n, spread, leaf)

    box = [f"{tag}_{c}" for c in XYZ for tag in ("lo", "hi")]
    cell = ["_lv", "_cx", "_cy", "_cz"]
    levels = list(range(STEP, depth + 1, STEP))
    bound = float("inf") if within is None else float(within)

    def interval(c) -> tuple[Column, Column]:
        """Least and greatest possible distance of a query to the points of a cell."""
        gap = lambda x: F.greatest(c[f"lo_{x}"] - F.col(x), F.col(x) - c[f"hi_{x}"], F.lit(0.0))
        far = lambda x: F.greatest(F.abs(c[f"lo_{x}"] - F.col(x)), F.abs(c[f"hi_{x}"] - F.col(x)))
        low, high = (F.sqrt(sum(F.pow(f(x), F.lit(2.0)) for x in XYZ)) for f in (gap, far))
        # for the farthest point distances count negatively, everything else stays
        return (-high, -low) if farthest else (low, high)

    # a cell with k points guarantees that the answer is no farther than its far end
    sure = lambda c: F.when(c["_n"] >= k, interval(c)[1]).otherwise(F.lit(float("inf")))

    def addresses(df: DataFrame) -> DataFrame:
        """Each point once per level, with the cell it falls into."""
        each = [F.struct(F.lit(lv).alias("_lv"), *_code(lv)) for lv in levels]
        return _placed(df, spread).withColumn("_a", F.explode(F.array(*each))).select(*df.columns, *[F.col(f"_a.{c}").alias(c) for c in cell])

    # tree of cells: count and true bounding box; a cell is only split while it is crowded
    ends = [f(c).alias(f"{tag}_{c}") for c in XYZ for f, tag in ((F.min, "lo"), (F.max, "hi"))]
    raw = addresses(ids.select(*at)).groupBy(*on, *cell).agg(F.count("*").alias("_n"), *ends)
    if len(levels) > 1:
        raw = materialize(raw)
        crowded = raw.filter((F.col("_n") > leaf) & (F.col("_lv") < depth)).select(*on, *cell)
        up = [(F.col("_lv") - STEP).alias("_lv"), *[F.shiftright(f"_c{c}", STEP).alias(f"_c{c}") for c in XYZ]]
        inner = crowded.withColumn("_inner", F.lit(True))
        below = raw.filter(F.col("_lv") > STEP).withColumn("_up", F.struct(*up))
        parents = crowded.select(*on, F.struct(*cell).alias("_up"))
        tree = raw.filter(F.col("_lv") == STEP).unionByName(below.join(parents, [*on, "_up"], "left_semi").drop("_up"))
        tree = materialize(tree.join(inner, [*on, *cell], "left").withColumn("_inner", F.coalesce("_inner", F.lit(False))))
        homes = addresses(ids).join(tree.filter("not _inner").select(*on, *cell), [*on, *cell])
        homes = materialize(homes.select(*on, *cell, *[F.col(c).alias(f"n_{c}") for c in XYZ], "n_id"))
    else:
        tree = raw.withColumn("_inner", F.lit(False))
        homes = addresses(ids).select(*on, *cell, *[F.col(c).alias(f"n_{c}") for c in XYZ], "n_id")

    away = dist(*XYZ, "n_x", "n_y", "n_z")
    if len(levels) > 1 and not farthest:
        # first bound: the cells a query lies in, then the points of its own smallest cell
        mine = addresses(places).join(tree, [*on, *cell])
        node = {name: F.col(name) for name in ("_n", *box)}
        seen = mine.groupBy(*at).agg(F.min(sure(node)).alias("_u0"), F.max(F.when(~F.col("_inner"), F.struct(*cell))).alias("_home"))
        seen = seen.select(*at, "_u0", *[F.col(f"_home.{c}").alias(c) for c in cell])
        seen = materialize(seen)
        own = seen.join(homes, [*on, *cell]).groupBy(*at)
        kth = F.min(away) if k == 1 else F.get(F.sort_array(F.collect_list(away)), F.lit(k - 1))  # one cell's points
        own = own.agg(kth.alias("_u1"))
        bounds = seen.select(*at, "_u0").join(own, at, "left").select(*at, F.least("_u0", "_u1").alias("_ub"))
        frontier = places.join(bounds, at, "left").withColumn("_ub", F.least(F.lit(bound), F.coalesce("_ub", F.lit(bound))))
    elif farthest:
        # first bound: the way to the outermost points, which lie near the answers
        ways = [w for w in product((-1, 0, 1), repeat=3) if any(w)]
        outer = [F.max_by(F.struct(*XYZ), sum(F.col(c) * v for c, v in zip(XYZ, w))) for w in ways]
        ends = materialize(ids.groupBy(*on).agg(F.array(*outer).alias("_ends")))
        way = F.array_max(F.transform("_ends", lambda p: dist(*XYZ, *[p[c] for c in XYZ])))
        frontier = (places.join(ends, on) if on else places.join(F.broadcast(ends))).select(*at, (-way).alias("_ub"))
    else:
        frontier = places.withColumn("_ub", F.lit(bound))

    # then down the tree: children out of reach are dropped, the best bound is shared per query
    first = tree.filter(F.col("_lv") == STEP).select(*on, *cell, "_n", *box)  # at most 4 x 4 x 4 per tree
    if on:
        frontier = frontier.join(first, on)
    else:
        kind = T.ArrayType(T.StructType([f for f in first.schema]))
        text = json.dumps([r.asDict() for r in first.collect()])
        frontier = frontier.withColumn("_k", F.explode(F.from_json(F.lit(text), kind))).select(*at, "_ub", "_k.*")

    def in_reach(df: DataFrame) -> DataFrame:
        node = {name: F.col(name) for name in ("_n", *box)}
        low, inf = interval(node)[0], F.lit(float("inf"))
        limit = F.col("_ub") + F.abs("_ub") * 1e-9 + 1e-9
        # rows without a node are smallest cells kept from an earlier level
        df = df.withColumn("_low", F.coalesce(low, -inf)).filter(F.col("_low") <= limit)
        df = df.withColumn("_ub", F.least("_ub", F.min(sure(node)).over(Window.partitionBy(*at))))
        return df.filter(F.col("_low") <= limit).select(*at, "_ub", *cell)

    frontier = in_reach(frontier)
    for level in levels[:-1]:
        frontier = materialize(frontier)
        up = [F.lit(level).alias("_lv"), *[F.shiftright(f"_c{c}", STEP).alias(f"_c{c}") for c in XYZ]]
        kids = tree.filter(F.col("_lv") == level + STEP).select(*on, *up, F.struct(*cell).alias("_kid"), "_n", *box)
        grown = frontier.join(kids, [*on, *cell], "left").withColumn("_kid", F.coalesce("_kid", F.struct(*cell)))
        grown = grown.select(*at, "_ub", "_n", *box, *[F.col(f"_kid.{c}").alias(c) for c in cell])
        frontier = in_reach(grown)

    hits = frontier.join(homes, [*on, *cell]).withColumn("n_dist", away)
    if within is not None:
        hits = hits.filter((F.col("n_dist") <= within) if closed else (F.col("n_dist") < within))
    if k == 1:
        sign = -1 if farthest else 1
        best = hits.groupBy(*at).agg(F.min_by(F.struct("n_dist", "n_id"), F.struct(F.col("n_dist") * sign, F.col("n_id"))).alias("b"))
        best = best.select(*at, F.col("b.n_id").alias("n_id"), F.col("b.n_dist").alias("n_dist"), F.lit(1).alias("n_rank"))
    else:
        best = top_k(hits, at, [F.col("n_dist"), F.col("n_id")], k, "n_rank").select(*at, "n_id", "n_dist", "n_rank")
    return queries.join(best, at).withColumnRenamed("n_id", f"n_{target_id}")


def exists_within(queries: DataFrame, targets: DataFrame, target_id: str, radius: float, on: list[str] = (), closed: bool = True) -> DataFrame:
    """Queries that have at least one target within ``radius``."""
    return nearest(queries, targets, target_id, on, 1, radius, closed).drop(f"n_{target_id}", "n_dist", "n_rank")


def argmin_to_point(points: DataFrame, center: tuple[float, float, float], point_id: str) -> DataFrame:
    """The one point closest to a location, first id on ties."""
    d = dist(*XYZ, *[F.lit(float(v)) for v in center])
    return points.agg(F.min(F.struct(d.alias("dist"), F.col(point_id).alias(point_id))).alias("b")).select(f"b.{point_id}", "b.dist")
