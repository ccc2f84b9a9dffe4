"""Order-dependent operators that never gather a whole group in one task.

A group may hold a third of all rows, so a window over ``partitionBy(key)`` is not
enough. The helpers here cut the order axis into segments of similar size first and
add the totals of earlier segments afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.session import materialize

SEGMENT_ROWS = 2_000_000
BROADCAST_GROUPS = 10_000


def large(df: DataFrame) -> DataFrame:
    """Marks a side of a join that grows with the input: both sides are shuffled.

    Left alone, Spark goes by the size of compressed files, takes millions of short rows for few and sends them through the driver.
    """
    return df.hint("merge")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Inclusive running sums per key in ``order``; each value is exact whatever the key's size."""
    base = df
    for name, expr in sums.items():
        base = base.withColumn(f"_in_{name}", expr)
    inner = [f"_in_{name}" for name in sums]
    segments = max(1, -(-df.count() // segment_rows))
    if segments == 1:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        for name in sums:
            base = base.withColumn(name, F.sum(f"_in_{name}").over(w))
        return base.drop(*inner)

    # runs of the real order, whatever its types; written once, so every branch sees the same cut
    base = materialize(base.repartitionByRange(segments, *keys, *order).withColumn("_seg", F.spark_partition_id()))
    local = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = base.groupBy(*keys, "_seg").agg(*[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_seg").alias("_k_seg"),
        *[F.coalesce(F.sum(f"_tot_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    out = base
    for name in sums:
        out = out.withColumn(name, F.sum(f"_in_{name}").over(local))
    match = F.col("_seg") == F.col("_k_seg")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = out.join(offsets, match)
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"_off_{name}"))
    return out.drop("_seg", "_k_seg", *inner, *[f"_k_{k}" for k in keys], *[f"_off_{n}" for n in sums])


def with_ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "pos", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """0-based rank of each row within its key; ``order`` has to be total."""
    out = running(df, keys, order, {name: F.lit(1).cast("long")}, segment_rows)
    return out.withColumn(name, F.col(name) - 1)


def blocked(df: DataFrame, keys: list[str], pos: str, before: int, after: int, block_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, list[str]]:
    """Cut numbered rows into equal blocks, copying the few rows a frame reaches across an edge.

    Returns the rows (``_ghost`` marks copies) and the columns to partition a window by.
    """
    block_rows = max(block_rows, before + after + 1)
    home = F.floor(F.col(pos) / F.lit(block_rows)).cast("long")
    offset = F.col(pos) - home * F.lit(block_rows)
    places = [F.struct(home.alias("b"), F.lit(False).alias("g"))]
    if before:  # late rows of a block are looked back at from the next one
        places.append(F.when(offset >= F.lit(block_rows - before), F.struct((home + 1).alias("b"), F.lit(True).alias("g"))))
    if after:  # early rows are looked ahead at from the previous one
        places.append(F.when((offset < F.lit(after)) & (home > 0), F.struct((home - 1).alias("b"), F.lit(True).alias("g"))))
    out = (
        df.withColumn("_place", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())))
        .withColumn("_block", F.col("_place.b"))
        .withColumn("_ghost", F.col("_place.g"))
        .drop("_place")
    )
    return out, [*keys, "_block"]


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank", salts: int = 64) -> DataFrame:
    """First ``k`` rows per key in a total ``order``.

    Small ``k``: Spark prunes each map task to ``k`` rows per key before the shuffle. Large ``k``:
    one extra pruning step over salted parts of the key.
    """
    if k > 1000:
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
            .withColumn("_r", F.row_number().over(part))
            .filter(F.col("_r") <= k)
            .drop("_salt", "_r")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 10_000, small_group: int = 100_000) -> DataFrame:
    """Linear-interpolation percentiles of unbounded groups, one row per key.

    A sketch only narrows the search: its error bound gives a bracket around each wanted order
    statistic, rows below the bracket are counted and only the bracket itself is sorted. Where all
    groups are small the built-in aggregate does. Few groups go to the rows, so rows never gather by key.
    """
    src = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    seen = src.groupBy(*keys).count().agg(F.max("count").alias("most"), F.count("*").alias("groups")).first()
    most = seen["most"] or 0
    if most <= small_group:
        found = src.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_p"))
        return found.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(probs)])
    slack = 4.0 / accuracy
    names = list(probs)
    bounds = []
    for p in probs.values():
        bounds += [max(0.0, p - slack), min(1.0, p + slack)]
    stats = src.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", bounds, accuracy).alias("_q"),
    )
    # a group no larger than the sketch is simply sorted
    small = F.col("_n") <= accuracy
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (F.lit(float(p)) * (F.col("_n") - 1)).alias("r"),
                F.when(small | F.lit(p - slack <= 0), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"),
                F.when(small | F.lit(p + slack >= 1), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
            )
            for i, (name, p) in enumerate(probs.items())
        ]
    )
    brackets = stats.select(*keys, F.explode(wanted).alias("w")).select(*keys, "w.*")
    if seen["groups"] <= BROADCAST_GROUPS:  # also where a whole column is one group; a counted number of short rows
        brackets = F.broadcast(brackets)
    joined = src.join(brackets, keys) if keys else src.join(brackets)
    counts = (
        joined.withColumn("_b", F.when(F.col("_v") < F.col("lo"), F.lit(None)).otherwise(F.col("_v")))
        .filter(F.col("_v") <= F.col("hi"))
        .groupBy(*keys, "name", "r", "_b")
        .agg(F.count("*").alias("c"))
    )
    if most * 2 * slack > SEGMENT_ROWS:  # even the brackets are long: rank them in segments
        counts = materialize(counts.withColumn("_o", F.coalesce("_b", F.lit(float("-inf")))))
        ranked = running(counts, [*keys, "name"], ["_o"], {"_last": F.col("c")}).withColumn("_last", F.col("_last") - 1)
    else:
        w = Window.partitionBy(*keys, "name").orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("_last", F.sum("c").over(w) - 1)
    at = lambda rank: F.min(F.when(F.col("_b").isNotNull() & (F.col("_last") >= rank), F.col("_b")))
    picked = ranked.groupBy(*keys, "name", "r").agg(at(F.floor(F.col("r"))).alias("a"), at(F.ceil(F.col("r"))).alias("b"))
    value_at = F.col("a") + (F.col("r") - F.floor(F.col("r"))) * (F.col("b") - F.col("a"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, value_at)).alias(n) for n in names])
