"""Bounded geodesic neighbourhoods and patch tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators.scale import large, top_k
from facetry.session import materialize

CENTER_RHO = 1e-8


ROUNDS = 16


def sweep(starts: DataFrame, step: DataFrame, cutoff: float, width: float | None = None, inside: DataFrame | None = None, trace: list | None = None) -> DataFrame:
    """Nearest start of every (protein, src, vertex) along paths of at most ``cutoff``: protein_id, src, v, d, tag.

    ``starts``: protein_id, src, v, d, tag. ``step``: protein_id, v, dst, w. Ties go to the smaller ``tag``. Bucketed delta-stepping: labels below
    the current bound are final, are appended once and never written again; only they are extended, and only labels beyond the bound wait.
    If edges are no shorter than the bucket ``width`` a bucket is one pass, otherwise it is repeated over the labels that
    improved. Where every edge is there in both directions, a path from u can only come back to a final
    vertex at most one edge behind u, so that is all of the settled part that a round reads. ``inside``
    (protein_id, src, v) bounds where a source's paths may go. ``trace`` gets a row per round.
    """
    step = materialize(step.filter((F.col("w") <= cutoff) & F.col("w").isNotNull()))
    back = step.select("protein_id", F.col("dst").alias("v"), F.col("v").alias("dst"), "w")
    stats = step.agg(F.min("w").alias("least"), F.max("w").alias("most")).first()
    least, most = stats["least"] or 0.0, stats["most"] or 0.0
    both_ways = not step.join(large(back), ["protein_id", "v", "dst", "w"], "left_anti").head(1)
    width = width or max(least, cutoff / ROUNDS) or 1.0
    at = ["protein_id", "src", "v"]
    best = lambda df: df.groupBy(*at).agg(F.min(F.struct("d", "tag")).alias("b")).select(*at, "b.d", "b.tag")

    def extended(labels: DataFrame, settled: list[tuple[float, DataFrame]], lower: float) -> DataFrame:
        reach = labels.join(large(step), ["protein_id", "v"]).select("protein_id", "src", F.col("dst").alias("v"), (F.col("d") + F.col("w")).alias("d"), "tag").filter(F.col("d") <= cutoff)
        if inside is not None:
            reach = reach.join(large(inside), at, "left_semi")
        for upper, part in settled:
            if not both_ways or upper > lower - most - 1e-9:
                reach = reach.join(large(part.select(*at)), at, "left_anti")
        return reach

    waiting, settled = materialize(best(starts)), []
    while True:
        state = waiting.agg(F.min("d").alias("d"), F.count("*").alias("n")).first()
        if state["d"] is None:
            break
        lower = state["d"]
        upper = lower + width
        labels = materialize(waiting.filter(F.col("d") < upper))
        later = waiting.filter(F.col("d") >= upper)
        fresh, proposals = labels, []
        while True:
            reach = best(extended(fresh, settled, lower))
            if least >= width:  # nothing reached lies within the bucket
                proposals.append(reach)
                break
            reach = materialize(reach)
            proposals.append(reach.filter(F.col("d") >= upper))
            known = labels.select(*at, F.struct("d", "tag").alias("_k"))
            fresh = reach.filter(F.col("d") < upper).join(large(known), at, "left").filter(F.col("_k").isNull() | (F.struct("d", "tag") < F.col("_k"))).drop("_k")
            fresh = materialize(fresh)
            if not fresh.head(1):
                break
            labels = materialize(best(labels.unionByName(fresh)))
        for more in proposals:
            later = later.unionByName(more)
        waiting = materialize(best(later.join(large(labels.select(*at)), at, "left_anti")))
        settled.append((upper, labels))
        if trace is not None:
            trace.append({"upper": upper, "waiting": state["n"], "settled": labels.count()})
    out = settled[0][1] if settled else waiting
    for _, part in settled[1:]:
        out = out.unionByName(part)
    return out


def geodesics(edges: DataFrame, cutoff: float, sources: DataFrame | None = None, width: float | None = None, trace: list | None = None) -> DataFrame:
    """Shortest path lengths up to ``cutoff`` from every source: protein_id, src, v, d.

    State is keyed by (protein, source, vertex), so neither a large protein nor a hub gathers in a task; a lost
    executor repeats one round at most.
    """
    if sources is None:
        sources = edges.select("protein_id", "src").distinct()
    starts = sources.select("protein_id", "src", F.col("src").alias("v"), F.lit(0.0).alias("d"), F.lit(0).alias("tag"))
    step = edges.select("protein_id", F.col("src").alias("v"), "dst", "w")
    return sweep(starts, step, cutoff, width, trace=trace).drop("tag")


def patches(geo: DataFrame, max_members: int, radius: float | None = None) -> DataFrame:
    """Members of each centre in order of distance, at most ``max_members`` (the operator's own limit).

    The centre comes first with a distance just above zero. ``radius`` cuts a table computed for
    a larger radius.
    """
    if radius is not None:
        geo = geo.filter(F.col("d") <= radius)
    ranked = top_k(geo, ["protein_id", "src"], [F.col("d"), F.col("v")], max_members, "_r")
    rho = F.when(F.col("v") == F.col("src"), F.lit(CENTER_RHO)).otherwise(F.col("d"))
    return ranked.select("protein_id", F.col("src").alias("center_vix"), (F.col("_r") - 1).alias("pos"), F.col("v").alias("member_vix"), rho.alias("rho"))


def shrink_to_fit(geo: DataFrame, radius: float, max_members: int, factor: float = 0.95) -> DataFrame:
    """Members inside the largest radius * 0.95^k that holds at most ``max_members``; the centre is no member.

    Closed form: the first member that is too many gives the bound the radius has to fall under.
    """
    inside = geo.filter((F.col("d") > 0) & (F.col("d") < radius))
    extra = top_k(inside, ["protein_id", "src"], [F.col("d"), F.col("v")], max_members + 1, "_r").filter(F.col("_r") == max_members + 1)
    # smallest k with radius * factor^k <= bound; the correction guards the rounding of the logarithm
    k = F.greatest(F.ceil(F.log(F.col("_bound") / radius) / math.log(factor)), F.lit(0))
    cut = lambda e: F.lit(radius) * F.pow(F.lit(factor), e)
    k = F.when(cut(k) > F.col("_bound"), k + 1).when(cut(k - 1) <= F.col("_bound"), k - 1).otherwise(k)
    bound = extra.select("protein_id", "src", F.col("d").alias("_bound")).withColumn("_cut", cut(k)).drop("_bound")
    return inside.join(large(bound), ["protein_id", "src"], "left").filter(F.col("d") < F.coalesce("_cut", F.lit(radius))).drop("_cut")


def polar_angles(members: DataFrame, vertices: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Angle of each member around its centre in the tangent plane; adds ``theta`` in [0, 2 pi).

    Members beyond half the radius take the angle of the inner member nearest to them along the
    surface within the patch: labels spread outwards from all inner members of a centre at once, so each
    member is met once per centre and not once per inner member. The zero direction points to the first member after the centre.
    """
    half = radius / 2
    pt = lambda side, p: large(vertices.select("protein_id", F.col("vix").alias(side), *[F.col(c).alias(p + c) for c in "xyz"]))
    nr = vertices.select("protein_id", F.col("vix").alias("center_vix"), *[F.col(f"n{c}").alias(f"k{c}") for c in "xyz"])
    m = members.join(pt("center_vix", "c"), ["protein_id", "center_vix"]).join(pt("member_vix", "m"), ["protein_id", "member_vix"])
    m = m.join(large(nr), ["protein_id", "center_vix"])
    d = [F.col(f"m{c}") - F.col(f"c{c}") for c in "xyz"]
    along = sum(a * F.col(f"k{c}") for a, c in zip(d, "xyz"))
    flat = [(a - along * F.col(f"k{c}")).alias(f"q{c}") for a, c in zip(d, "xyz")]
    m = m.select("protein_id", "center_vix", "pos", "member_vix", "rho", "kx", "ky", "kz", *flat)
    # zero direction: the nearest member that does not lie straight above the centre
    side = F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2) > 1e-9
    ref = m.groupBy("protein_id", "center_vix").agg(F.min_by(F.when(side, F.struct("qx", "qy", "qz")), F.when(side, F.col("pos"))).alias("u"))
    m = m.join(large(ref), ["protein_id", "center_vix"])
    u = [F.col(f"u.q{c}") for c in "xyz"]
    v = (
        F.col("ky") * u[2] - F.col("kz") * u[1],
        F.col("kz") * u[0] - F.col("kx") * u[2],
        F.col("kx") * u[1] - F.col("ky") * u[0],
    )
    q = [F.col(f"q{c}") for c in "xyz"]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    theta = F.pmod(F.atan2(dot(q, v), dot(q, u)), F.lit(2 * math.pi))
    m = m.withColumn("_t", F.coalesce(theta, F.lit(0.0))).select("protein_id", "center_vix", "pos", "member_vix", "rho", "_t")

    m = materialize(m)
    inner, outer = m.filter(F.col("rho") < half), m.filter(F.col("rho") >= half)
    starts = inner.select("protein_id", F.col("center_vix").alias("src"), F.col("member_vix").alias("v"), F.lit(0.0).alias("d"), F.col("member_vix").alias("tag"))
    inside = members.select("protein_id", F.col("center_vix").alias("src"), F.col("member_vix").alias("v"))
    step = edges.select("protein_id", F.col("src").alias("v"), "dst", "w")
    spread = sweep(starts, step, radius, inside=inside).filter("d > 0")
    angle = inner.select("protein_id", "center_vix", F.col("member_vix").alias("tag"), F.col("_t").alias("_it"))
    near = spread.select("protein_id", F.col("src").alias("center_vix"), F.col("v").alias("member_vix"), "tag").join(large(angle), ["protein_id", "center_vix", "tag"]).drop("tag")
    outer = outer.join(large(near), ["protein_id", "center_vix", "member_vix"], "left").withColumn("_t", F.coalesce("_it", "_t")).drop("_it")
    return inner.unionByName(outer).withColumnRenamed("_t", "theta")


def patch_mean(members: DataFrame, scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean vertex score over the members of each patch."""
    s = scores.select("protein_id", F.col("vix").alias("member_vix"), F.col(score).alias("_s"))
    return members.join(large(s), ["protein_id", "member_vix"]).groupBy("protein_id", "center_vix").agg(F.avg("_s").alias("mean_score"))


def top_sites(means: DataFrame, n: int, key: str = "protein_id", ids: str = "center_vix") -> DataFrame:
    """The ``n`` patches with the highest mean score per protein, first id on ties."""
    out = top_k(means, [key], [F.desc("mean_score"), F.col(ids)], n, "_r")
    return out.withColumn("site_ix", F.col("_r") - 1).drop("_r")


def penalised_sites(members: DataFrame, scores: DataFrame, n: int, factor: float = 0.5) -> DataFrame:
    """Older site rule: after each pick the scores inside the picked patch are scaled down. ``n`` rounds."""
    picked = None
    current = scores.select("protein_id", "vix", "score")
    for i in range(n):
        means = patch_mean(members, current)
        if picked is not None:
            means = means.join(picked.select("protein_id", "center_vix"), ["protein_id", "center_vix"], "left_anti")
        best = materialize(top_sites(means, 1).withColumn("site_ix", F.lit(i)))
        picked = best if picked is None else picked.unionByName(best)
        hit = members.join(best.select("protein_id", "center_vix"), ["protein_id", "center_vix"], "left_semi").select("protein_id", F.col("member_vix").alias("vix"), F.lit(factor).alias("_f"))
        current = materialize(current.join(hit.distinct(), ["protein_id", "vix"], "left").withColumn("score", F.col("score") * F.coalesce("_f", F.lit(1.0))).drop("_f"))
    return picked
