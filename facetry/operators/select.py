"""Design selection: best of retries, quantile cutoffs, tiers per seed, redundancy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.scale import exact_percentiles


def best_attempt(df: DataFrame, keys: list[str], score: str, attempt: str, keep: list[str] = ()) -> DataFrame:
    """Best score per candidate; the earlier attempt wins a tie."""
    value = F.struct(F.col(score).alias("score"), F.col(attempt).alias("attempt"), *[F.col(c) for c in keep])
    best = df.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col(score), F.col(attempt))).alias("_b"))
    return best.select(*keys, "_b.score", "_b.attempt", *[f"_b.{c}" for c in keep])


def normalized(value: str, area: str) -> Column:
    """Per 1000 square units of buried area; null for no area."""
    return F.try_divide(F.col(value), F.col(area)) * 1000


# Quantile and direction per metric (at most the upper quartile, at least the lower one).
QUANTILE_RULES = {
    "ddg": (0.75, "<="),
    "nddg": (0.75, "<="),
    "bunsh": (0.75, "<="),
    "bunsh2": (0.75, "<="),
    "sc": (0.25, ">="),
    "hbonds": (0.25, ">="),
    "sasa": (0.25, ">="),
    "mol_contacts": (0.25, ">="),
}


def _present(df: DataFrame, rules: dict[str, tuple[float, str]]) -> dict[str, tuple[float, str]]:
    """Rules of the metrics that the table has."""
    return {m: r for m, r in rules.items() if m in df.columns}


def quantile_cutoffs(df: DataFrame, rules: dict[str, tuple[float, str]] = QUANTILE_RULES) -> DataFrame:
    """One row with a cutoff per metric, each taken over all designs."""
    rules = _present(df, rules)
    # an upper quantile is a lower one of the negated values, so one probability serves both
    side = {m: (-1.0, 1 - p) if p > 0.5 else (1.0, p) for m, (p, _) in rules.items()}
    name = lambda p: f"p{round(p * 1000)}"
    entries = [F.struct(F.lit(m).alias("metric"), (F.col(m).cast("double") * s).alias("v")) for m, (s, _) in side.items()]
    tall = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    table = exact_percentiles(tall, ["metric"], "v", {name(p): p for _, p in side.values()})
    return table.agg(*[(F.max(F.when(F.col("metric") == m, F.col(name(p)))) * s).alias(f"cut_{m}") for m, (s, p) in side.items()])


def select_by_cutoffs(df: DataFrame, cutoffs: DataFrame | dict[str, float], rules: dict[str, tuple[float, str]] = QUANTILE_RULES, optional: dict[str, float] | None = None) -> DataFrame:
    """Keep designs inside every cutoff; an optional metric counts only where the column exists."""
    cols, rules = df.columns, _present(df, rules)
    if isinstance(cutoffs, dict):
        value = lambda m: F.lit(cutoffs[m])
    else:
        df = df.join(F.broadcast(cutoffs))  # a single row
        value = lambda m: F.col(f"cut_{m}")
    for m, (_, op) in rules.items():
        df = df.filter(F.col(m) <= value(m) if op == "<=" else F.col(m) >= value(m))
    for m, v in (optional or {}).items():
        if m in cols:
            df = df.filter(F.col(m) >= v)
    return df.select(*cols)


@dataclass
class Tier:
    nddg: float
    sc: float
    bunsh: int
    hbonds: int
    sasa: float


@dataclass
class TierRules:
    """Five tiers, each stricter, and the wanted number of designs per seed."""

    tiers: list[Tier] = field(
        default_factory=lambda: [
            Tier(-21.5, 0.67, 2, 5, 1200),
            Tier(-23, 0.699, 1, 7, 1270),
            Tier(-25, 0.71, 1, 9, 1335),
            Tier(-27.7, 0.73, 1, 10, 1370),
            Tier(-30, 0.72, 0, 11, 1390),
        ]
    )
    least: int = 5
    most: int = 40
    # the published rule cuts energy limits to whole numbers towards zero
    truncate: bool = True

    def passes(self, i: int) -> Column:
        t = self.tiers[i]
        limit = float(int(t.nddg)) if self.truncate else t.nddg
        return (
            (F.col("nddg") < limit)
            & (F.col("sc") > t.sc)
            & (F.col("bunsh") <= t.bunsh)
            & (F.col("hbonds") >= t.hbonds)
            & (F.col("sasa") >= t.sasa)
        )


def tier_choice(designs: DataFrame, rules: TierRules, seeds: DataFrame | None = None) -> DataFrame:
    """Per seed the tier to use: -1 nothing, 0 everything, n tier n; and the outcome name.

    All tiers are counted in one pass; the cascade is then a chain of conditions on those counts.
    """
    n = len(rules.tiers)
    c = [F.col(f"n{i + 1}") for i in range(n)]
    counts = designs.groupBy("seed").agg(F.count("*").alias("n_designs"), *[F.count_if(rules.passes(i)).alias(f"n{i + 1}") for i in range(n)])
    if seeds is not None:
        counts = seeds.join(counts, "seed", "left").na.fill(0)
    chain = F.when(F.col("n_designs") == 0, -1).when(F.col("n_designs") < rules.least, 0).when(c[0] <= rules.most, 1)
    for i in range(1, n):
        chain = chain.when(c[i] <= rules.least, i).when(c[i] <= rules.most, i + 1)
    choice = counts.withColumn("tier", chain.otherwise(-1))
    outcome = (
        F.when(F.col("n_designs") == 0, "None")
        .when(F.col("n_designs") < rules.least, "Not passed")
        .when(F.col("tier") > 0, F.concat(F.lit("Cutoff "), F.col("tier").cast("string")))
        .otherwise("Over")
    )
    return choice.withColumn("outcome", outcome)


def tiered_selection(designs: DataFrame, rules: TierRules | None = None) -> DataFrame:
    rules = rules or TierRules()
    choice = tier_choice(designs, rules).select("seed", "tier").filter("tier >= 0")
    keep = F.col("tier") == 0
    for i in range(len(rules.tiers)):
        keep = keep | ((F.col("tier") == i + 1) & rules.passes(i))
    return designs.join(choice, "seed").filter(keep)


def tier_outcomes(designs: DataFrame, rules: TierRules | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """Seeds per outcome; a seed that fell to tier 1 with nothing left also counts as not passed."""
    choice = tier_choice(designs, rules or TierRules(), seeds)
    extra = choice.filter((F.col("tier") == 1) & (F.col("n1") == 0) & (F.col("n_designs") >= (rules or TierRules()).least)).select(F.lit("Not passed").alias("outcome"))
    return choice.select("outcome").unionAll(extra).groupBy("outcome").agg(F.count("*").alias("seeds"))


def drop_redundant(selected: DataFrame, threshold: float = 0.7, energy: str = "nddg") -> DataFrame:
    """Of two selected designs that are each other's close match, drop the one with the worse energy.

    Columns: ``description``, ``similarity``, ``closest``, energy. Names are compared exactly.
    """
    other = selected.select(F.col("description").alias("closest"), F.col(energy).alias("_other"))
    close = selected.filter(F.col("similarity") > threshold).join(other, "closest")
    loser = F.when(F.col(energy) <= F.col("_other"), F.col("closest")).otherwise(F.col("description"))
    return selected.join(close.select(loser.alias("description")).distinct(), "description", "left_anti")


def pre_post(df: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Per metric: rows that grew after design, and the two medians."""
    each = [
        F.struct(F.lit(m).alias("metric"), F.col(a).cast("double").alias("pre"), F.col(b).cast("double").alias("post"))
        for m, (a, b) in metrics.items()
    ]
    tall = df.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    grown = tall.groupBy("metric").agg(F.count_if(F.col("post") > F.col("pre")).alias("grown"), F.count("*").alias("n"))
    pre = exact_percentiles(tall, ["metric"], "pre", {"median_pre": 0.5})
    post = exact_percentiles(tall, ["metric"], "post", {"median_post": 0.5})
    return grown.join(pre, "metric").join(post, "metric")


def attach_metrics(designs: DataFrame, tables: dict[str, DataFrame], key: str = "description") -> DataFrame:
    """Left-join metric tables onto the designs by name; rows with nulls in a table are ignored."""
    for t in tables.values():
        designs = designs.join(t.na.drop(), key, "left")
    return designs


def counts_per_seed(designs: DataFrame, seeds: DataFrame) -> DataFrame:
    return seeds.join(designs.groupBy("seed").agg(F.count("*").alias("n")), "seed", "left").na.fill(0, ["n"])
