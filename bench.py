"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from facetry.catalog import QUERIES
from facetry.session import local_session

HEADLINE = [
    "vector_threshold_match",
    "vector_global_topk",
    "vector_rank_of_partner",
    "pivot_index_match",
    "radius_join",
    "nearest_neighbour",
    "knn_interpolate",
    "clash_gate",
    "geodesic_patches",
    "patch_polar_angles",
    "ring_percentiles",
    "tiered_selection",
    "quantile_cutoff_selection",
    "roc_auc_by_group",
    "sliding_window_best_fragment",
    "run_detection",
    "recovery_curve",
    "price_percentiles",
    "ordered_names",
    "seed_search",
    "docking_ranks",
]


def scan_rate(spark, sf_dir: str, copies: int = 1000) -> dict[str, float]:
    """Rows scanned per second by the threshold match over ``copies`` shifted copies of the table: one site and ten sites."""
    from pyspark.sql import functions as F

    from facetry import fixtures
    from facetry.catalog.search import MAX_DIST, MIN_SCORE, site_targets
    from facetry.operators.vector_search import threshold_match

    d = fixtures.descriptors(spark, sf_dir)
    n = d.count()
    big = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("vix", F.col("vix") + F.col("copy") * n)
    big = big.repartition(spark.sparkContext.defaultParallelism)
    out = {"rows": n * copies}
    for sites in (1, 10):
        some = site_targets(d).limit(sites)
        started = time.perf_counter()
        threshold_match(big, some, MAX_DIST, MIN_SCORE).write.format("noop").mode("overwrite").save()
        sec = time.perf_counter() - started
        out |= {f"sec_{sites}": round(sec, 3), f"rows_per_sec_{sites}": round(n * copies / sec)}
    return out


def pivot_share(spark, sf_dir: str) -> dict[str, float]:
    """Shares of all pairs of rows and sites that the pivot index visits, measures and finds."""
    from facetry import fixtures
    from facetry.catalog.search import MAX_DIST, site_targets
    from facetry.operators.pivots import build_index, measured_share

    d = fixtures.descriptors(spark, sf_dir)
    return {k: round(v, 6) for k, v in measured_share(build_index(d), site_targets(d), MAX_DIST).items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    extra = {} if os.environ.get("BENCH_SKIP_SCAN") else {"scan": scan_rate(spark, sf_dir), "pivots": pivot_share(spark, sf_dir)}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir), **extra}))


if __name__ == "__main__":
    main()
