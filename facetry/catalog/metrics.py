"""Ranking, selection, sequence, set and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry import fixtures
from facetry.catalog.registry import DESIGNS, query, r6
from facetry.functions.text import base_name, collapse_gaps, fixed, pair_parts, stem, strip_gaps
from facetry.operators import ranking, sampling, select, sequence
from facetry.operators.filters import listed, not_done, not_listed_by_prefix, trainable
from facetry.operators.scale import exact_percentiles, top_k
from facetry.sinks.text import hit_line
from facetry.sources.tables import hit_lines


@query("best_of_retries", "SELECT user_id AS target, event_type, value AS score, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, ts) = 1")
def best_of_retries(spark, sf):
    a = fixtures.attempts(spark, sf).withColumnRenamed("attempt", "event_id")
    return select.best_attempt(a, ["target", "event_type"], "score", "ts", ["event_id"]).drop("attempt")


_ROC = """ j AS (SELECT lang, n_chars AS s, quality AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT *, rank() OVER ({p} ORDER BY s) + (count(*) OVER ({q}) - 1) / 2.0 AS rk FROM j)
SELECT {c} round((sum(rk) FILTER (y=1) - count(*) FILTER (y=1) * (count(*) FILTER (y=1) + 1) / 2.0) / nullif(count(*) FILTER (y=1) * count(*) FILTER (y=0), 0), {d}) AS auc, count(*) FILTER (y=1) AS n_pos, count(*) FILTER (y=0) AS n_neg FROM r {g}"""


def _labelled(spark, sf):
    return fixtures.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(fixtures.table(spark, sf, "labels"), "doc_id")


@query("roc_auc_by_group", "WITH" + _ROC.format(p="PARTITION BY lang", q="PARTITION BY lang, s", c="lang,", g="GROUP BY lang", d=6))
def roc_auc_by_group(spark, sf):
    return ranking.auc(_labelled(spark, sf), ["lang"], F.col("n_chars"), F.col("quality") == 1).select("lang", r6("auc"), "n_pos", "n_neg")


@query("roc_auc_global", "WITH" + _ROC.format(p="", q="PARTITION BY s", c="", g="", d=6))
def roc_auc_global(spark, sf):
    return ranking.auc(_labelled(spark, sf), [], F.col("n_chars"), F.col("quality") == 1).select(r6("auc"), "n_pos", "n_neg")


@query("roc_auc_summary", "WITH a AS (WITH" + _ROC.format(p="PARTITION BY lang", q="PARTITION BY lang, s", c="lang,", g="GROUP BY lang", d=15) + ") SELECT round(avg(auc), 5) AS mean_auc, round(quantile_cont(auc, 0.5), 5) AS median_auc, count(*) AS groups FROM a WHERE auc IS NOT NULL")
def roc_auc_summary(spark, sf):
    a = ranking.auc(_labelled(spark, sf), ["lang"], F.col("n_chars"), F.col("quality") == 1)
    return ranking.auc_summary(a, []).select(F.round("mean_auc", 5).alias("mean_auc"), F.round("median_auc", 5).alias("median_auc"), "groups")


_RANKS = """b AS (SELECT user_id, max(value) FILTER (event_type = 'purchase') AS best FROM events GROUP BY user_id),
rk AS (SELECT e.user_id, CASE WHEN max(best) IS NOT NULL THEN count(*) FILTER (event_type <> 'purchase' AND value > best) + 1 END AS rank FROM events e JOIN b ON b.user_id = e.user_id GROUP BY e.user_id)"""


def _ranks(spark, sf):
    return ranking.best_positive_rank(fixtures.attempts(spark, sf), ["target"], "score", F.col("event_type") == "purchase")


@query("best_positive_rank", "WITH " + _RANKS + " SELECT user_id AS target, rank FROM rk")
def best_positive_rank(spark, sf):
    return _ranks(spark, sf)


@query("topk_counters", "WITH " + _RANKS + " SELECT count(*) AS total, count(*) FILTER (rank <= 2000) AS top2000, count(*) FILTER (rank <= 1000) AS top1000, count(*) FILTER (rank <= 100) AS top100, count(*) FILTER (rank <= 10) AS top10, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (rank <= 1) AS top1, round(avg(rank), 6) AS mean_rank, count(*) FILTER (rank IS NULL) AS failed, round(quantile_cont(rank, 0.5), 6) AS median_rank FROM rk")
def topk_counters(spark, sf):
    c = ranking.topk_counters(_ranks(spark, sf))
    return c.withColumn("mean_rank", F.round("mean_rank", 6)).withColumn("median_rank", F.round("median_rank", 6))


KS = [0, 1, 2, 3, 5, 10]
_CURVE = """WITH r AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, min(rk) AS first FROM r WHERE ok AND {cond} GROUP BY user_id)
SELECT k::INT AS k, (SELECT count(*) FROM f WHERE first <= k) AS solved FROM (VALUES (0), (1), (2), (3), (5), (10)) t(k)"""


@query("recovery_curve", _CURVE.format(cond="rk IN (1, 2, 3, 5, 10) AND n > rk"))
def recovery_curve(spark, sf):
    return ranking.recovery_curve(fixtures.attempts(spark, sf), "target", "score", F.col("event_type") == "purchase", KS, "attempt")


@query("recovery_curve_all_ranks", _CURVE.format(cond="rk <= 10"))
def recovery_curve_all_ranks(spark, sf):
    return ranking.recovery_curve(fixtures.attempts(spark, sf), "target", "score", F.col("event_type") == "purchase", KS, "attempt", listed_only=False)


@query("confusion_matrix", "SELECT quality, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1 FROM labels GROUP BY quality")
def confusion_matrix(spark, sf):
    return ranking.confusion(fixtures.table(spark, sf, "labels"), "quality", "toxic", [0, 1])


@query("class_accuracy", "SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels")
def class_accuracy(spark, sf):
    return ranking.accuracy(fixtures.table(spark, sf, "labels"), "quality", "toxic").select(r6("accuracy"))


@query("score_histogram", """WITH b AS (SELECT min(value) lo, max(value) hi FROM events), h AS (SELECT event_type, least(floor((value - lo) / ((hi - lo) / 100)), 99)::INT AS bin, (hi - lo) / 100 AS w FROM events, b),
t AS (SELECT event_type, count(*) AS total FROM h GROUP BY event_type) SELECT h.event_type, bin, count(*) AS n, round(count(*) / (max(total) * max(w)), 6) AS density FROM h JOIN t ON t.event_type = h.event_type GROUP BY h.event_type, bin""")
def score_histogram(spark, sf):
    h = ranking.score_histogram(fixtures.table(spark, sf, "events"), "event_type", "value")
    return h.select("event_type", "bin", "n", r6("density"))


@query("mean_by_class", "SELECT event_type, round(avg(value), 6) AS mean_value, round(avg(user_id), 6) AS mean_user_id FROM events GROUP BY event_type")
def mean_by_class(spark, sf):
    return ranking.mean_by_class(fixtures.table(spark, sf, "events"), "event_type", ["value", "user_id"]).select("event_type", r6("mean_value"), r6("mean_user_id"))


@query("class_balance", "SELECT lang, quality, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL")
def class_balance(spark, sf):
    return ranking.class_balance(_labelled(spark, sf), "lang", "quality")


@query("training_eligibility", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view')::BIGINT AS pos FROM events GROUP BY user_id HAVING count(*) <= 8000 AND count(*) FILTER (event_type = 'view') <= 0.75 * count(*) AND count(*) FILTER (event_type = 'view') >= 2")
def training_eligibility(spark, sf):
    e = fixtures.table(spark, sf, "events").withColumn("iface", F.col("event_type") == "view")
    return trainable(e, "user_id", "iface", min_positives=2)


def _designs(spark, sf):
    return fixtures.designs(spark, sf).withColumn("nddg", select.normalized("ddg", "sasa"))


_CUTS = """, q AS (SELECT quantile_cont(ddg, 0.75) AS cut_ddg, quantile_cont(nddg, 0.75) AS cut_nddg, quantile_cont(bunsh, 0.75) AS cut_bunsh, quantile_cont(sc, 0.25) AS cut_sc, quantile_cont(hbonds, 0.25) AS cut_hbonds, quantile_cont(sasa, 0.25) AS cut_sasa FROM des)"""


@query("quantile_cutoffs", "WITH " + DESIGNS + _CUTS + " SELECT round(cut_ddg, 6) AS cut_ddg, round(cut_nddg, 6) AS cut_nddg, round(cut_bunsh, 6) AS cut_bunsh, round(cut_sc, 6) AS cut_sc, round(cut_hbonds, 6) AS cut_hbonds, round(cut_sasa, 6) AS cut_sasa FROM q")
def quantile_cutoffs(spark, sf):
    c = select.quantile_cutoffs(_designs(spark, sf))
    return c.select(*[r6(x) for x in c.columns])


_OUT = "description, seed, nddg, sc, hbonds, bunsh, sasa"


def _out(df):
    return df.select("description", "seed", "nddg", "sc", "hbonds", "bunsh", "sasa")


@query("quantile_cutoff_selection", "WITH " + DESIGNS + _CUTS + f" SELECT {_OUT} FROM des, q WHERE ddg <= cut_ddg AND nddg <= cut_nddg AND bunsh <= cut_bunsh AND sc >= cut_sc AND hbonds >= cut_hbonds AND sasa >= cut_sasa")
def quantile_cutoff_selection(spark, sf):
    d = _designs(spark, sf)
    return _out(select.select_by_cutoffs(d, select.quantile_cutoffs(d), optional={"dssp_ratio": 66}))


# limits that fit the driver tables, same cascade
RULES = select.TierRules(
    tiers=[select.Tier(-10.5, 0.71, 3, 1, 200), select.Tier(-15, 0.73, 2, 2, 300), select.Tier(-20, 0.74, 2, 2, 400), select.Tier(-25.7, 0.76, 1, 3, 500), select.Tier(-30, 0.79, 1, 4, 600)]
)


def _tier_sql() -> str:
    t = RULES.tiers
    flags = ", ".join(f"(nddg < {int(x.nddg)} AND sc > {x.sc} AND bunsh <= {x.bunsh} AND hbonds >= {x.hbonds} AND sasa >= {x.sasa}) AS p{i + 1}" for i, x in enumerate(t))
    counts = ", ".join(f"count(*) FILTER (p{i + 1}) AS n{i + 1}" for i in range(5))
    chain = "CASE WHEN n < 5 THEN 0 WHEN n1 <= 40 THEN 1" + "".join(f" WHEN n{i} <= 5 THEN {i - 1} WHEN n{i} <= 40 THEN {i}" for i in range(2, 6)) + " ELSE -1 END"
    return f"f AS (SELECT *, {flags} FROM des), c AS (SELECT seed, count(*) AS n, {counts} FROM f GROUP BY seed), ch AS (SELECT *, {chain} AS tier FROM c)"


@query("tiered_selection", "WITH " + DESIGNS + ", " + _tier_sql() + f" SELECT tier, f.description, f.seed, nddg, sc, hbonds, bunsh, sasa FROM f JOIN ch ON ch.seed = f.seed WHERE tier = 0 OR (tier = 1 AND p1) OR (tier = 2 AND p2) OR (tier = 3 AND p3) OR (tier = 4 AND p4) OR (tier = 5 AND p5)")
def tiered_selection(spark, sf):
    s = select.tiered_selection(_designs(spark, sf), RULES)
    return s.select("tier", "description", "seed", "nddg", "sc", "hbonds", "bunsh", "sasa")


@query("tier_outcomes", "WITH " + DESIGNS + ", " + _tier_sql() + " SELECT outcome, count(*) AS seeds FROM (SELECT CASE WHEN tier = -1 THEN 'Over' WHEN tier = 0 THEN 'Not passed' ELSE 'Cutoff ' || tier END AS outcome FROM ch UNION ALL SELECT 'Not passed' FROM ch WHERE tier = 1 AND n1 = 0 AND n >= 5) GROUP BY outcome")
def tier_outcomes(spark, sf):
    return select.tier_outcomes(_designs(spark, sf), RULES)


@query("designs_per_seed", "SELECT s_suppkey AS seed, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def designs_per_seed(spark, sf):
    seeds = fixtures.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed"))
    return select.counts_per_seed(fixtures.designs(spark, sf), seeds)


@query("metric_left_joins", "SELECT o_orderkey AS description, o_totalprice, c_acctbal, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def metric_left_joins(spark, sf):
    o = fixtures.table(spark, sf, "orders").select(F.col("o_orderkey").alias("description"), "o_totalprice", "o_custkey")
    c = fixtures.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return select.attach_metrics(o, {"customer": c}, "o_custkey").drop("o_custkey")


@query("pre_post_compare", """WITH m AS (SELECT 'price' AS metric, l_extendedprice AS pre, l_extendedprice*(1-l_discount) AS post FROM lineitem UNION ALL SELECT 'rate', l_discount, l_tax FROM lineitem)
SELECT metric, count(*) FILTER (post > pre) AS grown, count(*) AS n, round(quantile_cont(pre, 0.5), 6) AS median_pre, round(quantile_cont(post, 0.5), 6) AS median_post FROM m GROUP BY metric""")
def pre_post_compare(spark, sf):
    li = fixtures.table(spark, sf, "lineitem").withColumn("after", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = select.pre_post(li, {"price": ("l_extendedprice", "after"), "rate": ("l_discount", "l_tax")})
    return out.select("metric", "grown", "n", r6("median_pre"), r6("median_post"))


@query("sliding_window_best_fragment", """WITH w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS start, sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS total, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS c FROM events)
SELECT user_id, start, round(total, 4) AS total FROM w WHERE c = 12 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(total, 6) DESC, start) = 1""")
def sliding_window_best_fragment(spark, sf):
    out = sequence.best_window(fixtures.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 12)
    return out.select("user_id", "start", F.round("total", 4).alias("total"))


_RUNS = """WITH o AS (SELECT user_id, event_type IN ('view', 'click') AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
i AS (SELECT *, {island} AS isl FROM o), r AS (SELECT user_id, min(pos) AS first, max(pos) AS last, count(*) AS length, max(n) AS n FROM i WHERE m {extra} GROUP BY user_id, isl)
SELECT user_id, first, last, length FROM r WHERE length > 2 {tail}"""


@query("run_detection", _RUNS.format(island="pos - row_number() OVER (PARTITION BY user_id, m ORDER BY pos)", extra="", tail=""))
def run_detection(spark, sf):
    e = fixtures.table(spark, sf, "events")
    return sequence.state_runs(e, ["user_id"], ["ts"], F.col("event_type").isin("view", "click"), longer_than=2)


@query("run_detection_compat", _RUNS.format(island="pos - row_number() OVER (PARTITION BY user_id, m AND pos > 0 ORDER BY pos)", extra="AND pos > 0", tail="AND last < n - 1"))
def run_detection_compat(spark, sf):
    e = fixtures.table(spark, sf, "events")
    return sequence.state_runs(e, ["user_id"], ["ts"], F.col("event_type").isin("view", "click"), longer_than=2, strict_compat=True)


_FRAG = "f AS (SELECT conv_id, turn, 1 + coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fragment FROM conversations)"


@query("fragment_numbering", f"WITH {_FRAG} SELECT * FROM f")
def fragment_numbering(spark, sf):
    c = fixtures.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return sequence.fragments(c, ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "fragment")


@query("fragment_spans", f"WITH {_FRAG} SELECT conv_id, fragment, min(turn) AS start, max(turn) - min(turn) + 1 AS length FROM f GROUP BY ALL")
def fragment_spans(spark, sf):
    return sequence.fragment_spans(fragment_numbering(spark, sf), ["conv_id", "fragment"], "turn", "turn")


@query("trim_hotspots", """WITH l AS (SELECT user_id, list(DISTINCT (event_id % 97)::BIGINT ORDER BY (event_id % 97)::BIGINT) AS spots FROM events GROUP BY user_id),
t(user_id, lo, hi, spots) AS (SELECT user_id, 1, len(spots), spots FROM l WHERE len(spots) >= 2 AND spots[-1] - spots[1] >= 15),
s AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT user_id, lo, hi, spots FROM t UNION ALL SELECT user_id, CASE WHEN spots[lo+1] - spots[lo] > 2 THEN lo + 1 ELSE lo END, CASE WHEN spots[lo+1] - spots[lo] > 2 THEN hi ELSE hi - 1 END, spots FROM r WHERE hi > lo AND (spots[lo+1] - spots[lo] > 2 OR spots[hi] - spots[hi-1] > 2)) SELECT user_id, min(hi - lo) AS w, max(lo) AS lo, min(hi) AS hi FROM r GROUP BY user_id))
SELECT l.user_id, coalesce(s.lo, 1)::INT AS lo, coalesce(s.hi, len(l.spots))::INT AS hi FROM l LEFT JOIN s ON s.user_id = l.user_id""")
def trim_hotspots(spark, sf):
    e = fixtures.table(spark, sf, "events")
    # a seed has at most 97 residues here, so the list is short whatever the number of events
    l = e.groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("event_id") % 97)).alias("spots"))
    l = l.withColumn("kept", sequence.trim_hotspots(F.col("spots")))
    return l.select("user_id", F.array_position("spots", F.col("kept")[0]).cast("int").alias("lo"), F.array_position("spots", F.element_at("kept", -1)).cast("int").alias("hi"))


_H = "('0x' || substr(md5(concat_ws('|', '{seed}', {ids})), 1, 12))::BIGINT"


@query("sample_per_group", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY " + _H.format(seed=7, ids="doc_id") + ", doc_id) <= 20")
def sample_per_group(spark, sf):
    return sampling.sample_per_group(fixtures.table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 20, 7)


@query("hash_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY " + _H.format(seed=3, ids="doc_id") + ", doc_id) - 1 AS pos FROM documents")
def hash_shuffle(spark, sf):
    return sampling.shuffled_ordinals(fixtures.table(spark, sf, "documents").select("doc_id"), [], ["doc_id"], 3)


@query("negative_pairs", """WITH a AS (SELECT lang, doc_id AS binder, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
b AS (SELECT lang, doc_id AS partner, row_number() OVER (PARTITION BY lang ORDER BY """ + _H.format(seed=5, ids="doc_id") + """, doc_id) AS i FROM documents) SELECT a.lang, binder, partner FROM a JOIN b ON a.lang = b.lang AND a.i = b.i""")
def negative_pairs(spark, sf):
    d = fixtures.table(spark, sf, "documents").select("lang", "doc_id")
    return sampling.repaired(d.withColumnRenamed("doc_id", "binder"), d.withColumnRenamed("doc_id", "partner"), ["lang"], "binder", "partner", 5)


@query("first_points", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 32")
def first_points(spark, sf):
    o = fixtures.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return top_k(o, ["o_custkey"], [F.col("o_orderkey")], 32).drop("rank")


@query("fraction_split", "SELECT doc_id, CASE WHEN " + _H.format(seed=1, ids="doc_id") + " / 281474976710656.0 < 0.72 THEN 'train' WHEN " + _H.format(seed=1, ids="doc_id") + " / 281474976710656.0 < 0.72 + 0.08 THEN 'val' ELSE 'test' END AS split FROM documents")
def fraction_split(spark, sf):
    return fixtures.table(spark, sf, "documents").select("doc_id", sampling.split_column(["doc_id"], sampling.POCKET_SPLIT, 1).alias("split"))


@query("train_test_split_lists", "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'train' ELSE 'test' END AS split FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def train_test_split_lists(spark, sf):
    l = fixtures.table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return sampling.listed_split(fixtures.table(spark, sf, "documents").select("doc_id"), "doc_id", l.filter("quality = 1"), l.filter("quality = 0"))


@query("exclusion_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclusion_antijoin(spark, sf):
    return not_done(fixtures.table(spark, sf, "documents").select("doc_id"), fixtures.table(spark, sf, "labels"), ["doc_id"])


@query("exclusion_by_prefix", "WITH k AS (SELECT lower(p_brand) || p_size || '_' || p_partkey AS id FROM part) SELECT id FROM k WHERE upper(split_part(id, '_', 1)) NOT IN (SELECT upper(p_brand || p_size) FROM part WHERE p_retailprice > 990)")
def exclusion_by_prefix(spark, sf):
    p = fixtures.table(spark, sf, "part")
    first = F.concat("p_brand", F.col("p_size").cast("string"))
    ids = p.select(F.concat_ws("_", F.lower(first), F.col("p_partkey").cast("string")).alias("id"))
    return not_listed_by_prefix(ids, "id", p.filter("p_retailprice > 990").select(first.alias("id")))


@query("whitelist_semijoin", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def whitelist_semijoin(spark, sf):
    n = fixtures.table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    return listed(fixtures.table(spark, sf, "customer"), "c_nationkey", n).select("c_custkey")


@query("modulo_shards", "SELECT doc_id % 1000 AS shard, count(*) AS n FROM documents GROUP BY 1")
def modulo_shards(spark, sf):
    return fixtures.table(spark, sf, "documents").groupBy(sampling.shard(F.col("doc_id")).alias("shard")).agg(F.count("*").alias("n"))


@query("hit_line_roundtrip", "SELECT event_type AS name, event_id AS point_id, round(value, 4) AS score, (event_id % 3)::DOUBLE AS clashing_ca, user_id AS match_vix, value AS desc_dist FROM events")
def hit_line_roundtrip(spark, sf):
    e = fixtures.table(spark, sf, "events")
    h = e.select(
        F.col("event_type").alias("name"), F.col("event_id").alias("point_id"), F.col("value").alias("score"), (F.col("event_id") % 3).alias("clashing_ca"), F.lit(0).alias("clashing_heavy"),
        F.lit(1.5).alias("desc_dist_score"), F.lit(0.5).alias("mean_desc_dist_score"), F.col("user_id").alias("match_vix"), F.col("value").alias("desc_dist"), F.lit(1.0).alias("iface_score"),
    )
    back = hit_lines(h.select(hit_line().alias("value")))
    return back.select("name", "point_id", "score", "clashing_ca", "match_vix", "desc_dist")


@query("props_json", "SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def props_json(spark, sf):
    e = fixtures.table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "value"))


@query("id_parts", "WITH k AS (SELECT p_name || '_' || p_size || '_' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS id FROM part) SELECT id, split_part(id, '_', 1) AS pdb_id, nullif(split_part(id, '_', 2), '') AS chains1, nullif(split_part(id, '_', 3), '') AS chains2 FROM k")
def id_parts(spark, sf):
    p = fixtures.table(spark, sf, "part")
    last = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit(""))
    k = p.select(F.concat_ws("_", "p_name", F.col("p_size").cast("string"), last).alias("id"))
    return k.select("id", *[c.alias(n) for n, c in pair_parts("id").items()])


@query("name_and_gap_text", r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.html$', '') AS stem, regexp_replace(url, '-+', '-', 'g') AS collapsed, trim(url, '-') AS stripped FROM pages")
def name_and_gap_text(spark, sf):
    p = fixtures.table(spark, sf, "pages")
    return p.select("page_id", base_name("url").alias("base"), stem("url", ".html").alias("stem"), collapse_gaps("url").alias("collapsed"), strip_gaps("url").alias("stripped"))


@query("normalized_metrics", "WITH " + DESIGNS + " SELECT seed, round(avg(nddg), 5) AS nddg, printf('%.3f', max(sc)) AS sc_text FROM des GROUP BY seed")
def normalized_metrics(spark, sf):
    d = _designs(spark, sf).groupBy("seed").agg(F.avg("nddg").alias("n"), F.max("sc").alias("s"))
    return d.select("seed", F.round("n", 5).alias("nddg"), fixed("s").alias("sc_text"))


@query("price_percentiles", "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50 FROM lineitem GROUP BY l_suppkey")
def price_percentiles(spark, sf):
    p = exact_percentiles(fixtures.table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", {"q25": 0.25, "q50": 0.5})
    return p.select("l_suppkey", r6("q25"), r6("q50"))
