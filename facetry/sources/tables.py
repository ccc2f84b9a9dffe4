"""Id lists, benchmark definitions, score tables, hit lines and nested mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions.text import base_name, pair_parts
from facetry.sources.structures import lines, texts


def id_list(spark: SparkSession, path: str) -> DataFrame:
    ids = spark.read.text(path).select(F.trim("value").alias("id"))
    return ids.filter("id <> ''").distinct()


def pairs(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("id").alias("pair_id"), *[c.alias(n) for n, c in pair_parts("id").items()])


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark definition; lines starting with # are comments."""
    schema = "pdb string, chain1 string, chain2 string, drug_chain string, sdf string"
    return spark.read.schema(schema).option("comment", "#").csv(path)


# Columns that hold residue ranges, not metrics.
RANGE_COLUMNS = ["graft_in_motif_ranges", "graft_in_scaffold_ranges", "graft_out_scaffold_ranges", "graft_scaffold_size_change"]


def score_table(spark: SparkSession, path: str, metrics: list[str], repair: bool = False, glob: str = "*.sc", path_pattern: str | None = None) -> DataFrame:
    """Whitespace score files: one line skipped, then a header that may be repeated.

    Values are matched to their file's header by position. ``repair``: tokens that hold a comma, and
    the token ``0``, are dropped first (which also drops true zeros; such rows then lack a value and
    are left out, as incomplete rows always are). ``path_pattern`` adds ``seed`` and ``array``.
    A file is one row until it is split, so its header is taken there: files are read once and nothing is shuffled.
    """

    def tokens(line):
        found = F.split(F.trim(line), "\\s+")
        return F.filter(found, lambda t: (t != "0") & ~t.contains(",") & ~t.isin(RANGE_COLUMNS)) if repair else found

    is_header = lambda line: line.contains("total_score") & F.array_contains(tokens(line), "total_score")
    body = F.filter("lines", lambda line, i: (i >= 1) & (F.trim(line) != ""))
    src = texts(spark, path, glob).select("file", body.alias("body"))
    # the last header line above a row belongs to it, but every file has one layout
    src = src.withColumn("h", tokens(F.get(F.filter("body", is_header), F.lit(0)))).filter(F.col("h").isNotNull())
    names = [*metrics, "description"]
    place = F.struct(F.size("h").alias("size"), *[F.array_position("h", c).cast("int").alias(c) for c in names])
    ids = [F.regexp_extract("file", path_pattern, i + 1).alias(c) for i, c in enumerate(("seed", "array"))] if path_pattern else []
    rows = src.select("file", *ids, place.alias("at"), F.explode("body").alias("line")).filter(~is_header(F.col("line")))
    rows = rows.withColumn("t", tokens(F.col("line"))).filter(F.size("t") == F.col("at.size"))
    cell = lambda c: F.get("t", F.col("at")[c] - 1)
    out = rows.select("file", *[cell(c).try_cast("double").alias(c) for c in metrics], cell("description").alias("description"), *(["seed", "array"] if path_pattern else []))
    return out.na.drop()


SEED_ARRAY = r"seed_(\d+)/(\d+)/"


def hit_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """``key: value, key: value`` lines as typed columns."""
    m = F.str_to_map(F.col(value), F.lit(", "), F.lit(": "))
    get = lambda key, kind: F.try_element_at(m, F.lit(key)).try_cast(kind)
    return df.select(
        F.try_element_at(m, F.lit("name")).alias("name"),
        get("point id", "bigint").alias("point_id"),
        *[get(k, "double").alias(k) for k in ("score", "clashing_ca", "clashing_heavy", "desc_dist_score", "mean_desc_dist_score")],
        get("match_vix", "bigint").alias("match_vix"),
        *[get(k, "double").alias(k) for k in ("desc_dist", "iface_score")],
    )


def result_tree(spark: SparkSession, path: str, glob: str = "*.score") -> DataFrame:
    """Result files ``target/site_n/match/name.score`` as one table."""
    src = lines(spark, path, glob).filter(F.trim("value") != "")
    part = F.split("file", "/")
    m = F.str_to_map("value", F.lit(", "), F.lit(": "))
    return src.select(
        F.element_at(part, -4).alias("target"),
        F.element_at(part, -3).alias("site"),
        F.element_at(part, -2).alias("match"),
        base_name("file").alias("file_name"),
        F.try_element_at(m, F.lit("score")).try_cast("double").alias("score"),
        F.try_element_at(m, F.lit("match_vix")).try_cast("bigint").alias("match_vix"),
    )


def chain_accessions(df: DataFrame, json: str = "value") -> DataFrame:
    """Accession per chain from a nested mapping: {pdb: {"UniProt": {accession: {"mappings": [{chain_id}]}}}}; the first listed wins."""
    schema = "map<string, struct<UniProt: map<string, struct<mappings: array<struct<chain_id: string>>>>>>"
    top = df.select(F.explode(F.from_json(json, schema)).alias("pdb_id", "u"))
    acc = top.select("pdb_id", F.posexplode("u.UniProt").alias("i", "accession", "s"))
    seg = acc.select("pdb_id", "i", "accession", F.posexplode("s.mappings").alias("j", "m"))
    return seg.groupBy("pdb_id", F.col("m.chain_id").alias("chain")).agg(F.min_by("accession", F.struct("i", "j")).alias("accession"))
