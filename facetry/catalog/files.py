"""Round trips through the text formats: driver rows are written as files, read back and compared with the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facetry import fixtures
from facetry.catalog.registry import ATOMS, query, lattice_sql, r6
from facetry.session import checkpoint_root
from facetry.sinks import tables as sink_tables
from facetry.sinks.tables import rmsd_json
from facetry.sinks.text import atom_line, write_files, write_meshes
from facetry.sources import structures, tables

BUCKETS = 8


def _folder(spark, what: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@query(
    "structure_file_roundtrip",
    "WITH " + ATOMS + """ SELECT (vix // 100)::VARCHAR AS structure_id, chain, (resid % 10000)::INT AS resid, CASE WHEN vix % 7 = 0 THEN 'H_LIG' ELSE ' ' END AS hetflag, atom, element,
  round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, vix % 2 AS model FROM atm""",
)
def structure_file_roundtrip(spark, sf):
    """One file per hundred atoms with two models, atoms and hetero atoms; the fixed columns come back."""
    a = fixtures.atoms(spark, sf).withColumns(
        {
            "protein_id": F.expr("vix div 100"),
            "hetflag": F.when(F.col("vix") % 7 == 0, F.lit("H_LIG")).otherwise(F.lit(" ")),
            "resname": F.when(F.col("vix") % 7 == 0, F.lit("LIG")).otherwise(F.lit("ALA")),
            "resid": F.col("resid") % 10000,
            "altloc": F.lit(" "),
            "icode": F.lit(" "),
            "model": F.col("vix") % 2,
        }
    )
    body = a.select("protein_id", "model", F.col("vix").alias("ix"), atom_line(F.col("vix") % 100000).alias("value"))
    heads = a.select("protein_id", "model").distinct().select("protein_id", "model", F.lit(-1).cast("long").alias("ix"), F.format_string("MODEL     %4d", (F.col("model") + 1).cast("int")).alias("value"))
    path = _folder(spark, "structures")
    write_files(body.unionByName(heads), path, "protein_id", ["model", "ix"])
    got = structures.atoms(spark, path, "*.txt")
    # a protein may lack the first model: numbers count the MODEL records of its file
    first = a.groupBy(F.col("protein_id").cast("string").alias("structure_id")).agg(F.min("model").alias("_first"))
    got = got.join(first, "structure_id")
    seen = got.groupBy("structure_id").agg(F.min("model").alias("_seen"))
    model = (F.col("model") - F.col("_seen") + F.col("_first")).cast("long").alias("model")
    return got.join(seen, "structure_id").select("structure_id", "chain", "resid", "hetflag", "atom", "element", *[(F.col(c) + 0.0).alias(c) for c in "xyz"], model)


def _mesh(spark, sf):
    v = fixtures.lattice_vertices(spark, sf)
    path = _folder(spark, "meshes")
    write_meshes(v, fixtures.lattice_faces(v), path, digits=4)
    return structures.mesh_text(spark, path, "*.txt")


@query("mesh_file_vertices", "WITH " + lattice_sql() + " SELECT protein_id::VARCHAR AS protein_id, vix, x, y, round(z, 4) + 0.0 AS z, round(charge, 4) + 0.0 AS charge, round(hphob, 4) + 0.0 AS hphob, 0.0::DOUBLE AS nx FROM lat")
def mesh_file_vertices(spark, sf):
    """Vertices and attributes of written meshes; attributes that a file lacks are zero."""
    v, _ = _mesh(spark, sf)
    return v.select("protein_id", "vix", "x", "y", *[(F.col(c) + 0.0).alias(c) for c in ("z", "charge", "hphob")], "nx")


@query("mesh_file_faces", "WITH " + lattice_sql() + " SELECT protein_id::VARCHAR AS protein_id, v0, v1, v2 FROM fac")
def mesh_file_faces(spark, sf):
    _, f = _mesh(spark, sf)
    return f.select("protein_id", "v0", "v1", "v2")


@query("id_list_file", "SELECT DISTINCT p_brand || '_' || p_size AS id FROM part")
def id_list_file(spark, sf):
    """Ids with blanks around them, repeats and blank lines, as a list file holds them."""
    p = fixtures.table(spark, sf, "part").select(F.concat_ws("_", "p_brand", "p_size").alias("id"))
    path = _folder(spark, "ids")
    p.select(F.explode(F.array(F.concat(F.lit("  "), "id", F.lit(" ")), F.lit(" "), "id")).alias("value")).write.text(path)
    return tables.id_list(spark, path)


@query("benchmark_case_file", "SELECT 'S' || s_suppkey AS pdb, 'A' AS chain1, chr((66 + s_nationkey % 5)::INT) AS chain2, CASE WHEN s_nationkey % 2 = 0 THEN 'X' END AS drug_chain FROM supplier")
def benchmark_case_file(spark, sf):
    """Benchmark definitions between comment lines; empty fields are null."""
    s = fixtures.table(spark, sf, "supplier")
    drug = F.when(F.col("s_nationkey") % 2 == 0, F.lit("X")).otherwise(F.lit(""))
    row = F.concat_ws(",", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.lit("A"), F.char((F.col("s_nationkey") % 5 + 66).cast("long")), drug, F.lit("m.sdf"))
    path = _folder(spark, "cases")
    s.select(F.explode(F.array(F.concat(F.lit("# "), F.col("s_name")), row)).alias("value")).write.text(path)
    return tables.cases(spark, path).select("pdb", "chain1", "chain2", "drug_chain")


@query(
    "score_file_roundtrip",
    "SELECT l_suppkey::VARCHAR AS seed, concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS description, round(-l_extendedprice/1000, 6) + 0.0 AS ddG, round(l_quantity*50, 6) AS sasa FROM lineitem WHERE l_linenumber <> 7",
)
def score_file_roundtrip(spark, sf):
    """Score files, one per seed: a title line, the header once more in the middle, range columns to repair; incomplete rows are left out."""
    d = fixtures.designs(spark, sf)
    names = "SCORE: total_score ddG sasa graft_in_motif_ranges description"
    dd = lambda c: F.round(c, 6).cast("string")
    short = F.col("hbonds") == 7  # such a row lacks a value
    cells = F.concat_ws(" ", F.lit("SCORE: 1.5"), dd("ddg"), F.when(~short, dd("sasa")), F.lit("3,9"), "description")
    rows = d.select(F.col("seed").alias("key"), F.lit(2).alias("part"), "description", cells.alias("value"))
    fixed = F.array(F.struct(F.lit(0).alias("part"), F.lit("SEQUENCE:").alias("value")), F.struct(F.lit(1).alias("part"), F.lit(names).alias("value")), F.struct(F.lit(3).alias("part"), F.lit(names).alias("value")))
    heads = d.select(F.col("seed").alias("key")).distinct().select("key", F.explode(fixed).alias("h")).select("key", "h.part", F.lit("").alias("description"), "h.value")
    path = _folder(spark, "scores")
    write_files(rows.unionByName(heads), path, "key", ["part", "description"])
    got = tables.score_table(spark, path, ["ddG", "sasa"], repair=True, glob="*.txt", path_pattern=r"key=(\d+)()/")
    return got.select("seed", "description", r6("ddG"), r6("sasa"))


@query("sequence_records", "SELECT DISTINCT (p_partkey // 50)::VARCHAR AS structure_id, ['MSE','SEP','TPO'][(p_partkey % 4)::INT] AS resname FROM part WHERE p_partkey % 4 <> 0")
def sequence_records(spark, sf):
    """Residue names of sequence records that are none of the twenty."""
    p = fixtures.table(spark, sf, "part")
    name = F.element_at(F.array(*[F.lit(n) for n in ("ALA", "MSE", "SEP", "TPO")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    line = F.format_string("SEQRES %3d A %4d  ALA %s GLY", (F.col("p_partkey") % 1000).cast("int"), F.lit(3), name)
    path = _folder(spark, "sequences")
    write_files(p.select(F.expr("p_partkey div 50").alias("key"), "p_partkey", line.alias("value")), path, "key", ["p_partkey"])
    return structures.nonstandard_residues(spark, path, "*.txt")


@query("charge_file_roundtrip", "WITH " + lattice_sql() + " SELECT protein_id::VARCHAR AS protein_id, row_number() OVER (PARTITION BY protein_id ORDER BY vix) - 1 AS vix, round(charge, 6) + 0.0 AS charge FROM lat")
def charge_file_roundtrip(spark, sf):
    """Electrostatics files in vertex order: the line gives the vertex."""
    v = fixtures.lattice_vertices(spark, sf)
    path = _folder(spark, "charges")
    v.repartition("protein_id").sortWithinPartitions("protein_id", "vix").select("protein_id", "x", "y", "z", "charge").write.partitionBy("protein_id").csv(path)
    got = structures.charges(spark, path)
    return got.select("protein_id", F.col("vix").cast("long").alias("vix"), r6("charge"))


@query(
    "chain_accession_json",
    "SELECT 'P' || s_suppkey // 8 AS pdb_id, chr((65 + s_suppkey % 3)::INT) AS chain, 'Q' || min(s_suppkey) AS accession FROM supplier GROUP BY s_suppkey // 8, s_suppkey % 3",
)
def chain_accession_json(spark, sf):
    """Nested accession mappings as text, one document per structure; the first accession that lists a chain wins."""
    s = fixtures.table(spark, sf, "supplier")
    chain = F.char((F.col("s_suppkey") % 3 + 65).cast("long"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("k"), chain.alias("chain_id"))))  # eight per structure
    entry = lambda e: F.struct(F.concat(F.lit("Q"), e["k"].cast("string")), F.struct(F.array(F.struct(e["chain_id"].alias("chain_id"))).alias("mappings")))
    per = s.groupBy(F.expr("s_suppkey div 8").alias("_p")).agg(F.map_from_entries(F.transform(listed, entry)).alias("u"))
    pdb = F.concat(F.lit("P"), F.col("_p").cast("string"))
    return tables.chain_accessions(per.select(F.to_json(F.create_map(pdb, F.struct(F.col("u").alias("UniProt")))).alias("value")))


@query("rmsd_json_documents", "SELECT 'P' || s_suppkey // 8 AS pdb_id, s_suppkey % 2 + 1 AS interactor, s_suppkey::VARCHAR AS chain, s_acctbal AS rmsd, s_name AS url FROM supplier")
def rmsd_json_documents(spark, sf):
    """Fit documents as JSON text and back as rows."""
    s = fixtures.table(spark, sf, "supplier")
    fits = s.select(F.concat(F.lit("P"), F.expr("s_suppkey div 8").cast("string")).alias("pdb_id"), (F.col("s_suppkey") % 2 + 1).alias("interactor"), F.col("s_suppkey").cast("string").alias("chain"), F.col("s_acctbal").alias("rmsd"), F.col("s_name").alias("url"))
    inner = "map<string, struct<rmsd: double, af2_pdb_url: string>>"
    doc = rmsd_json(fits).select(F.from_json("value", f"pdb_id string, interactor_1 {inner}, interactor_2 {inner}").alias("d"))
    side = lambda i: doc.select("d.pdb_id", F.lit(i).cast("long").alias("interactor"), F.explode(f"d.interactor_{i}").alias("chain", "m"))
    return side(1).unionAll(side(2)).select("pdb_id", "interactor", "chain", "m.rmsd", F.col("m.af2_pdb_url").alias("url"))


@query(
    "positional_join_bucketed",
    "WITH " + ATOMS + " SELECT protein_id, vix, round(x, 6) + 0.0 AS x, round(charge, 6) + 0.0 AS charge, round(score, 6) + 0.0 AS score, atom FROM atm WHERE score > 0.5",
)
def positional_join_bucketed(spark, sf):
    """Vertices, scores and names written as bucketed tables and joined by position, bucket by bucket."""
    p, a = fixtures.points(spark, sf), fixtures.atoms(spark, sf)
    sides = [p.select("protein_id", "vix", "x", "charge"), p.select("protein_id", "vix", "score"), a.select("protein_id", "vix", "atom")]
    names = []
    for side in sides:
        path = _folder(spark, "bucketed")
        names.append("side_" + path.rsplit("-", 1)[-1])
        sink_tables.write_bucketed(side, names[-1], ["protein_id", "vix"], BUCKETS, sort_by=["protein_id", "vix"], path=path)
    out = sink_tables.positional_join(spark, names, ["protein_id", "vix"]).filter("score > 0.5")
    return out.select("protein_id", "vix", r6("x"), r6("charge"), r6("score"), "atom")
