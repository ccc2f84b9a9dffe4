"""Text formats in and out, score tables, hit lines, nested mappings, chemistry from structures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import chem
from facetry.functions.geometry import PI
from facetry.operators import filters
from facetry.operators.contact import BACKBONE, min_distances
from facetry.operators.sequence import fragments
from facetry.plans import preprocess
from facetry.sinks import tables as out_tables
from facetry.sinks import text as out_text
from facetry.sources import structures, tables

PDB = """HEADER    TEST
SEQRES   1 A    3  ALA MSE HIS
MODEL        1
ATOM      1  N   ALA A   5      11.104   6.134  -6.504  1.00  0.00           N
ATOM      2  CA AALA A   5      11.639   6.071  -5.147  1.00  0.00           C
ANISOU    2  CA AALA A   5     1111   1111   1111      0      0      0       C
ATOM      3  CA BALA A   5      11.739   6.171  -5.247  1.00  0.00           C
ATOM      4  H   ALA A   5A     10.100   6.200  -6.400  1.00  0.00           H
HETATM    5 HG    HG A 201      40.000   1.000   2.000  1.00  0.00          HG
HETATM    6  C1  LIG B 301       1.000   1.000   2.000  1.00  0.00           C
TER
ENDMDL
MODEL        2
ATOM      1  N   ALA A   5      21.104   6.134  -6.504  1.00  0.00           N
ENDMDL
"""


@pytest.fixture()
def atoms(spark, tmp_path):
    (tmp_path / "1abc.pdb").write_text(PDB)
    return structures.atoms(spark, str(tmp_path))


def test_structure_scan(spark, atoms, tmp_path):
    rows = atoms.orderBy("serial").collect()
    assert [r.model for r in rows] == [0] * 6 + [1] and {r.structure_id for r in rows} == {"1abc"}
    first = rows[0]
    assert (first.chain, first.resid, first.icode, first.resname, first.atom, first.x, first.z) == ("A", 5, " ", "ALA", "N", 11.104, -6.504)
    assert rows[3].icode == "A" and rows[4].hetflag == "H_HG" and rows[4].element == "Hg"
    assert atoms.filter("hetflag = ' '").count() == 5 and atoms.filter("hetflag <> ' '").count() == 2
    assert filters.first_altloc(atoms).filter("atom = 'CA'").count() == 1
    # by name mercury is dropped with the hydrogens, by element it is not
    assert atoms.filter(filters.not_hydrogen_name()).filter("resname = 'HG'").count() == 0
    assert atoms.filter(filters.not_hydrogen_element()).filter("resname = 'HG'").count() == 1
    assert [r.resname for r in structures.nonstandard_residues(spark, str(tmp_path)).collect()] == ["MSE"]
    assert filters.chain_atoms(atoms, ["A"]).count() == 5 and filters.chain_atoms(atoms, ["A", "B"], ligand="LIG").count() == 6
    assert filters.chain_with_residue(atoms, "LIG").first().chain == "B"
    with pytest.raises(Exception, match="no residue XYZ"):
        filters.chain_with_residue(atoms, "XYZ").collect()


def test_structure_round_trip(spark, atoms, tmp_path):
    lines = out_text.posed_structures(atoms.filter("model = 0"))
    out_text.write_files(lines, str(tmp_path / "out"), "structure_id", ["serial"])
    text = next((tmp_path / "out" / "structure_id=1abc").glob("*.txt")).read_text().splitlines()
    assert text[0] == "ATOM      3  N   ALA A   5      11.104   6.134  -6.504  1.00  0.00           N" and len(text) == 4
    key = out_text.surface_input(atoms.filter("model = 0"), ["LIG"]).orderBy("serial").collect()
    assert key[0].value == "11.104000 6.134000 -6.504000 1.540000 1 A_5_x_ALA_N_Blue" and key[-1].value.endswith("B_301_x_LIG_C1_Green")
    assert [r.value for r in key if "_H_" in r.value][0].endswith("A_5_A_ALA_H_Blue")
    f = fragments(atoms.filter("model = 0"), ["structure_id"], ["serial"], F.col("serial") == 6)
    body = [r.value[:4] for r in out_text.seed_with_breaks(f).orderBy("fragment", "end", "serial").collect()]
    assert body.count("TER") == f.select("fragment").distinct().count()


def test_mesh_round_trip(spark, tmp_path):
    v = spark.createDataFrame([("p1", i, float(i), 0.5, -1.25, 0.0, 0.0, 1.0, 0.1 * i) for i in range(4)], "protein_id string, vix int, x double, y double, z double, nx double, ny double, nz double, charge double")
    f = spark.createDataFrame([("p1", 0, 0, 1, 2), ("p1", 1, 1, 3, 2)], "protein_id string, fix int, v0 int, v1 int, v2 int")
    out_text.write_meshes(v, f, str(tmp_path / "m"))
    src = next((tmp_path / "m").rglob("*.txt"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.ply").write_text(src.read_text())
    v2, f2 = structures.mesh_text(spark, str(tmp_path / "in"))
    a, b = v.orderBy("vix").toPandas(), v2.orderBy("vix").toPandas()
    assert np.allclose(a[["x", "y", "z", "nz", "charge"]], b[["x", "y", "z", "nz", "charge"]], atol=0.005)
    assert (b.hbond == 0).all() and (b.iface_label == 0).all() and b.protein_id.unique() == ["p1"]
    assert [tuple(r) for r in f2.orderBy("fix").collect()] == [tuple(r) for r in f.orderBy("fix").collect()]


def test_surface_tool_and_arrays(spark, tmp_path):
    (tmp_path / "s.vert").write_text("# a\n# b\n 2 1 1.0 1.0\n 1.0 2.0 3.0 0.0 0.0 1.0 0 1 0 A_5_x_ALA_CA_Green\n 4.0 5.0 6.0 0.0 1.0 0.0 0 1 0 A_6_x_GLY_N_Blue\n")
    (tmp_path / "s.face").write_text("# a\n# b\n 1 1 1.0 1.0\n 1 2 2 1 1\n")
    (tmp_path / "s.area").write_text("Atom ses sas\n 0 1.5 2.5\n 1 0.5 1.0\n")
    (tmp_path / "s.csv").write_text("1,2,3,0.25\n4,5,6,-1.5\n")
    v, f, a = structures.surface_tool(spark, str(tmp_path))
    assert [tuple(r) for r in f.collect()] == [("s", 0, 0, 1, 1)] and a.agg(F.sum("area")).first()[0] == 2.0
    keyed = structures.with_atom_keys(v).orderBy("vix").collect()
    assert [(k.resname, k.resid, k.x) for k in keyed] == [("ALA", 5, 1.0), ("GLY", 6, 4.0)]
    assert structures.check_counts(spark, str(tmp_path), v, "*.vert", ".vert").count() == 0
    assert structures.check_counts(spark, str(tmp_path), v.limit(1), "*.vert", ".vert").count() == 1
    assert [r.charge for r in structures.charges(spark, str(tmp_path)).orderBy("vix").collect()] == [0.25, -1.5]
    x = np.arange(12, dtype=np.float32).reshape(2, 2, 3)
    np.save(tmp_path / "x.npy", x)
    got = structures.array_files(spark, str(tmp_path)).orderBy("row", "col").toPandas()
    assert (got.value.values == x.ravel()).all() and got.col.max() == 5


def test_score_tables(spark, tmp_path):
    d = tmp_path / "out" / "seed_3" / "2"
    d.mkdir(parents=True)
    (d / "score_S3.sc").write_text("SEQUENCE:\nSCORE: total_score sc sasa description\nSCORE: -5.5 0.6 1200 d_1\nSCORE: total_score sc sasa description\nSCORE: bad 0.7 1300 d_2\nSCORE: -6.0 0.7 1300 d_3\n")
    t = tables.score_table(spark, str(tmp_path), ["total_score", "sc", "sasa"], path_pattern=tables.SEED_ARRAY).orderBy("description").collect()
    assert [(r.description, r.total_score, r.seed, r.array) for r in t] == [("d_1", -5.5, "3", "2"), ("d_3", -6.0, "3", "2")]
    (d / "score_S3.sc").write_text("SEQUENCE:\nSCORE: total_score graft_in_motif_ranges sc hb description\nSCORE: -5.5 1,2 0.6 4 d_1\nSCORE: -5.0 1,3 0.6 0 d_2\n")
    t = tables.score_table(spark, str(tmp_path), ["total_score", "sc", "hb"], repair=True).collect()
    assert [(r.description, r.sc, r.hb) for r in t] == [("d_1", 0.6, 4.0)]  # a true zero is dropped with its row
    df = spark.createDataFrame([(-5.51234, "3", "a")], "total_score double, seed string, description string")
    assert out_tables.design_lines(df, ["total_score", "seed", "description"]).first().total_score == "-5.512"


def test_score_files_are_read_once(spark, tmp_path, capsys):
    """Each file goes by its own first header and nothing is shuffled or joined; a file without a header has no rows."""
    (tmp_path / "a.sc").write_text("total_score in the title\nSCORE: total_score ddG description\n\nSCORE: 1 2.5 total_scores\n  SCORE: total_score ddG description\nSCORE: 1 0 a_2\nSCORE: 1 2\n")
    (tmp_path / "b.sc").write_text("title\r\nSCORE: description hb total_score ddG\r\nSCORE: b_1 0 7 -4\r\nSCORE: b_2 x 7 -3\r\n")
    (tmp_path / "c.sc").write_text("title\nSCORE: 1 2.5 c_1\n")
    t = tables.score_table(spark, str(tmp_path), ["ddG"], path_pattern=r"/(\w)()\.sc")
    assert t.columns == ["file", "ddG", "description", "seed", "array"]
    assert sorted((r.seed, r.ddG, r.description) for r in t.collect()) == [("a", 0.0, "a_2"), ("a", 2.5, "total_scores"), ("b", -4.0, "b_1"), ("b", -3.0, "b_2")]
    assert tables.score_table(spark, str(tmp_path), ["hb"]).collect()[0].hb == 0.0  # "x" is no number, other files lack the column
    t.explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan


def test_lists_cases_and_tree(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("1ABC_A_B \n\n1ABC_A_B\n2DEF_C_\n")
    ids = tables.id_list(spark, str(tmp_path / "ids.txt"))
    assert {r.id for r in ids.collect()} == {"1ABC_A_B", "2DEF_C_"}
    assert tables.pairs(ids).filter("pdb_id = '2DEF'").first().chains2 is None
    (tmp_path / "cases.txt").write_text("#x\n1ABC,A,BC,L,f.sdf\n")
    c = tables.cases(spark, str(tmp_path / "cases.txt"))
    from facetry.plans.evaluation import partner_map, run_matrix

    assert {tuple(r) for r in partner_map(c).collect()} == {("1ABC_A", "1ABC_BC"), ("1ABC_BC", "1ABC_A")}
    setups = spark.createDataFrame([("with",), ("without",)], "setup string")
    assert run_matrix(setups, c).select("setup", "target_chains").distinct().count() == 4
    p = tmp_path / "res" / "T1" / "site_0" / "M1"
    p.mkdir(parents=True)
    line = spark.createDataFrame([("M1", 3, 0.95123, 0, 1, 12.5, 2.5, 77, 1.25, 0.5)], "name string, point_id int, score double, clashing_ca int, clashing_heavy int, desc_dist_score double, mean_desc_dist_score double, match_vix long, desc_dist double, iface_score double").select(out_text.hit_line().alias("v")).first().v
    assert line.startswith("name: M1, point id: 3, score: 0.9512, clashing_ca: 0, clashing_heavy: 1")
    (p / "m_3.score").write_text(line + "\n")
    r = tables.result_tree(spark, str(tmp_path / "res")).first()
    assert (r.target, r.site, r.match, r.score, r.match_vix) == ("T1", "site_0", "M1", 0.9512, 77)


def test_json_in_and_out(spark):
    doc = {"7mon": {"UniProt": {"P2": {"mappings": [{"chain_id": "A"}]}, "P1": {"mappings": [{"chain_id": "B"}, {"chain_id": "A"}]}}}}
    got = tables.chain_accessions(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    assert {r.chain: r.accession for r in got.collect()} == {"A": "P2", "B": "P1"}
    fits = spark.createDataFrame([("7mon", 1, "A", 0.5, "u1"), ("7mon", 1, "B", 0.25, "u2"), ("7mon", 2, "C", 1.0, "u3")], "pdb_id string, interactor int, chain string, rmsd double, url string")
    back = json.loads(out_tables.rmsd_json(fits).first().value)
    assert back == {"pdb_id": "7mon", "interactor_1": {"A": {"rmsd": 0.5, "af2_pdb_url": "u1"}, "B": {"rmsd": 0.25, "af2_pdb_url": "u2"}}, "interactor_2": {"C": {"rmsd": 1.0, "af2_pdb_url": "u3"}}}


def test_bucketed_and_partitioned(spark, tmp_path):
    d = spark.createDataFrame([("p", i, [1.0, 2.0]) for i in range(4)], "protein_id string, vix int, desc array<double>")
    out_tables.write_descriptors(d.withColumn("variant", F.lit("straight")), d.withColumn("variant", F.lit("flipped")), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).filter("variant = 'flipped'").count() == 4
    s = d.select("protein_id", "vix", (F.col("vix") * 0.1).alias("score")).filter("vix < 3")
    v = d.select("protein_id", "vix", F.lit(1.0).alias("iface_label"))
    assert [r.iface_label for r in out_tables.scores_on_mesh(v, s).orderBy("vix").collect()] == [0.0, 0.1, 0.2, 0.0]


def _angle(a, b, c):
    u, v = a - b, c - b
    return math.acos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1))


def test_hydrogen_bonds(spark):
    rng = np.random.default_rng(1)
    at = {"N": (0, 0, 0), "H": (1, 0, 0), "CA": (-0.7, 1.2, 0), "C": (-2, 1.2, 0.3), "O": (-2.7, 2.1, 0.2), "CB": (0, 2, 1), "CG": (0.5, 3, 1), "OD1": (1.5, 3.2, 1.2)}
    rows = [("s", "A", 1, " ", "ASP", n, i, *map(float, p)) for i, (n, p) in enumerate(at.items())]
    cols = "structure_id string, chain string, resid int, icode string, resname string, atom string, serial int, x double, y double, z double"
    atoms = spark.createDataFrame(rows, cols)
    verts = [("s", "A", 1, " ", "ASP", n, 10 * j + k, *map(float, np.array(at[n]) + rng.normal(size=3) * 1.5)) for j, n in enumerate(("H", "OD1", "O", "CB")) for k in range(5)]
    v = spark.createDataFrame(verts, cols.replace("serial", "vix"))
    got = preprocess.hydrogen_bonds(v, atoms).toPandas().set_index("vix").hbond
    pen = lambda d: max(0.0, 1 - (d / (math.pi / 3)) ** 2)
    p = {n: np.array(x, float) for n, x in at.items()}
    for *_, name, vix, x, y, z in verts:
        q = np.array([x, y, z])
        if name == "H":
            want = pen(abs(_angle(p["N"], p["H"], q) - math.pi))
        elif name == "CB":
            want = 0.0
        else:
            base, plane = ("CG", "CB") if name == "OD1" else ("C", "CA")
            b0, b1, b2 = p[plane] - p[base], p[name] - p[base], q - p[name]
            b1 = b1 / np.linalg.norm(b1)
            vv, ww = b0 - b0 @ b1 * b1, b2 - b2 @ b1 * b1
            dih = abs(math.atan2(np.cross(b1, vv) @ ww, vv @ ww))
            want = -pen(abs(_angle(p[base], p[name], q) - 2 * math.pi / 3)) * pen(min(dih, math.pi - dih))
        assert abs(got[vix] - want) < 1e-9


def test_satisfied_backbone(spark):
    # residue 2 offers its H straight to the O of residue 1
    o, c = np.zeros(3), np.array([math.cos(8 * math.pi / 9), math.sin(8 * math.pi / 9), 0]) * 1.2
    h, n = np.array([2.0, 0, 0]), np.array([3.0, 0, 0])
    rows = [(1, "O", o), (1, "C", c), (2, "H", h), (2, "N", n)]
    cols = "structure_id string, chain string, resid int, icode string, resname string, atom string, serial int, x double, y double, z double"
    atoms = spark.createDataFrame([("s", "A", r, " ", "ALA", a, i, *map(float, p)) for i, (r, a, p) in enumerate(rows)], cols)
    co, hn = preprocess.satisfied_backbone(atoms)
    assert [r.resid for r in co.collect()] == [1] and [r.resid for r in hn.collect()] == [2]
    v = spark.createDataFrame([("s", "A", 1, " ", "ALA", "O", 0, 1.0, 1.0, 0.0), ("s", "A", 2, " ", "ALA", "H", 1, 0.5, 0.0, 0.0)], cols.replace("serial", "vix"))
    assert all(r.hbond == 0.0 for r in preprocess.hydrogen_bonds(v, atoms).collect())


def test_ligand_hydrogen_bonds_and_hydropathy(spark):
    v = spark.createDataFrame([("s", 0, "O1", 0.5, math.sqrt(3) / 2, 0.0), ("s", 1, "N1", 1.0, 0.0, 0.0)], "structure_id string, vix int, atom string, x double, y double, z double")
    d = spark.createDataFrame([("s", "O1", "acceptor", True, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("s", "N1", "donor", False, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0), ("s", "N1", "donor", False, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "structure_id string, atom string, kind string, cone boolean, ax double, ay double, az double, dx double, dy double, dz double")
    got = preprocess.ligand_hydrogen_bonds(v, d).toPandas().set_index("vix").hbond
    assert abs(got[0] + 1) < 1e-9 and abs(got[1] - 1) < 1e-9
    h = spark.createDataFrame([("ARG", -5.0), ("XXX", 9.0)], "r string, p double").select(chem.hydropathy(F.col("r")).alias("h"), chem.fragment_hydropathy(F.col("p")).alias("f")).collect()
    assert h[0].h == -4.5 and h[1].h == 0.0 and h[1].f == 4.5 and h[0].f == -4.5


def test_no_target_means_a_thousand(spark):
    a = spark.createDataFrame([(1, "CB", 0.0, 0.0, 0.0), (2, "CA", 0.0, 0.0, 0.0)], "resid int, atom string, x double, y double, z double")
    t = spark.createDataFrame([(0, 3.0, 4.0, 0.0)], "vix int, x double, y double, z double")
    got = {r.resid: r.min_dist for r in min_distances(a, t, ["resid"], "vix").collect()}
    assert got == {1: 5.0, 2: 1000.0} and "CA" in BACKBONE and PI == math.pi
