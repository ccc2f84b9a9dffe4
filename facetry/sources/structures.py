"""Structure text, surface text and array files."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions.text import RESIDUE_LETTERS, atom_key_parts, owner, stem
from facetry.operators.scale import SEGMENT_ROWS
from facetry.operators.sequence import model_numbers


def texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Many files, one row each: file, lines."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("lines"))


def lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Lines of many files with their number: file, line_no, value. One row per file until it is split."""
    return texts(spark, path, glob).select("file", F.posexplode("lines").alias("line_no", "value"))


def _field(start: int, end: int) -> Column:
    return F.trim(F.substring("value", start + 1, end - start))


def atoms(spark: SparkSession, path: str, glob: str = "*.pdb", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """ATOM and HETATM records by fixed columns; other records only matter where they start a model."""
    src = lines(spark, path, glob)
    src = model_numbers(src, ["file"], ["line_no"], F.col("value").startswith("MODEL"), segment_rows)
    rec = F.substring("value", 1, 6)
    src = src.filter(rec.isin("ATOM  ", "HETATM"))
    raw = lambda a, b: F.substring("value", a + 1, b - a)
    name = _field(12, 16)
    element = F.when(_field(76, 78) != "", F.initcap(_field(76, 78))).otherwise(F.upper(F.regexp_extract(name, "[A-Za-z]", 0)))
    return src.select(
        owner("file").alias("structure_id"),
        "model",
        raw(21, 22).alias("chain"),
        _field(22, 26).try_cast("int").alias("resid"),
        raw(26, 27).alias("icode"),
        _field(17, 20).alias("resname"),
        F.when(rec == "HETATM", F.when(_field(17, 20).isin("HOH", "WAT"), "W").otherwise(F.concat(F.lit("H_"), _field(17, 20)))).otherwise(F.lit(" ")).alias("hetflag"),
        name.alias("atom"),
        element.alias("element"),
        raw(16, 17).alias("altloc"),
        *[_field(a, a + 8).try_cast("double").alias(c) for a, c in zip((30, 38, 46), "xyz")],
        F.col("line_no").alias("serial"),
    )


def nonstandard_residues(spark: SparkSession, path: str, glob: str = "*.pdb") -> DataFrame:
    """Residue names of the sequence records that are none of the twenty."""
    seq = lines(spark, path, glob).filter(F.col("value").startswith("SEQRES"))
    names = seq.select(owner("file").alias("structure_id"), F.explode(F.split(F.trim(F.substring("value", 20, 61)), "\\s+")).alias("resname"))
    return names.filter((F.col("resname") != "") & ~F.col("resname").isin(list(RESIDUE_LETTERS))).distinct()


def mesh_text(spark: SparkSession, path: str, glob: str = "*.ply") -> tuple[DataFrame, DataFrame]:
    """ASCII meshes with a property header: vertices (missing attributes are 0) and faces."""
    text = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(owner("_metadata.file_path", ".ply").alias("protein_id"), "value")
    parts = F.split("value", "end_header\\s*\n", 2)
    head = F.split(parts[0], "element face")[0]
    m = text.select(
        "protein_id",
        F.regexp_extract("value", "element vertex (\\d+)", 1).cast("int").alias("n"),
        F.regexp_extract_all(head, F.lit("property \\w+ (\\w+)"), 1).alias("props"),
        F.split(F.trim(parts[1]), "\n").alias("rows"),
    )
    rows = m.select("protein_id", "n", "props", F.posexplode("rows").alias("pos", "row")).withColumn("f", F.split(F.trim("row"), "\\s+"))
    vert = rows.filter(F.col("pos") < F.col("n")).withColumn("m", F.map_from_arrays("props", F.slice("f", 1, F.size("props"))))
    get = lambda *names: F.coalesce(*[F.try_element_at("m", F.lit(n)).try_cast("double") for n in names], F.lit(0.0))
    vertices = vert.select(
        "protein_id",
        F.col("pos").alias("vix"),
        *[get(c).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")],
        get("charge", "vertex_charge").alias("charge"),
        get("hbond", "vertex_hbond").alias("hbond"),
        get("hphob", "vertex_hphob").alias("hphob"),
        get("iface", "vertex_iface").alias("iface_label"),
    )
    face = rows.filter((F.col("pos") >= F.col("n")) & (F.size("f") >= 4))
    faces = face.select("protein_id", (F.col("pos") - F.col("n")).alias("fix"), *[F.col("f")[i + 1].cast("int").alias(f"v{i}") for i in range(3)])
    return vertices, faces


def surface_tool(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Output of a surface program: ``.vert`` and ``.face`` (counts in the third line, ids from 1) and ``.area``."""

    def body(glob: str, ext: str, skip: int) -> DataFrame:
        src = lines(spark, path, glob).filter((F.col("line_no") >= skip) & (F.trim("value") != ""))
        return src.select(stem("file", ext).alias("protein_id"), (F.col("line_no") - skip).alias("ix"), F.split(F.trim("value"), "\\s+").alias("f"))

    v = body("*.vert", ".vert", 3)
    vertices = v.select(
        "protein_id", F.col("ix").alias("vix"), *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))], F.get("f", F.lit(9)).alias("atom_key")
    )
    f = body("*.face", ".face", 3)
    faces = f.select("protein_id", F.col("ix").alias("fix"), *[(F.col("f")[i].cast("int") - 1).alias(f"v{i}") for i in range(3)])
    a = body("*.area", ".area", 1)
    areas = a.select("protein_id", F.col("f")[0].cast("int").alias("atom_ix"), F.col("f")[1].cast("double").alias("area"))
    return vertices, faces, areas


def check_counts(spark: SparkSession, path: str, rows: DataFrame, glob: str, ext: str) -> DataFrame:
    """Rows whose file announced another number of rows than were read (empty when all is well)."""
    head = lines(spark, path, glob).filter(F.col("line_no") == 2)
    said = head.select(stem("file", ext).alias("protein_id"), F.split(F.trim("value"), "\\s+")[0].cast("long").alias("announced"))
    return said.join(rows.groupBy("protein_id").agg(F.count("*").alias("found")), "protein_id", "left").filter(~F.col("announced").eqNullSafe(F.col("found")))


def charges(spark: SparkSession, path: str) -> DataFrame:
    """Electrostatics per vertex by position: x, y, z, value."""
    src = lines(spark, path, "*.csv").filter(F.trim("value") != "")
    return src.select(owner("file", ".csv").alias("protein_id"), F.col("line_no").alias("vix"), F.split("value", ",")[3].try_cast("double").alias("charge"))


def with_atom_keys(vertices: DataFrame) -> DataFrame:
    return vertices.withColumns(atom_key_parts("atom_key"))


def array_files(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """One-off ingest of array files into long rows: file, row, col, value. A file is one array of one protein.

    Object arrays (ragged lists) are pickles and are refused; such lists come in as tables.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def load(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(1, 1) if a.ndim == 0 else a.reshape(-1, 1) if a.ndim == 1 else a.reshape(a.shape[0], -1)
                r, c = np.indices(a.shape)
                yield pd.DataFrame({"file": name, "row": r.ravel(), "col": c.ravel(), "value": a.ravel().astype(float)})

    return raw.mapInPandas(load, "file string, row long, col long, value double")
