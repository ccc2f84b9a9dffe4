"""Workers need not have the package on their path."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from facetry.functions.geometry import rotation_from_uniforms
from facetry.operators import filters, sampling
from facetry.session import checkpoint_root
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from facetry.catalog import QUERIES
print("ROWS", QUERIES["superposition"](spark, "/root/testdata/sf0.001").count())
"""


def test_udf_query_from_another_folder(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "ROWS 10" in run.stdout, run.stderr[-2000:]


def test_checkpoint_folder_is_asked_for_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_rotations_are_proper_and_even(spark):
    df = spark.range(4000).select(*[F.rand(i).alias(f"u{i}") for i in (1, 2, 3)])
    r = rotation_from_uniforms("u1", "u2", "u3")
    p = df.select(*[v.alias(k) for k, v in r.items()]).toPandas()
    import numpy as np

    m = p[[f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]].to_numpy().reshape(-1, 3, 3)
    assert np.allclose(np.linalg.det(m), 1) and np.allclose(m @ m.transpose(0, 2, 1), np.eye(3), atol=1e-9)
    assert np.abs(m.mean(axis=0)).max() < 0.05  # no direction is preferred


def test_split_cover_is_asserted(spark):
    ids = spark.range(5).select(F.col("id").cast("string").alias("p"))
    lst = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    sampling.assert_split_covers(ids, "p", lst("0", "1", "2"), lst("3", "4"))
    with pytest.raises(ValueError, match="1 ids on neither list, 1 on both"):
        sampling.assert_split_covers(ids, "p", lst("0", "1"), lst("1", "3", "4"))


def test_ligand_of_another_chain_and_all_nucleotides(spark):
    atoms = spark.createDataFrame([("A", " ", "ALA"), ("B", "H", "LIG"), ("C", "H", "LIG"), ("A", "H", "DU"), ("A", "H", "HOH")], "chain string, hetflag string, resname string")
    got = filters.chain_atoms(atoms, ["A"], ligand="LIG", ligand_chain="B", nucleotides=True).collect()
    assert sorted((r["chain"], r["resname"]) for r in got) == [("A", "ALA"), ("A", "DU"), ("B", "LIG")]
