import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from tessera.plans import catalogue

from .oracle import SF, compare


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_recall_rises_with_probes(spark):
    rows = catalogue.QUERIES["ivf_recall_curve"](spark, SF).orderBy("probes").collect()
    curve = [r["recall"] for r in rows]
    assert curve == sorted(curve) and curve[-1] == 1.0
    assert [r["recall"] >= 0.9 for r in rows if r["fitted"]] == [True]


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    said = "import __spark_entry__ as e; assert set(e.queries()) == set(e.catalogue.QUERIES) and set(e.oracle_sql()) <= set(e.queries()); import bench"
    for _ in range(2):
        subprocess.run([sys.executable, "-B", "-c", said], cwd=tmp_path / "copy", check=True, timeout=120)
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
    (tmp_path / "copy" / "tessera" / "llm").mkdir()
    (tmp_path / "copy" / "tessera" / "llm" / "queries.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-B", "-c", said], cwd=tmp_path / "copy", stderr=subprocess.DEVNULL, timeout=120).returncode
