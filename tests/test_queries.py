"""Every query of the catalogue against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tenderlake.plans.catalog import QUERIES
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    assert compare(spark, db, FOLDER, name) is None


def test_entry_has_rows(spark):
    assert not contract.entry(spark).isEmpty()


def test_sql_only_for_registered_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_imports_without_the_training_data_folders(tmp_path):
    root = Path(contract.__file__).parent
    hidden = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(root / "tenderlake", tmp_path / "tenderlake", ignore=hidden)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as c; print(len(c.queries()), len(c.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        assert int(done.stdout.split()[0]) == len(QUERIES)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
