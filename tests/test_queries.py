"""Every query that has SQL, against DuckDB; the others must run and keep their schema."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.oracle import SMALL, check
from trailmark import plans

ORACLES, QUERIES = plans.oracle_sql(), plans.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_entry_without_the_optional_parts(tmp_path):
    """The rest is imported and listed with the training-data folders gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/trailmark", tmp_path / "trailmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in os.listdir(root):
        if name.endswith(".py"):
            shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "False"], out.stderr
