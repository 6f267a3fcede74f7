"""Every query with SQL of its own gives the rows of that SQL, over the smallest tables."""

import importlib
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tesseral import queries as reference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        path = f"{SF}/{name}" + ("/*.parquet" if os.path.isdir(f"{SF}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(frame):
    def one(v):
        if isinstance(v, (list, np.ndarray)):
            return str([one(x) for x in v])
        if v is None or v != v:
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(reference.ORACLES))
def test_like_sql(spark, duck, name):
    assert shown(reference.QUERIES[name](spark, SF).toPandas()) == shown(duck.execute(reference.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(reference.QUERIES) - set(reference.ORACLES)))
def test_runs(spark, name):
    rows = reference.QUERIES[name](spark, SF).count()
    assert rows > 0 or name == "bootstrap_ci"  # no group has 20 rows here


def test_entry(spark):
    importlib.reload(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(reference.QUERIES) >= 80
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(f"{root}/tesseral"):
        if "/llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(f"{folder}/{n}").read(), n


def test_without_the_subpackage(tmp_path):
    """With its folders gone, and the pipeline there or gone too, the entry gives the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    say = "import __spark_entry__ as e; print('NAMES', len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"
    for gone in (None, "corpus_pipeline.py"):
        if gone:
            (tmp_path / "r" / gone).unlink(missing_ok=True)
        out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path / "r", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
        assert f"NAMES {len(reference.QUERIES)} {len(reference.ORACLES)} []" in out.stdout
