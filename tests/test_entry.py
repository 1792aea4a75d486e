"""The driver's contract, and every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import registry


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{sf}/{name}')")
    return con


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_keys():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, sf, name):
    rows = registry.queries()[name](spark, sf)
    got = rows.collect()
    assert got
    if sql := registry.oracle_sql().get(name):
        want = duck.sql(sql)
        assert sorted(rows.columns) == sorted(want.columns)
        assert norm(rows.columns, got) == norm(want.columns, want.fetchall())


def test_without_the_optional_parts(tmp_path):
    """A copy without the training operators, and one where something they need is missing, still has every core query."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    want = f"{len(registry.queries())} {len(registry.oracle_sql())}"

    def count(folder):
        return subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout.strip()

    bare = tmp_path / "bare"
    shutil.copytree(root, bare, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert count(bare) == want
    (bare / "quillspark" / "llm").mkdir()
    (bare / "quillspark" / "llm" / "__init__.py").write_text("")
    (bare / "quillspark" / "llm" / "registry.py").write_text("import a_module_that_is_not_here\n")
    (bare / "corpus_pipeline.py").write_text("import quillspark.llm.registry\n")
    assert count(bare) == want
