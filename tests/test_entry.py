import math
import os

import pytest

import __spark_entry__ as entry


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v.replace(tzinfo=None)) if hasattr(v, "replace") and hasattr(v, "year") else str(v)


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.core.ORACLES))
def test_sql_agrees(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.core.QUERIES) - set(entry.core.ORACLES)))
def test_others_run(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_stands_without_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for f in [*root.glob("folioscope/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" not in f.parts:
            assert "folioscope.llm" not in f.read_text().replace("folioscope.llm" if f.name == "test_entry.py" else "\0", "")


def test_the_core_stands_when_the_llm_folders_are_deleted(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    code = "import __spark_entry__ as e, pkgutil, importlib, folioscope; [importlib.import_module(m.name) for m in pkgutil.walk_packages(folioscope.__path__, 'folioscope.')]; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith(('p2', 'p4', 'p5', 'p7', 'p8', 'p9')) for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, m, llm = out.stdout.split()[-3:]
    assert (int(n), int(m), llm) == (len(entry.core.QUERIES), len(entry.core.ORACLES), "False")
