import importlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from placebook import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    importlib.reload(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, sf, name):
    got = catalog.queries()[name](spark, sf)
    con = duckdb.connect()
    for table in ("customer", "nation", "orders", "events", "lineitem", "part"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    tidy = lambda rows: sorted(repr(tuple(float(x) if isinstance(x, float) else x for x in r)) for r in rows)
    assert tidy(rows) == tidy(want)


CODE = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), [k for k in q if k[:2] == 'op' or k == 'pipeline'])"


def listed(folder):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
    return done.stdout.strip()


def test_without_the_llm_folders(tmp_path):
    """The rest imports, lists its queries and passes its tests where the training-data parts are gone."""
    for folder in ("placebook", "tests"):
        shutil.copytree(f"{ROOT}/{folder}", tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    assert listed(tmp_path).split(" ", 1) == [str(len(catalog.queries())), "[]"]
    shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    assert listed(tmp_path).endswith("[]")
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests", "-k", "not without_the_llm and not cannot_be_imported and not equals_oracle"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1500)
    assert done.returncode == 0, done.stdout[-800:]


def test_with_an_llm_folder_that_cannot_be_imported(tmp_path):
    shutil.copytree(f"{ROOT}/placebook", tmp_path / "placebook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    (tmp_path / "placebook/llm").mkdir()
    assert listed(tmp_path).endswith("[]")
    (tmp_path / "placebook/llm/__init__.py").write_text("import a_module_that_is_not_there\n")
    assert listed(tmp_path).endswith("[]")
