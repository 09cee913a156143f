"""The driver's contract, and that the library stands without its llm subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_own_queries_like_sql(spark):
    import duckdb

    from brooktext.plans import queries as own

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    for name, sql in own.oracle_sql().items():
        df = own.queries()[name](spark, DATA)
        cursor = con.execute(sql)
        columns = [d[0] for d in cursor.description]
        want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
        assert sorted(columns) == sorted(df.columns), name
        key = lambda r: repr([r[c] for c in sorted(columns)])
        assert sorted(key(r.asDict()) for r in df.collect()) == sorted(map(key, want)), name


def without_llm(to):
    """A copy of the repository without the folders of llm; corpus_pipeline.py stays."""
    for p in ("brooktext", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / p).exists():
            (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, to / p)
    shutil.rmtree(to / "brooktext/llm", ignore_errors=True)
    shutil.rmtree(to / "tests/llm", ignore_errors=True)


def ran(at, *command):
    return subprocess.run([sys.executable, *command], cwd=at, check=True, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True)


LEFT = "import __spark_entry__ as e; assert 'vocab_coverage' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"


def test_it_stands_without_llm(tmp_path):
    without_llm(tmp_path)
    ran(tmp_path, "-c", LEFT)
    ran(tmp_path, "-m", "pytest", "-q", "tests/test_functions.py", "tests/test_entry.py", "-k", "not without")


def test_it_stands_without_a_library_of_llm(tmp_path):
    without_llm(tmp_path)
    if not (ROOT / "brooktext/llm").exists():
        pytest.skip("llm has been removed")
    shutil.copytree(ROOT / "brooktext/llm", tmp_path / "brooktext/llm")
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not installed')\n")
    assert "left out" in ran(tmp_path, "-c", LEFT).stderr


def test_nothing_else_imports_llm():
    for p in (ROOT / "brooktext").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
