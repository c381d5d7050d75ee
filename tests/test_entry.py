"""The catalog over the small tables, held against its SQL in DuckDB, and the import without the llm folders."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from strandwise.plans import registry  # noqa: E402


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else f"{v:.9g}"
        return f"{v:.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    rows = got.collect()
    assert rows
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert plain(rows, got.columns) == plain(want.fetchall(), names)


def test_entry_works_without_the_llm_folders(tmp_path):
    ignore = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "tests")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_search_threshold' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, check=True)
