"""Every query with SQL, against that SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from flowtide.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    if not Path(SF_DIR).exists():
        pytest.skip("the driver's tables are not here")
    c = duckdb.connect()
    for name in ("events", "lineitem"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return c


def plain(value) -> str:
    return f"{value + 0.0:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, SF_DIR)
    want = tables.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in want.columns) for r in got.collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "flowtide", tmp_path / "flowtide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "False"
