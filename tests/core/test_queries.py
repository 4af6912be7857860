"""Every registered query of the engine against its SQL, and that the entry works without extras."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessella import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no test tables")


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = catalog.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    want = con.sql(catalog.ORACLE_SQL[name])
    places = [list(want.columns).index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in places) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(SF)).limit(5).count() > 0


def test_library_does_not_import_the_text_package():
    root = Path(__file__).resolve().parents[2]
    code = "import sys, tessella.catalog; assert not [m for m in sys.modules if m.startswith('tessella.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
