"""All named queries against their SQL, and the driver's entry points."""

import subprocess
import sys
from pathlib import Path

import pytest

from sievework.plans import catalogue

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(([repr(shown(v[i])) for i in order] for v in values), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, str(SF))
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_entry_works_without_the_operators():
    code = "import sys; sys.modules['sievework.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
