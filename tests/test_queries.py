"""Every query against its DuckDB statement on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
registry.queries()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {Path(path).stem} as select * from '{path}'")
    return con


def rows(frame, columns):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return round(v, 6)
        return str(v) if hasattr(v, "isoformat") else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n, q in registry.QUERIES.items() if q.sql])
def test_query_agrees_with_sql(spark, con, name):
    ours = registry.queries()[name](spark, DATA).toPandas()
    theirs = con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert rows(ours, columns) == rows(theirs, columns)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
