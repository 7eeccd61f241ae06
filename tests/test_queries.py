"""Every query with SQL gives the rows DuckDB gives, on the small tables; queries without give rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from actaspark import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, db, name):
    df = core.QUERIES[name](spark, SF)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    cols = sorted(df.columns)
    mine = text([r[c] for c in cols] for r in df.collect())
    if name in core.SQL:
        r = db.execute(core.SQL[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == cols
        assert text([row[names.index(c)] for c in cols] for row in r.fetchall()) == mine


def test_entry(spark):
    assert entry.entry(spark).columns == ["ambito", "chiave", "campo", "difetto"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
