"""Every core query that has SQL gives the same rows in DuckDB over the driver's tables."""

import os

import pytest

import __spark_entry__ as entry
from larder.plans import queries as core

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value) if not isinstance(value, (bool, int)) else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("the driver's tables are not here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({core.SQL[name]})").fetchall()
    assert got == sorted(str(tuple(map(plain, r))) for r in want)


def test_entry_and_registry(spark):
    if os.path.isdir(DIR):
        assert entry.entry(spark).columns == ["key", "gen", "pos", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "visible_state" in entry.queries()
