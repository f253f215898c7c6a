"""Every query with a DuckDB text gives the same rows as that text."""

import math

import duckdb
import pytest
from corvane.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def table(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, df.collect()) == table(columns, found.fetchall())


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["band", "measure", "n1", "n2", "u", "p", "p_adj"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
