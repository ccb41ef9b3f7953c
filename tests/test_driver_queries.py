"""Every registered query that has SQL gives DuckDB's rows, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, tables, name):
    df = entry.queries()[name](spark, str(DATA))
    found = tables.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert canonical(df.columns, map(tuple, df.collect())) == canonical(found.columns, found.fetchall())


def test_every_relational_query_has_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {q for q in queries if not q.startswith("op") and q != "pipeline"} <= set(sql)
