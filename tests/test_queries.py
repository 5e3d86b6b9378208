"""Every registered query with SQL gives the rows DuckDB gives."""

import math

import duckdb
import pytest

from tabulon.queries.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def oracle(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, oracle, name):
    df = QUERIES[name](spark, folder)
    names = sorted(df.columns)
    found = oracle.sql(ORACLES[name])
    assert names == sorted(found.columns)
    types = dict(zip(found.columns, map(str, found.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    order = [found.columns.index(c) for c in names]
    expected = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    assert ordered(rows) == ordered(expected)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
