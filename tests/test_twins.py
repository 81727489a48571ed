"""Every query with a DuckDB twin gives the same rows on the given tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES, TWINS = contract.queries(), contract.oracle_sql()


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return round(float(value), 9)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(TWINS))
def test_twin(key, spark, sf_dir, duck):
    frame = QUERIES[key](spark, sf_dir)
    answer = duck.execute(TWINS[key])
    names = [d[0] for d in answer.description]
    assert sorted(frame.columns) == sorted(names)
    assert _rows(frame.columns, frame.collect()) == _rows(names, answer.fetchall())
