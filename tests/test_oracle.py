"""Every registered query against plain SQL on the smallest test tables."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
         "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF_DIR)
    names = sorted(df.columns)
    rows = Counter(tuple(r[n] for n in names) for r in df.collect())
    assert rows
    if name not in entry.oracle_sql():
        return
    result = sql.execute(entry.oracle_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    types = {d[0]: str(d[1]) for d in result.description}
    assert {n: TYPES[t] for n, t in df.dtypes} == types
    places = [found.index(n) for n in names]
    assert rows == Counter(tuple(r[i] for i in places) for r in result.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
