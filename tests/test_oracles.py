"""Every query with a SQL twin gives the twin's rows."""

from pathlib import Path

import duckdb
import pytest

from corvine import queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    return sorted(tuple("NULL" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, str(DATA))
    names = sorted(got.columns)
    found = duck.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    assert rows(names, got.select(*names).collect()) == rows(names, found)
