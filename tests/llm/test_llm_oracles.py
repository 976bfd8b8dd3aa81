import duckdb
import pytest

from corvine.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall())
