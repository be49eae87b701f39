import duckdb
import pytest

from tidemill.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        a, b = (sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).values.tolist())) for x in (got, want))
        assert a == b
