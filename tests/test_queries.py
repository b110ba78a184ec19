"""The engine's queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from lodestone import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def norm(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(str(round(v, 6) if isinstance(v, float) else None if v is None or v != v else v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    assert norm(catalog.QUERIES[name](spark, FOLDER).toPandas()) == norm(duck.sql(catalog.ORACLES[name]).df())
