import os

import duckdb
import pytest

from quillmill.plans import catalog, catalog_more, catalog_store  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in found.collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    wanted = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in wanted.description]
    assert sorted(names) == sorted(found.columns)
    order = [found.columns.index(n) for n in names]
    assert sorted(map(repr, (tuple(r[k] for k in order) for r in rows))) == sorted(map(repr, wanted.fetchall()))
