import os

import duckdb
import pytest

from pairloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    return None if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = con.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        at = [want.columns.index(c) for c in df.columns]
        assert sorted([tuple(map(norm, r)) for r in rows], key=repr) == sorted([tuple(norm(r[i]) for i in at) for r in want.fetchall()], key=repr)
