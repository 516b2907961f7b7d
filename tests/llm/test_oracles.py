"""Every training-data query against its DuckDB oracle at the smallest scale."""

import glob
import os
from collections import Counter

import pytest

from rasterloom.llm import oracles, queries
from tests.test_oracles import DIR, key

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(key(r[c]) for c in cols) for r in df.collect())
    if name not in oracles.ORACLES:
        assert sum(got.values()) >= 0
        return
    want = duck.sql(oracles.ORACLES[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    assert got == Counter(tuple(key(r[i]) for i in at) for r in want.fetchall())


def test_every_oracle_has_its_query():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
