"""The queries of the training-data operators against their SQL on the small tables."""

import collections
import math
import os

import duckdb
import pytest

from tracewell.llm import queries as library

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return tuple(sorted((k, norm(x)) for k, x in v.items())) if isinstance(v, dict) else v


def bag(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return collections.Counter(repr([norm(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_matches_sql(spark, sql, name):
    df = library.QUERIES[name](spark, SMALL)
    want = sql.execute(library.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert bag(map(tuple, df.collect()), df.columns) == bag(want.fetchall(), names)


