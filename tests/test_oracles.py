"""Every registered query against its SQL on the small tables, and the contract of the entry module."""

import collections
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracewell.plans import queries as library

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


def test_format_utc_tells_every_event(spark, tmp_path):
    ids = [-1, 0, 10_006, 10_007, 11_871, 14_065, 599_999, 5_999_999, 36_000_000, 2**63 - 1]
    days = F.when(F.col("event_id") % 2 == 0, "2024-01-05 00:00:00.000001").otherwise("2262-04-11 00:00:00").cast("timestamp_ntz")
    spark.createDataFrame([(i,) for i in ids], "event_id long").withColumn("ts", days).write.parquet(f"{tmp_path}/events.parquet")
    df = library.QUERIES["format_utc"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want, got = con.execute(library.ORACLES["format_utc"]), df.collect()
    assert bag(map(tuple, got), df.columns) == bag(want.fetchall(), [d[0] for d in want.description])
    assert len(got) == len(ids) and all(r["text"] and r["parsed"] == r["ns"] for r in got)


def test_entry_points(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(library.QUERIES) == set(library.ORACLES)
    assert __spark_entry__.entry(spark).count() == 5
