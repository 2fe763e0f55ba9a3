"""Every query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from ledgerfold.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (bytearray, bytes)):
        return bytes(v)
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = sorted(([norm(r[c]) for c in sorted(got.columns)] for r in got.collect()), key=key)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert rows == sorted(([norm(r[i]) for i in order] for r in want.fetchall()), key=key)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_flagship_counts(spark, sf_dir):
    assert QUERIES["live_scan"](spark, sf_dir).count() == 62
    assert QUERIES["fold_latest"](spark, sf_dir).count() == 83
    assert QUERIES["stale_keys"](spark, sf_dir).count() == 34


def test_prefix_and_cursor_reach_the_scan(spark, tmp_path):
    from ledgerfold.functions.scope import Scope
    from ledgerfold.operators import fold as ops

    spark.createDataFrame([(1, "a.b", "PUT", b"x", None, 1)], "revision long, key string, op string, value binary, version binary, arrival long").write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    assert "StringStartsWith(key,a.)" in ops.fold(log, Scope.prefix("a."))._jdf.queryExecution().toString()
    assert "GreaterThan(revision,5)" in ops.delta(log, 5)._jdf.queryExecution().toString()
    assert "value:" not in ops.stale_keys(log, log)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
