import duckdb
import pytest

from ledgerfold.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[n] for n in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_names():
    assert list(QUERIES) == sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) and len(QUERIES) == 10
