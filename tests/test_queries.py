"""Every query with SQL against another engine, on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from pagewright.plans.queries import ORACLE, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(x):
        return round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sql, folder, name):
    df = QUERIES[name](spark, folder)
    got = sql.execute(ORACLE[name])
    columns = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
