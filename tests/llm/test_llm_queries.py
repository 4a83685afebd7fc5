"""Every query with SQL against another engine, on the smallest tables; the others run."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from pagewright.llm.queries import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, folder, name):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, folder)
    got = con.execute(ORACLE[name])
    columns = [x[0] for x in got.description]

    def value(x):
        return round(x, 9) if isinstance(x, float) else x

    assert sorted(df.columns) == sorted(columns)
    expected = sorted((tuple(map(value, r)) for r in got.fetchall()), key=repr)
    assert sorted((tuple(map(value, r)) for r in df.select(columns).collect()), key=repr) == expected and expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.count() > 0
    if name.endswith("_found"):
        assert df.count() == df.distinct().count()
