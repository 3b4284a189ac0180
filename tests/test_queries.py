"""Every query outside llm against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from weftline.jobs import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    r = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    order = [columns.index(c) for c in df.columns]
    assert sorted(map(key, df.collect())) == sorted(key([row[i] for i in order]) for row in r.fetchall())


def test_sizes_beyond_a_gigabyte(spark, tmp_path):
    sizes = [(1, 0), (2, 14), (3, 28), (1_000, 50), (28_340, 1), (283_399, 1), (29_019_874, 1), (29_019_876, 1), (1_199_999, 50), (10**12, 50), (10**15, 50), (None, 3), (7, None)]
    spark.createDataFrame(sizes, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(str, registry.QUERIES["human_sizes"](spark, str(tmp_path)).select("p_partkey", "size").collect()))
    own = duckdb.connect()
    own.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = own.execute(registry.ORACLE_SQL["human_sizes"]).fetchall()
    assert got == sorted(f"Row(p_partkey={k}, size={s!r})" for k, s in want) and "2118M" in {s for _, s in want}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
