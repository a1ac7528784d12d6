"""Every library query against its oracle in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from lectern import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(v):
    return f"{v:.7g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(normal, r)) for r in df.select(columns).collect())
    want = sorted(tuple(map(normal, r)) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({plans.oracle_sql()[name]})").fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).limit(5).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
