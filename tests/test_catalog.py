"""Every registered query against its SQL twin on the smallest test tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """The smallest tables need no eight-way shuffles."""
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(spark, con, key):
    df = QUERIES[key](spark, FOLDER)
    cur = con.execute(ORACLE[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, key):
    assert QUERIES[key](spark, FOLDER).count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["item_id", "channel", "recommended_warehouse", "horizon", "forecast_days",
                            "total_forecasted_demand", "safety_stock", "reorder_point", "eoq"]
    assert rows.count() > 0
