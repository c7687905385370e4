"""Every registered query of the engine against its SQL."""

import duckdb
import pytest
from oracle import TABLES, rows_of

from codelode.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_plans(spark):
    """Columns are pruned and filters reach the scan; queries stay in compiled stages without Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = QUERIES["hybrid_filtered"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)" in plan and "n_chars" not in plan.split("== Optimized Logical Plan ==")[1].split("ReadSchema")[1].split("\n")[0]
    assert docs.columns and "Python" not in plan
