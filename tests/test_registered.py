"""Every registered query against its SQL on the small test tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, oracle_connection

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert ok, text


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "weekly_return_wins_rank_sector_neutral" in df.columns


def test_chunk_coverage_reads_line_items_once(spark):
    """Line items are scanned once and not grouped by supplier and day; null entities and days outside count nowhere."""
    from crosspanel.operators.alignment import chunk_coverage
    from crosspanel.plans import catalogue
    found = catalogue.QUERIES["s15_chunk_coverage"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") and plan.count("Relation [l_orderkey") == 1
    assert "Aggregate [l_suppkey" not in plan
    rows = spark.sql("""select ticker, to_date(date) as date from values ('a', '2020-01-31'), ('a', '2020-01-31'),
                        ('b', '2019-01-01'), (null, '2020-02-01'), ('c', null) as t(ticker, date)""")
    got = chunk_coverage(rows, "2020-01-31", "2020-03-15", 1).select("ticker", "chunk_no", "n_rows").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(t, k, 2 if (t, k) == ("a", 1) else 0) for t in ("a", "b", "c", None) for k in (1, 2)], key=str)
