"""Every registered query on the small tables; those with SQL are compared value by value."""

import pytest

import __spark_entry__ as entry
from checks.run import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connection, name):
    assert compare(QUERIES[name](spark, FOLDER), ORACLES[name], connection) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["z3_annual_totals", "e10_empirical_cdf", "f3_pixel_split",
                                  "g3_dense_pixel_id"])
def test_same_result_for_other_partitioning(spark, connection, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert compare(QUERIES[name](spark, FOLDER), ORACLES[name], connection) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
