"""Every registered query against its check SQL, at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from factloom.plans.catalog import QUERIES
from factloom.plans.checks import check_sql
from tools.compare import compare, database

FOLDER = "/root/testdata/sf0.001"


def test_contract_functions(spark):
    assert set(check_sql()) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.fixture(scope="module")
def checks():
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    return database(FOLDER), check_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_check(spark, checks, name):
    connection, sql = checks
    outcome = compare(spark, connection, FOLDER, name, QUERIES[name], sql[name])
    assert outcome.endswith(" ok"), outcome


def test_row_counts_do_not_depend_on_partitions(spark):
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    counts = []
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        counts.append(sorted(map(tuple, contract.entry(spark).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert counts[0] == counts[1]
