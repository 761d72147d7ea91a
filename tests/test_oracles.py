"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
BUILDERS, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    same, note = compare(spark, con, key, BUILDERS[key], ORACLES[key], SF_DIR)
    assert same, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(BUILDERS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_foreign_keys_resolve(spark, sf):
    """The derivation of order_carts needs no customer join."""
    read = lambda name: spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
    orders, customer = read("orders"), read("customer")
    orphans = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left_anti")
    assert orphans.count() == 0
    assert customer.groupBy("c_custkey").count().where("count > 1").count() == 0
