"""Queries over tables where one key of each kind holds a third of the rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from tests.skewed import write_skewed

BUILDERS, ORACLES = entry.queries(), entry.oracle_sql()
KEYS = [
    "cart_coalesce", "checkout_stock", "order_list", "products_with_sizes", "recent_orders", "returns_report",
    "stream_status", "team_garments_recent", "wide_order_lines", "worker_history",
]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("skewed"))
    write_skewed(spark, target, "/root/testdata/sf0.001")
    return target


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle_on_skewed_tables(spark, skewed, key):
    same, note = compare(spark, connect(skewed), key, BUILDERS[key], ORACLES[key], skewed)
    assert same, note
