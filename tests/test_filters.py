import datetime as dt

from pyspark.sql import functions as F

from garbline.functions.bands import band
from garbline.functions.text import dash_if_empty, excerpt, reason_label, status_label, words_label
from garbline.operators import filters as flt
from garbline.operators import joins
from tests.data import at, rows, table, tables

CARTS = [
    {"id": 1, "supervisor_id": 7, "status": "created", "created_at": at("2024-05-01 00:00:00")},
    {"id": 2, "supervisor_id": 7, "status": "completed", "created_at": at("2024-05-02 00:00:00")},
    {"id": 3, "supervisor_id": 8, "status": "packed", "created_at": at("2024-05-31 00:00:00")},
    {"id": 4, "supervisor_id": 8, "status": "submitted", "created_at": at("2024-05-31 09:30:00")},
    {"id": 5, "supervisor_id": 8, "status": "cancelled", "created_at": at("2024-06-01 00:00:00")},
]


def ids(df):
    return [r[0] for r in rows(df, "id")]


def test_order_filter(spark):
    carts = table(spark, "order_carts", CARTS)
    assert ids(flt.filter_orders(carts)) == [1, 3, 4, 5]
    assert ids(flt.filter_orders(carts, hide_sent=False)) == [1, 2, 3, 4, 5]
    assert ids(flt.filter_orders(carts, status="completed")) == [2]
    # A bare end date is its midnight: the order later that day drops out.
    assert ids(flt.filter_orders(carts, end="2024-05-31", hide_sent=False)) == [1, 2, 3]
    assert ids(flt.filter_orders(carts, start=dt.date(2024, 5, 31))) == [3, 4, 5]
    assert ids(flt.filter_orders(carts, supervisor=8, status="packed")) == [3]


def test_visibility(spark):
    carts = table(spark, "order_carts", CARTS)
    assert ids(flt.visible_orders(carts, 7, "supervisor", supervisor=8)) == [1, 2]
    assert ids(flt.visible_orders(carts, -1, "admin", supervisor=8)) == [3, 4, 5]
    assert ids(flt.visible_orders(carts, -2, "packer", supervisor=8)) == [1, 2, 3, 4, 5]


def test_cancellable(spark):
    carts = table(spark, "order_carts", CARTS)
    assert ids(flt.cancellable(carts, -1, "admin", "list")) == [1, 4]
    assert ids(flt.cancellable(carts, -1, "admin", "handler")) == [1, 4, 5]
    assert ids(flt.cancellable(carts, 7, "supervisor", "handler")) == [1]
    assert ids(flt.cancellable(carts, -2, "packer", "list")) == []


def test_search_is_literal(spark):
    products = table(
        spark,
        "products",
        [
            {"id": "a", "name": "Red 100% cotton", "article_number": "X_1"},
            {"id": "b", "name": "Blue", "article_number": None},
            {"id": "c", "name": "100 cotton", "article_number": "X11"},
        ],
    )
    found = lambda text: ids(flt.search_products(products, text))
    assert found("100%") == ["a"]
    assert found("x_1") == ["a"]
    assert found("RED") == ["a"]
    assert found("  ") == found(None) == ["a", "b", "c"]


def test_low_stock_and_availability(spark):
    t = tables(
        spark,
        products=[{"id": "p", "name": "P"}, {"id": "q", "name": "Q"}, {"id": "r", "name": "R"}],
        product_sizes=[
            {"id": 1, "product_id": "p", "size": "S", "stock": 0},
            {"id": 2, "product_id": "p", "size": "M", "stock": 2},
            {"id": 3, "product_id": "p", "size": "L", "stock": 1},
            {"id": 4, "product_id": "q", "size": "S", "stock": 0},
            {"id": 5, "product_id": "p", "size": "XL", "stock": 3},
        ],
    )
    shown = [r["sku_id"] for r in flt.low_stock(t.product_sizes, t.products).collect()]
    assert shown == [3, 2]
    risk = [r["sku_id"] for r in flt.low_stock(t.product_sizes, t.products, include_zero=True).collect()]
    assert risk == [1, 4, 3, 2]
    assert flt.low_stock_count(t.product_sizes).first()[0] == 4
    assert rows(flt.out_of_stock_products(t.products, t.product_sizes), "product_id") == [("q",)]
    assert ids(flt.orderable_skus(t.product_sizes)) == [2, 3, 5]


def test_bands(spark):
    values = spark.createDataFrame([(v,) for v in (5, 6, 15, 16, None)], "v INT")
    got = [r[0] for r in values.select(band(F.col("v"), [5, 15], ["critical", "warning", "ok"])).collect()]
    assert got == ["critical", "warning", "warning", "ok", None]
    days = spark.createDataFrame([(13,), (14,)], "v INT")
    got = [r[0] for r in days.select(band(F.col("v"), [14], ["critical", "warning"], upper_closed=False)).collect()]
    assert got == ["critical", "warning"]


def test_garment_state(spark):
    garments = table(
        spark,
        "user_uniforms",
        [{"product_size_id": i, "status": s} for i, s in enumerate(
            ["active", "issued", "", None, "lost", "returned_worn_out", "returned_returned_x"])],
    )
    team = rows(flt.garment_state(garments, "team"), "product_size_id", "returned", "return_reason")
    assert [r[1] for r in team] == [False, True, True, True, True, True, True]
    assert [r[2] for r in team] == ["active", "issued", "", "", "lost", "worn_out", "x"]
    history = rows(flt.garment_state(garments, "history"), "product_size_id", "returned")
    assert [r[1] for r in history] == [False, False, False, False, True, True, True]
    assert rows(flt.returnable(garments), "product_size_id") == [(0,)]


def test_labels(spark):
    df = spark.createDataFrame([("completed", "worn_out"), ("packed", "too_small"), ("created", None)], "s STRING, r STRING")
    assert [r[0] for r in df.select(status_label(F.col("s"))).collect()] == ["Sent", "Packed", "Created"]
    assert [r[0] for r in df.select(reason_label(F.col("r"))).collect()] == ["Worn out", "Too Small", "Other"]
    assert [r[0] for r in df.select(words_label(F.col("r"))).collect()] == ["Worn Out", "Too Small", None]
    assert [r[0] for r in df.select(dash_if_empty(F.col("r"))).collect()] == ["worn_out", "too_small", "-"]
    long = spark.createDataFrame([("x" * 201,), ("y" * 200,)], "c STRING")
    assert [r[0] for r in long.select(excerpt(F.col("c"))).collect()] == ["x" * 200 + "…", "y" * 200]


DELEGATIONS = [
    {"id": 1, "from_supervisor_id": 1, "to_supervisor_id": 2, "start_date": dt.date(2024, 5, 1), "end_date": dt.date(2024, 5, 5)},
    {"id": 2, "from_supervisor_id": 3, "to_supervisor_id": 1, "start_date": dt.date(2024, 5, 5), "end_date": dt.date(2024, 5, 9)},
    {"id": 3, "from_supervisor_id": 3, "to_supervisor_id": 2, "start_date": dt.date(2024, 6, 1), "end_date": dt.date(2024, 6, 9)},
    {"id": 4, "from_supervisor_id": 1, "to_supervisor_id": 2, "start_date": dt.date(2024, 1, 1), "end_date": dt.date(2024, 5, 4)},
]


def test_delegations(spark):
    day = dt.date(2024, 5, 5)
    d = table(spark, "supervisor_delegations", DELEGATIONS)
    assert ids(flt.active_delegations(d, day)) == [1, 2]
    flags = rows(d.withColumn("flag", flt.delegation_flag(day)), "id", "flag")
    assert flags == [(1, "Active"), (2, "Active"), (3, "Active"), (4, "Expired")]
    team = table(
        spark,
        "team_members",
        [{"id": 10, "supervisor_id": 1, "full_name": "a"}, {"id": 20, "supervisor_id": 2, "full_name": "b"},
         {"id": 30, "supervisor_id": 3, "full_name": "c"}],
    )
    pairs = rows(joins.effective_team(team, d, day), "acting_id", "team_member_id")
    # Not transitive: 2 acts for 1, 1 acts for 3, but 2 does not act for 3.
    assert pairs == [(1, 10), (1, 30), (2, 10), (2, 20), (3, 30)]
    assert rows(joins.effective_team(team, d, day, supervisor=2), "team_member_id") == [(10,), (20,)]
    users = table(
        spark, "users",
        [{"id": i, "system_role": "supervisor", "full_name": f"u{i}"} for i in (1, 2, 3)] + [{"id": -1, "system_role": "admin"}],
    )
    authority = joins.authority_pairs(users, d, day)
    asked = spark.createDataFrame([(1, 1), (1, 3), (2, 3), (-1, 3), (3, 1), (9, 9)], "actor_id BIGINT, supervisor_id BIGINT")
    assert rows(joins.may_act(asked, authority)) == [(-1, 3), (1, 1), (1, 3), (9, 9)]
    incoming = joins.delegations_in(d, users, day, me=1)
    assert rows(incoming, "id", "owner_name") == [(2, "u3")]
    assert [r["id"] for r in joins.delegations_out(d, users, me=1).collect()] == [1, 4]


def test_directories(spark):
    users = table(
        spark, "users",
        [{"id": 1, "full_name": "b", "system_role": "supervisor"}, {"id": 2, "full_name": "a", "system_role": "supervisor"},
         {"id": 3, "full_name": "c", "system_role": "packer"}],
    )
    assert [r["id"] for r in flt.directory(users, "supervisor").collect()] == [2, 1]
    assert ids(flt.directory(users, "supervisor", exclude_id=2)) == [1]
    roles = table(spark, "job_roles", [{"id": 1, "name": "X"}, {"id": 6, "name": "Everyone"}, {"id": 7, "name": "Packer"}])
    assert ids(flt.assignable_roles(roles)) == [1]
    assert ids(flt.assignable_roles(roles, ("Everyone",))) == [1, 7]
    team = table(spark, "team_members", [{"id": 1, "supervisor_id": 1, "full_name": "z"}, {"id": 2, "supervisor_id": 2, "full_name": "y"}])
    assert ids(flt.workers_of(team, [1])) == [1]
    assert [r["id"] for r in flt.workers_of(team).collect()] == [2, 1]
