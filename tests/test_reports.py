import datetime as dt
import random
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from garbline.functions.spread import join_reduced, join_spread_nulls, number_rows, place_in_group, sum_before
from garbline.operators import joins, nested, reports
from garbline.plans import pages
from tests.data import at, rows, table, tables

D = Decimal


def test_team_without_sizes_keeps_nulls(spark):
    t = tables(
        spark,
        team_members=[{"id": 1, "supervisor_id": 1, "full_name": "a"}, {"id": 2, "supervisor_id": 1, "full_name": "b"}],
        worker_sizes=[{"team_member_id": 1, "product_type": "PANTS", "size": "44"}],
    )
    got = rows(reports.team_sizes(t.team_members, t.job_roles, t.worker_sizes), "id", "shirt_size", "pants_size", "shoe_size")
    assert got == [(1, None, "44", None), (2, None, None, None)]


def test_reorder_skips_unsold_and_sizeless(spark):
    t = tables(
        spark,
        products=[{"id": "p", "name": "P"}, {"id": "none", "name": "N"}],
        product_sizes=[
            {"id": 1, "product_id": "p", "size": "S", "stock": 4},
            {"id": 2, "product_id": "p", "size": "M", "stock": 4},
            {"id": 3, "product_id": "p", "size": "L", "stock": 10},
        ],
        order_items=[
            {"cart_id": 1, "product_size_id": 1, "quantity": 10},
            {"cart_id": 2, "product_size_id": 3, "quantity": 10},
        ],
    )
    got = rows(reports.reorder_suggestions(t), "sku_id", "monthly_usage", "days_remaining", "suggested_reorder", "days_band")
    assert got == [(1, 10, 12, 16, "critical")]


def test_days_follow_28_digit_decimals(spark):
    pairs = [(stock, sold) for sold in range(1, 61) for stock in range(0, sold)]
    df = spark.createDataFrame(pairs, "stock INT, sold BIGINT")
    got = df.select("stock", "sold", reports.days_of_stock(F.col("stock"), F.col("sold")).alias("d")).collect()
    for stock, sold, days in got:
        assert days == int((stock / D(sold)) * 30), (stock, sold)


def test_dashboard(spark):
    t = tables(
        spark,
        users=[
            {"id": 1, "full_name": "a", "system_role": "supervisor", "monthly_budget": D("100.00")},
            {"id": 2, "full_name": "b", "system_role": "supervisor", "monthly_budget": D("0.00")},
            {"id": 3, "full_name": "c", "system_role": "supervisor"},
        ],
        order_carts=[
            {"id": 1, "supervisor_id": 1, "status": "packed", "total_price": D("80.00"), "created_at": at("2024-05-31 23:59:59")},
            {"id": 2, "supervisor_id": 1, "status": "submitted", "total_price": D("99.00"), "created_at": at("2024-05-02")},
            {"id": 3, "supervisor_id": 1, "status": "completed", "total_price": D("9.00"), "created_at": at("2024-06-01")},
            {"id": 4, "supervisor_id": 2, "status": "completed", "total_price": D("9.00"), "created_at": at("2024-05-02")},
        ],
    )
    got = {r["supervisor_id"]: r for r in reports.supervisor_dashboard(t, dt.date(2024, 5, 15)).collect()}
    assert (got[1]["used"], got[1]["remaining"], got[1]["budget_band"], got[1]["active_orders"]) == (80.0, 20.0, "amber", 2)
    assert (got[2]["budget"], got[2]["used"], got[2]["used_percent"]) == (None, 0.0, None)
    assert got[3]["budget_band"] is None
    usage = dict(rows(reports.budget_usage(t.order_carts, t.users, dt.date(2024, 5, 15)), "supervisor_id", "used"))
    assert usage == {1: 80.0, 2: 9.0, 3: 0.0}


def test_order_list_names(spark):
    t = tables(
        spark,
        users=[{"id": 1, "full_name": "Boss", "system_role": "supervisor"}],
        team_members=[{"id": 1, "full_name": "Ann"}, {"id": 2, "full_name": "Bob"}, {"id": 3, "full_name": "Bob"}],
        order_carts=[{"id": 1, "supervisor_id": 1, "team_member_id": 1}, {"id": 2, "supervisor_id": 1}, {"id": 3, "supervisor_id": 1}],
        order_items=[
            {"cart_id": 1, "team_member_id": 2}, {"cart_id": 2, "team_member_id": 3}, {"cart_id": 2, "team_member_id": 2},
            {"cart_id": 2, "team_member_id": 1}, {"cart_id": 2, "team_member_id": None},
        ],
    )
    listed = reports.order_list(t)
    got = rows(listed, "id", "worker_name", "item_count", "worker_count")
    assert got == [(1, "Ann", 1, 1), (2, "Ann", 4, 3), (3, None, 0, 0)]
    assert rows(reports.order_workers(t)) == [(1, 2, "Bob"), (2, 1, "Ann"), (2, 2, "Bob"), (2, 3, "Bob")]
    asked = t.order_carts.where("id = 2").select(F.col("id").alias("cart_id"))
    assert rows(reports.order_workers(t, asked), "worker_id") == [(1,), (2,), (3,)]
    assert [r["id"] for r in reports.sort_orders(listed, "id", "asc").collect()] == [1, 2, 3]
    assert [r["id"] for r in reports.sort_orders(listed, "drop table", "asc").collect()] == [3, 2, 1]


def test_unread_and_feed(spark):
    t = tables(
        spark,
        users=[{"id": 1, "full_name": "s", "system_role": "supervisor"}, {"id": 2, "full_name": "p", "system_role": "packer"}],
        news_posts=[
            {"id": 1, "created_by": 1, "target_role": "all", "created_at": dt.date(2024, 1, 1)},
            {"id": 2, "created_by": 9, "target_role": "supervisor", "pinned": 1, "created_at": dt.date(2023, 1, 1)},
            {"id": 3, "created_by": 1, "target_role": "packer", "created_at": dt.date(2024, 3, 1)},
            {"id": 4, "created_by": 1, "target_role": "all", "pinned": 0, "created_at": dt.date(2024, 2, 1)},
        ],
        news_reads=[{"post_id": 1, "user_id": 1}, {"post_id": 3, "user_id": 1}, {"post_id": 3, "user_id": 2}],
        news_likes=[{"post_id": 1, "user_id": 1}, {"post_id": 1, "user_id": 2}],
        news_comments=[{"id": 1, "post_id": 1, "user_id": 2, "comment": "x", "created_at": at("2024-01-03")},
                       {"id": 2, "post_id": 1, "user_id": 1, "comment": "y", "created_at": at("2024-01-02")},
                       {"id": 3, "post_id": 1, "user_id": 99, "comment": "unknown author", "created_at": at("2024-01-02")}],
    )
    assert rows(joins.unread_posts(t.news_posts, t.news_reads, 1, "supervisor"), "id") == [(2,), (4,)]
    counts = rows(joins.unread_counts(t.news_posts, t.news_reads, t.users), "user_id", "unread_news_count")
    assert counts == [(1, 2), (2, 2)]
    feed = pages.news_feed_nested(t, 1, "supervisor").collect()
    assert [r["id"] for r in feed] == [2, 4, 1]
    assert [(r["is_read"], r["user_liked"], r["like_count"], r["comment_count"]) for r in feed][2] == (True, True, 2, 2)
    assert [c["comment"] for c in feed[2]["comments"]] == ["y", "x"]
    assert feed[0]["comments"] == []


def test_catalogue_rules(spark):
    t = tables(
        spark,
        products=[{"id": "a", "name": "A", "article_number": "1", "type": "Shirt"}, {"id": "b", "name": "B", "article_number": "2"},
                  {"id": "c", "name": "C", "article_number": "3"}],
        product_sizes=[{"id": 1, "product_id": "a", "size": "S", "stock": 2}],
        product_job_roles=[{"product_id": "a", "job_role_id": 1}, {"product_id": "b", "job_role_id": 6}],
        job_roles=[{"id": 1, "name": "X"}, {"id": 6, "name": "Everyone"}],
        worker_sizes=[{"team_member_id": 5, "product_type": "SHIRT", "size": "S"}],
    )
    shown = lambda **k: [r["id"] for r in pages.catalogue(t, **k).collect()]
    assert shown(role="admin") == ["a", "b", "c"]
    assert shown(role="supervisor", job_role=1) == ["a"]
    assert shown(role="worker", viewer_role_id=1) == ["a", "b"]
    assert shown(role="worker", viewer_role_id=None) == ["b"]
    row = pages.catalogue(t, "supervisor", worker=5, worker_role=1).first()
    assert (row["recommended_size"], row["eligible"], row["size_count"]) == ("S", True, 1)
    full = {r["id"]: r for r in pages.catalogue_nested(t, "admin").collect()}
    assert [tuple(s) for s in full["a"]["sizes"]] == [(1, "S", 2)]
    assert (full["a"]["role_ids"], full["c"]["sizes"], full["c"]["role_ids"]) == ([1], [], [])


def test_history_counts_copies(spark):
    t = tables(
        spark,
        products=[{"id": "p", "name": "P"}],
        product_sizes=[{"id": 1, "product_id": "p", "size": "S"}],
        order_carts=[{"id": 1, "status": "completed"}, {"id": 2, "status": "packed"}],
        order_items=[{"cart_id": 1, "product_size_id": 1, "team_member_id": 4, "quantity": 2}] * 2
        + [{"cart_id": 2, "product_size_id": 1, "team_member_id": 5, "quantity": 1}],
        user_uniforms=[{"product_size_id": 1, "team_member_id": 4, "status": s} for s in ("active", "active", "returned_lost")],
    )
    got = rows(joins.worker_history(t), "team_member_id", "uniform_status", "returned", "copies")
    # Each of worker 4's two lines meets three garments: six rows, in two counted rows per line.
    assert got == [(4, "active", False, 2)] * 2 + [(4, "returned_lost", True, 1)] * 2 + [(5, None, False, 1)]
    assert joins.worker_history(t, worker=5).count() == 1


def test_returns_report_one_row_per_garment(spark):
    t = tables(
        spark,
        products=[{"id": "p", "name": "P"}],
        product_sizes=[{"id": 1, "product_id": "p", "size": "S"}],
        order_items=[{"cart_id": c, "product_size_id": 1, "team_member_id": 4} for c in (1, 2, 2)],
        user_uniforms=[{"product_size_id": 1, "team_member_id": w, "status": s}
                       for w, s in ((4, "returned_stolen"), (4, "active"), (None, "returned_other"), (4, "lost"))],
    )
    got = rows(joins.returns_report(t), "return_reason", "reason_label", "order_count", "last_order_id")
    assert got == [("lost", "Lost", 2, 2), ("other", "Other", 0, None), ("stolen", "Stolen", 2, 2)]
    assert joins.returns_report(t, reason="stolen").count() == 1
    counts = reports.return_counts(t.user_uniforms).first().asDict()
    assert counts == {"total": 3, "worn_out": 0, "damaged": 0, "size_exchange": 0, "stolen": 1, "other": 2}


def test_nest_pages_by_position(spark):
    children = spark.createDataFrame([("hot", i) for i in reversed(range(250))] + [("cold", 1), (None, 3)], "k STRING, v BIGINT")
    paged = nested.nest(children, "k", ["v"], "vs", page_items=100).orderBy("k", "page").collect()
    assert [(r["k"], r["page"], len(r["vs"])) for r in paged] == [("cold", 0, 1), ("hot", 0, 100), ("hot", 1, 100), ("hot", 2, 50)]
    assert [e["v"] for r in paged[1:] for e in r["vs"]] == list(range(250))


def test_positions_by_cells_equal_a_sort(spark):
    """A hot key, equal values, NULLs and texts: positions as a window over the whole group would give them."""
    rng = random.Random(4)
    data = [("hot" if i % 3 else f"k{rng.randint(0, 40)}", rng.choice([None, 1, 1, 2, rng.randint(0, 10**6)]), f"t{rng.randint(0, 50)}", i) for i in range(6000)]
    df = spark.createDataFrame(data + [(None, 1, "x", -1)], "k STRING, a BIGINT, b STRING, id BIGINT")
    got = {(r["k"], r["id"]): r["n"] for r in place_in_group(df, "k", ["a", "b", "id"], "n", cuts=8, sample=200).collect()}
    want = {}
    for key in {r[0] for r in data}:
        group = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        want |= {(key, r[3]): n for n, r in enumerate(group)}
    assert got == want
    assert place_in_group(df.limit(0), "k", ["a"], "n").count() == 0


def test_paging_writes_nothing_and_sorts_no_whole_table(spark, monkeypatch):
    children = spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"), F.lit("long text").alias("text"), F.col("id"))
    written = []
    monkeypatch.setattr("garbline.functions.spread.cut_lineage", lambda df, *a: written.append(df) or df)
    wanted = spark.createDataFrame([(1,), (2,), (9,)], "k BIGINT")
    paged = nested.nest(children, "k", ["v", "id"], "vs", 100, wanted, late=("text",))
    plan = paged._jdf.queryExecution().executedPlan().toString()
    assert not written and "rangepartitioning" not in plan
    pages_of = {(r["k"], r["page"]): [(x["v"], x["text"]) for x in r["vs"]] for r in paged.collect()}
    assert {k for k, _ in pages_of} == {1, 2}
    assert [x for p in range(8) for x in pages_of[1, p]] == [(v, "long text") for v in range(1, 5000, 7)]


def test_intervals_by_bucket_equal_every_pair(spark):
    rng = random.Random(6)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 400))
    facts = [(i, rng.choice([1, 1, 2, None]), rng.choice([None, *[day()] * 9])) for i in range(300)]
    spans = [(rng.choice([1, 1, 2, None]), rng.choice([None, *[day()] * 9]), rng.choice([None, dt.date(9999, 12, 31), *[day()] * 9]), i) for i in range(80)]
    a = spark.createDataFrame(facts, "id BIGINT, k BIGINT, day DATE")
    b = spark.createDataFrame(spans, "k BIGINT, start DATE, end DATE, span BIGINT")
    want = sorted(((i, s) for i, k, d in facts for k2, x, y, s in spans if None not in (k, d, x, y) and k == k2 and x <= d <= y), key=repr)
    for width in (1, 32, 5000):
        assert rows(joins.interval_join(a, b, "k", "day", "start", "end", width), "id", "span") == want
    assert rows(joins.interval_join(a.limit(0), b, "k", "day", "start", "end")) == []


def test_authority_on_the_day_of_the_order(spark):
    d = lambda text: dt.date.fromisoformat(text)
    carts = table(spark, "order_carts", [{"id": 1, "supervisor_id": 7, "created_at": at("2024-03-10 23:59")}, {"id": 2, "supervisor_id": 7, "created_at": at("2024-03-11")},
                                         {"id": 3, "supervisor_id": 7}, {"id": 4, "created_at": at("2024-03-10")}])
    given = [(7, 8, "2024-03-01", "2024-03-05"), (7, 8, "2024-03-04", "2024-03-10"), (7, 8, "2024-03-10", "2024-03-10"), (7, 9, "2024-03-11", "2024-03-11"),
             (7, 7, "2024-01-01", "2024-12-31"), (7, 5, "2024-12-31", "2024-01-01"), (9, 7, "2024-01-01", "2024-12-31")]
    delegations = table(spark, "supervisor_delegations", [
        {"id": i, "from_supervisor_id": f, "to_supervisor_id": to, "start_date": d(a), "end_date": d(b)} for i, (f, to, a, b) in enumerate(given)])
    got = rows(joins.orders_by_authority(carts, delegations), "order_id", "actor_id", "reason")
    assert got == [(1, 7, "self"), (1, 8, "delegate"), (2, 7, "self"), (2, 9, "delegate"), (3, 7, "self")]


def test_nested_results_are_ordered(spark):
    t = tables(
        spark,
        users=[{"id": i, "full_name": f"u{i}", "system_role": "supervisor"} for i in range(6)],
        team_members=[{"id": i, "full_name": f"w{9 - i}", "supervisor_id": i % 3} for i in range(9)],
        supervisor_delegations=[
            {"id": i, "from_supervisor_id": i % 3, "to_supervisor_id": 5, "start_date": dt.date(2024, 1, 1 + i * 7 % 5), "end_date": dt.date(2024, 9, 9)}
            for i in range(8)
        ],
    )
    got = nested.delegations_with_members(t, dt.date(2024, 5, 5), page_items=2).collect()
    keys = [(-r["start_date"].toordinal(), r["id"], r["page"]) for r in got]
    assert keys == sorted(keys) and len(got) == 16
    assert all([m["full_name"] for m in r["members"]] == sorted(m["full_name"] for m in r["members"]) for r in got)
    posts = [{"id": i, "created_by": 1, "target_role": "all", "pinned": i % 2, "created_at": dt.date(2024, 1, 1 + i % 4)} for i in range(12)]
    feed = pages.news_feed(tables(spark, users=[{"id": 1, "full_name": "s"}], news_posts=posts), 1, "supervisor").collect()
    order = [(-r["pinned"], -r["created_at"].toordinal(), -r["id"]) for r in feed]
    assert order == sorted(order) and len(feed) == 12


def test_size_map_ignores_case(spark):
    sizes = table(spark, "worker_sizes", [{"team_member_id": 1, "product_type": "Shirt", "size": "M"},
                                          {"team_member_id": 1, "product_type": "PANTS", "size": "44"}])
    assert nested.size_map(sizes).first()["sizes"] == {"SHIRT": "M", "PANTS": "44"}


def test_number_rows_is_dense(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = number_rows(df, [F.col("k").desc(), F.col("id").asc()], "n", 5).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(5, 1005))
    assert [(r["k"], r["id"]) for r in got] == sorted(((r["k"], r["id"]) for r in got), key=lambda p: (-p[0], p[1]))
    assert number_rows(df.limit(0), [F.col("id").asc()], "n").count() == 0


def test_joins_for_hot_and_null_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(60)] + [(2, 1), (None, 2), (None, 3), (9, 4)], "k BIGINT, v BIGINT")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k BIGINT, w STRING")
    plain = rows(left.join(right, "k", "left"), "k", "v", "w")
    counted = right.groupBy("k").agg(F.max("w").alias("w"))
    assert rows(join_reduced(left, counted, ["k"], "left"), "k", "v", "w") == plain
    for how in ("inner", "left_semi"):
        assert rows(join_reduced(left, counted, ["k"], how)) == rows(left.join(right, "k", how))
    renamed = right.withColumnRenamed("k", "rk")
    assert rows(join_spread_nulls(left, renamed, "k", "rk", how="left_anti")) == rows(left.join(right, "k", "left_anti"))
    spread = join_spread_nulls(left, renamed, "k", "rk", ["v"])
    assert rows(spread, "k", "v", "w") == plain
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert "_home" in plan, "the place must stay a join column"
    two = spark.createDataFrame([(1, 5, True), (2, 1, True)], "rk BIGINT, v BIGINT, hit BOOLEAN")
    both = join_spread_nulls(left, two, "k", "rk", also=["v"]).where("hit")
    assert rows(both, "k", "v") == [(1, 5), (2, 1)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(-3, 9)), min_size=1, max_size=60))
def test_sum_before_in_chunks(spark, cells):
    unique = list({(k, r): v for k, r, v in cells}.items())
    df = spark.createDataFrame([(k, r, v) for (k, r), v in unique], "k INT, r BIGINT, v BIGINT")
    want = sorted((k, r, sum(v2 for (k2, r2), v2 in unique if k2 == k and r2 < r)) for (k, r), _ in unique)
    for chunk in (4, 1000):
        assert sorted(tuple(x) for x in sum_before(df, "k", "r", {"s": F.col("v")}, chunk).select("k", "r", "s").collect()) == want
