import datetime as dt
import random
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from garbline.functions.graph import components
from garbline.operators import cart_jobs, status_jobs, table_jobs
from garbline.operators.cascade import WORKWEAR, Plan, Reference, cascade_delete
from tests.data import at, rows, table, tables

D = Decimal
AS_OF = dt.datetime(2024, 5, 15)


def shop(spark, **more):
    base = dict(
        products=[{"id": "p", "name": "P", "article_number": "1", "price": D("10.00")},
                  {"id": "n", "name": "N", "article_number": "2", "price": None}],
        product_sizes=[{"id": 1, "product_id": "p", "size": "S", "stock": 5}, {"id": 2, "product_id": "n", "size": "S", "stock": 1}],
        users=[{"id": 1, "system_role": "supervisor", "monthly_budget": D("150.00")}, {"id": 2, "system_role": "supervisor"},
               {"id": 3, "system_role": "supervisor", "monthly_budget": D("0.00")}],
        team_members=[{"id": 10, "supervisor_id": 1}, {"id": 20, "supervisor_id": 2}],
    )
    base.update(more)
    return tables(spark, **base)


REQUEST = "seq BIGINT, actor_id BIGINT, actor_role STRING, team_member_id BIGINT, product_size_id BIGINT, quantity INT"


def test_add_to_carts(spark):
    t = shop(
        spark,
        order_carts=[{"id": 7, "supervisor_id": 1, "status": "created", "created_at": at("2024-05-01")},
                     {"id": 8, "supervisor_id": 1, "status": "created", "created_at": at("2024-05-02")}],
        order_items=[{"cart_id": 8, "product_size_id": 1, "team_member_id": 10, "quantity": 1, "price_at_time": D("7.00")}],
    )
    asked = spark.createDataFrame(
        [(1, 1, "supervisor", 10, 1, 2), (2, 1, "supervisor", 10, 2, None), (3, 1, "supervisor", 10, 2, 4),
         (4, 1, "supervisor", 20, 1, 1), (5, 2, "supervisor", 20, 1, 3), (6, 2, "admin", 20, 1, 3),
         (7, 2, "supervisor", 20, None, 3), (8, 5, "worker", 20, 1, 1), (9, 5, "worker", 99, 1, 1)],
        REQUEST,
    )
    lines, new_carts, rejects = cart_jobs.add_to_carts(asked, t, AS_OF)
    assert rows(lines, "cart_id", "product_size_id", "team_member_id", "quantity", "price_at_time") == [
        (10, 1, 20, 1, D("10.00")), (8, 1, 10, 3, D("7.00")), (8, 2, 10, 5, D("0.00")), (9, 1, 20, 3, D("10.00")),
    ]
    assert rows(new_carts, "id", "supervisor_id") == [(10, 5), (9, 2)]
    assert rows(rejects, "seq", "reason") == [
        (4, "invalid team member"), (6, "admins cannot order"), (7, "no size selected"), (9, "unknown worker"),
    ]


def test_bulk_order_quantities(spark):
    t = shop(spark)
    orders = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 3)], "order_id BIGINT, supervisor_id BIGINT")
    workers = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (4, 20)], "order_id BIGINT, team_member_id BIGINT")
    lines = spark.createDataFrame(
        [(1, 1, ""), (1, 2, "0"), (1, 3, None), (1, 2, " 4 "), (1, 1, "-1"), (3, 1, "1"), (4, 1, "2"), (4, 2, "4x")],
        "order_id BIGINT, product_size_id BIGINT, quantity STRING",
    )
    carts, priced, rejects = cart_jobs.bulk_order(orders, workers, lines, t)
    assert rows(rejects) == [(4, 3, "invalid quantity")]
    assert rows(priced, "order_id", "product_size_id", "quantity") == [(1, 1, 1), (1, 2, 4), (1, 3, 1), (3, 1, 1)]
    items = cart_jobs.bulk_items(carts, workers, priced)
    assert rows(items, "cart_id", "team_member_id", "product_size_id", "quantity", "price_at_time") == sorted(
        [(1, w, 1, 1, D("10.00")) for w in (10, 11)] + [(1, w, 2, 4, D("0.00")) for w in (10, 11)]
        + [(1, w, 3, 1, D("0.00")) for w in (10, 11)], key=repr)
    assert rows(carts, "id", "workers", "lines", "total_price") == [(1, 2, 3, D("20.00"))]


def budget_case(spark, used, total, supervisor=1):
    t = shop(
        spark,
        order_carts=[
            {"id": 1, "supervisor_id": supervisor, "status": "packed", "total_price": D(used), "created_at": at("2024-05-03")},
            {"id": 2, "supervisor_id": supervisor, "status": "submitted", "total_price": D("9999.00"), "created_at": at("2024-05-03")},
            {"id": 3, "supervisor_id": supervisor, "status": "created", "created_at": at("2024-05-04")},
        ],
        order_items=[{"cart_id": 3, "product_size_id": 1, "team_member_id": 10, "quantity": 1, "price_at_time": D(total)}],
    )
    asked = spark.createDataFrame([(3, at("2024-05-15"))], "cart_id BIGINT, submitted_at TIMESTAMP_NTZ")
    return cart_jobs.budget_verdicts(asked, t, AS_OF).first()["reason"]


def test_budget_edges(spark):
    assert budget_case(spark, "100.00", "50.00") is None
    assert budget_case(spark, "100.00", "50.01") == "monthly budget exceeded"
    assert budget_case(spark, "100.00", "5000.00", supervisor=2) is None
    assert budget_case(spark, "100.00", "5000.00", supervisor=3) is None


def test_checkout_tables(spark):
    t = shop(
        spark,
        product_sizes=[{"id": 1, "product_id": "p", "size": "S", "stock": 3}, {"id": 2, "product_id": "p", "size": "M", "stock": 9}],
        order_carts=[{"id": i, "supervisor_id": 2, "status": "created", "created_at": at("2024-05-01")} for i in (1, 2, 3, 4, 5)],
        order_items=[
            # Cart 1 asks twice for SKU 1; the stock covers one of the lines only.
            {"cart_id": 1, "product_size_id": 1, "team_member_id": 20, "quantity": 2, "price_at_time": D("1.00")},
            {"cart_id": 1, "product_size_id": 1, "team_member_id": 21, "quantity": 2, "price_at_time": D("1.00")},
            {"cart_id": 1, "product_size_id": 2, "team_member_id": 21, "quantity": 1, "price_at_time": D("1.00")},
            {"cart_id": 2, "product_size_id": 1, "team_member_id": 22, "quantity": 3, "price_at_time": D("2.50")},
            {"cart_id": 3, "product_size_id": 1, "team_member_id": 20, "quantity": 1, "price_at_time": D("1.00")},
            {"cart_id": 5, "product_size_id": 99, "team_member_id": 20, "quantity": 1, "price_at_time": D("1.00")},
        ],
    )
    asked = spark.createDataFrame(
        [(1, at("2024-05-15 08:00"), "c1", None), (2, at("2024-05-15 09:00"), "c2", 77), (3, at("2024-05-15 10:00"), None, None),
         (4, at("2024-05-15 07:00"), None, None), (5, at("2024-05-15 07:00"), None, None), (6, at("2024-05-15 07:00"), None, None)],
        "cart_id BIGINT, submitted_at TIMESTAMP_NTZ, comment STRING, team_member_id BIGINT",
    )
    carts, skus, rejects = cart_jobs.checkout(asked, t, AS_OF)
    assert rows(rejects) == [(1, "not enough stock"), (3, "not enough stock"), (4, "cart is empty"), (5, "not enough stock"),
                             (6, "cart not found")]
    assert rows(skus, "id", "stock") == [(1, 0), (2, 9)]
    done = carts.where("id = 2").first()
    assert (done["status"], done["total_price"], done["team_member_id"], done["comment"]) == ("submitted", D("7.50"), 77, "c2")
    assert carts.where("status = 'created'").count() == 4


def test_last_unit_goes_to_the_earlier_cart(spark):
    skus = table(spark, "product_sizes", [{"id": 1, "stock": 1}])
    lines = spark.createDataFrame(
        [(1, at("2024-05-15 10:00"), 1, 1), (2, at("2024-05-15 09:00"), 1, 1)],
        "cart_id BIGINT, submitted_at TIMESTAMP_NTZ, product_size_id BIGINT, quantity INT",
    )
    assert rows(cart_jobs.allocate_stock(cart_jobs.cart_demand(lines), skus)) == [(1, False), (2, True)]


def test_allocation_equals_one_by_one(spark):
    rng = random.Random(5)
    lines, stocks, want = [], [], {}
    # Many independent worlds in one call: world w owns the SKUs and carts numbered w * 100 + ...
    for world in range(60):
        stock = {world * 100 + s: rng.randint(0, 8) for s in range(4)}
        stocks += [{"id": k, "stock": v} for k, v in stock.items()]
        for cart in range(rng.randint(2, 9)):
            cart_id, when = world * 100 + cart, at("2024-05-15") + dt.timedelta(minutes=cart)
            need = {}
            for _ in range(rng.randint(1, 4)):
                sku, quantity = rng.choice(list(stock)), rng.randint(1, 4)
                need[sku] = need.get(sku, 0) + quantity
                lines.append((cart_id, when, sku, quantity))
            want[cart_id] = all(stock[s] >= q for s, q in need.items())
            if want[cart_id]:
                for s, q in need.items():
                    stock[s] -= q
    schema = "cart_id BIGINT, submitted_at TIMESTAMP_NTZ, product_size_id BIGINT, quantity INT"
    df, skus = spark.createDataFrame(lines, schema), table(spark, "product_sizes", stocks)
    need = cart_jobs.cart_demand(df)
    # walked as one, by sums and chains alone, and with components walked in part
    for chunk, fold in ((100_000, 4096), (3, 0), (3, 12)):
        assert dict(rows(cart_jobs.allocate_stock(need, skus, chunk, fold=fold))) == want


def chain(spark, links):
    """Carts in a row, each of which wants a unit of its own SKU and of the next, of which there is one."""
    lines = [(cart, at("2024-05-15") + dt.timedelta(seconds=cart), sku, 1) for cart in range(links) for sku in (cart, cart + 1)]
    schema = "cart_id BIGINT, submitted_at TIMESTAMP_NTZ, product_size_id BIGINT, quantity INT"
    need = cart_jobs.cart_demand(spark.createDataFrame(lines, schema))
    return need, table(spark, "product_sizes", [{"id": i, "stock": 1} for i in range(links + 1)])


def jobs_of(spark, run):
    """What ``run`` returns, and the number of jobs it took."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    out = run()
    count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, count


def test_jobs_do_not_grow_with_a_chain_of_carts(spark):
    """The last fold of open rows is walked in one task, whatever waits for whatever."""
    counts = {}
    for links in (20, 1000):
        need, skus = chain(spark, links)
        got, counts[links] = jobs_of(spark, lambda: dict(rows(cart_jobs.allocate_stock(need, skus))))
        assert got == {c: c % 2 == 0 for c in range(links)}
    assert counts[1000] <= counts[20] + 2


def test_chains_are_doubled(spark):
    """Without walking, a chain takes two rounds of sums; its pointers are doubled between them."""
    need, skus = chain(spark, 300)
    seen = []
    got = dict(rows(cart_jobs.allocate_stock(need, skus, seen=seen, fold=0)))
    assert got == {c: c % 2 == 0 for c in range(300)}
    assert len(seen) <= 2


def test_large_components_are_walked_in_parts(spark):
    """Carts that each want three of few SKUs, so that neither sums nor chains decide much."""
    rng = random.Random(8)
    lines, stock, want = [], {s: 40 for s in range(6)}, {}
    stocks = [{"id": s, "stock": v} for s, v in stock.items()]
    for cart in range(200):
        need = {s: rng.randint(1, 3) for s in rng.sample(range(6), 3)}
        lines += [(cart, at("2024-05-15") + dt.timedelta(minutes=cart), s, q) for s, q in need.items()]
        want[cart] = all(stock[s] >= q for s, q in need.items())
        if want[cart]:
            for s, q in need.items():
                stock[s] -= q
    schema = "cart_id BIGINT, submitted_at TIMESTAMP_NTZ, product_size_id BIGINT, quantity INT"
    need, seen = cart_jobs.cart_demand(spark.createDataFrame(lines, schema)), []
    got = dict(rows(cart_jobs.allocate_stock(need, table(spark, "product_sizes", stocks), seen=seen, fold=60)))
    assert got == want
    assert seen == sorted(seen, reverse=True) and len(seen) <= 1 + 600 // 57


def test_accepted_rows_in_rounds(spark):
    """Two keys: rows that share a name with the one before and an article with the one after."""
    pairs = [(i, f"n{i // 2}", f"a{(i + 1) // 2}") for i in range(1000)] + [(2000 + i, f"x{i}", f"y{i}") for i in range(40)]
    pairs += [(3000, None, "y1"), (3001, None, None), (3002, "y1", None)]
    incoming = spark.createDataFrame(pairs, "seq BIGINT, name STRING, article STRING")
    want = {i: i % 2 == 0 for i in range(1000)} | {2000 + i: True for i in range(40)} | {3000: False, 3001: True, 3002: True}
    seen = []
    got, jobs = jobs_of(spark, lambda: dict(rows(table_jobs.accept_first(incoming, "seq", ["name", "article"]), "seq", "accepted")))
    short = incoming.where("seq < 20 or seq >= 2000")
    _, few = jobs_of(spark, lambda: rows(table_jobs.accept_first(short, "seq", ["name", "article"]), "seq", "accepted"))
    assert got == want and jobs <= few + 2
    doubled = table_jobs.accept_first(incoming, "seq", ["name", "article"], seen, fold=0)
    assert dict(rows(doubled, "seq", "accepted")) == want and len(seen) <= 2


def test_accepted_rows_equal_one_by_one(spark):
    rng = random.Random(11)
    pairs = [(i, f"n{rng.randint(0, 60)}", f"a{rng.randint(0, 60)}") for i in rng.sample(range(5000), 400)]
    names, articles, want = set(), set(), {}
    for seq, name, article in sorted(pairs):
        want[seq] = name not in names and article not in articles
        if want[seq]:
            names.add(name)
            articles.add(article)
    incoming = spark.createDataFrame(pairs, "seq BIGINT, name STRING, article STRING")
    for fold in (4096, 50):
        assert dict(rows(table_jobs.accept_first(incoming, "seq", ["name", "article"], fold=fold), "seq", "accepted")) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(300)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(rows(components(spark.createDataFrame(edges, "a BIGINT, b BIGINT"))))
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def walk(base, commands):
    status = base
    for _, _, command in sorted(commands):
        if command != "cancelled" or status not in ("packed", "completed"):
            status = command
    return status


def test_status_rule_equals_one_by_one(spark):
    rng = random.Random(11)
    kinds = ["created", "submitted", "packed", "completed", "cancelled"]
    carts, commands, want = [], [], {}
    for cart in range(400):
        base = rng.choice(kinds)
        own = [(at("2024-05-01") + dt.timedelta(minutes=rng.randint(0, 4)), cart * 100 + i, rng.choice(kinds + ["cancelled"] * 3))
               for i in range(rng.randint(0, 6))]
        carts.append({"id": cart, "status": base})
        commands += [(cart, *c) for c in own]
        want[cart] = walk(base, own)
    df = spark.createDataFrame(commands, "order_id BIGINT, ts TIMESTAMP_NTZ, event_id BIGINT, command STRING")
    got = status_jobs.apply_status(table(spark, "order_carts", carts), df)
    assert dict(rows(got, "id", "status")) == want


def test_issue_per_line_and_per_unit(spark):
    items = table(spark, "order_items", [{"cart_id": 1, "product_size_id": 5, "team_member_id": 9, "quantity": 3},
                                         {"cart_id": 2, "product_size_id": 5, "team_member_id": 9, "quantity": 1}])
    done = spark.createDataFrame([(1,)], "cart_id BIGINT")
    assert status_jobs.issue_garments(items, done, AS_OF).count() == 1
    assert status_jobs.issue_garments(items, done, AS_OF, "per_unit").count() == 3


def test_returns(spark):
    skus = table(spark, "product_sizes", [{"id": 1, "stock": 5}])
    garments = spark.createDataFrame(
        [(i, 1, "active", None) for i in range(1, 7)],
        "id BIGINT, product_size_id BIGINT, status STRING, returned_at TIMESTAMP_NTZ",
    )
    returns = spark.createDataFrame(
        [(1, 1, "lost", "self", at("2024-05-01")), (2, 2, "stolen", "self", at("2024-05-01")),
         (3, 3, "stolen", "worker", at("2024-05-01")), (4, 4, "other", "worker", at("2024-05-01")),
         (6, 4, "lost", "worker", at("2024-05-02")), (5, 4, "damaged", "worker", at("2024-05-02")),
         (7, 99, "other", "self", at("2024-05-01"))],
        "seq BIGINT, garment_id BIGINT, reason STRING, path STRING, at TIMESTAMP_NTZ",
    )
    updated, stock = status_jobs.apply_returns(garments, skus, returns)
    assert rows(updated, "id", "status") == [
        (1, "returned_lost"), (2, "returned_stolen"), (3, "returned_stolen"), (4, "returned_lost"), (5, "active"), (6, "active")]
    assert stock.first()["stock"] == 8
    asked = spark.createDataFrame([(5,), (5,)], "garment_id BIGINT")
    assert rows(status_jobs.request_replacement(garments, asked).where("status = 'lost'"), "id") == [(5,)]


def test_receipts(spark):
    skus = table(spark, "product_sizes", [{"id": 1, "stock": 5}, {"id": 2, "stock": 5}])
    got = spark.createDataFrame([(1, "3"), (1, "-2"), (1, ""), (1, "1x"), (1, None), (1, "4")], "product_size_id BIGINT, amount STRING")
    assert rows(table_jobs.receive_stock(skus, got), "id", "stock") == [(1, 12), (2, 5)]
    assert rows(table_jobs.receive_stock(skus, got, digits_only=False), "id", "stock") == [(1, 10), (2, 5)]


def test_merge_sizes(spark):
    base = table(spark, "worker_sizes", [{"team_member_id": 1, "product_type": "SHIRT", "size": "S"},
                                         {"team_member_id": 1, "product_type": "PANTS", "size": "44"}])
    changes = spark.createDataFrame(
        [(1, 1, "SHIRT", "M"), (2, 1, "SHIRT", "L"), (3, 1, "PANTS", "46"), (4, 1, "PANTS", ""), (5, 2, "SHOES", "40")],
        "seq BIGINT, team_member_id BIGINT, product_type STRING, size STRING",
    )
    assert rows(table_jobs.merge_sizes(base, changes)) == [(1, "SHIRT", "L"), (2, "SHOES", "40")]


def test_delegation_jobs(spark):
    day = dt.date(2024, 5, 1)
    base = table(spark, "supervisor_delegations", [
        {"id": 1, "from_supervisor_id": 1, "to_supervisor_id": 2, "start_date": day, "end_date": day},
        {"id": 2, "from_supervisor_id": 2, "to_supervisor_id": 1, "start_date": day, "end_date": day}])
    later = dt.date(2024, 6, 1)
    commands = spark.createDataFrame(
        [(1, 1, "extend", 1, later), (2, 1, "delete", 2, None), (3, 1, "extend", 1, dt.date(2024, 7, 1))],
        "seq BIGINT, actor_id BIGINT, action STRING, delegation_id BIGINT, end_date DATE",
    )
    inserts = spark.createDataFrame(
        [(1, 2, 1, day, day), (2, 5, 6, day, day), (3, 5, 6, day, day), (4, 5, 6, day, later)],
        "seq BIGINT, from_supervisor_id BIGINT, to_supervisor_id BIGINT, start_date DATE, end_date DATE",
    )
    after, refused = table_jobs.merge_delegations(base, commands, inserts)
    assert rows(after, "id", "from_supervisor_id", "end_date") == [
        (1, 1, dt.date(2024, 7, 1)), (2, 2, day), (3, 5, day), (4, 5, later)]
    assert rows(refused, "seq") == [(1,), (3,)]


def test_delegation_batch_in_sequence(spark):
    day, later = dt.date(2024, 5, 1), dt.date(2024, 6, 1)
    base = table(spark, "supervisor_delegations", [{"id": 1, "from_supervisor_id": 1, "to_supervisor_id": 2, "start_date": day, "end_date": day}])
    commands = spark.createDataFrame(
        [(10, 1, "extend", 1, later), (20, 1, "delete", 1, None)],
        "seq BIGINT, actor_id BIGINT, action STRING, delegation_id BIGINT, end_date DATE",
    )
    schema = "seq BIGINT, from_supervisor_id BIGINT, to_supervisor_id BIGINT, start_date DATE, end_date DATE"
    # a copy is refused only while its original stands as it is
    for seq, end, taken in ((5, day, False), (15, day, True), (5, later, True), (15, later, False), (25, later, True)):
        after, refused = table_jobs.merge_delegations(base, commands, spark.createDataFrame([(seq, 1, 2, day, end)], schema))
        assert (refused.count() == 0) == taken and after.count() == int(taken)


def test_toggles(spark):
    clicks = spark.createDataFrame([(1, 1)] * 3 + [(1, 2)] * 2 + [(2, 1)], "post_id BIGINT, user_id BIGINT")
    assert rows(table_jobs.toggle_state(clicks, ["post_id", "user_id"])) == [(1, 1), (2, 1)]
    base = spark.createDataFrame([(2, 1), (9, 9)], "post_id BIGINT, user_id BIGINT")
    assert rows(table_jobs.toggle_state(clicks, ["post_id", "user_id"], base)) == [(1, 1), (9, 9)]
    posts = table(spark, "news_posts", [{"id": 1, "pinned": None}, {"id": 2, "pinned": 1}, {"id": 3, "pinned": None}])
    assert rows(table_jobs.toggle_pins(posts, clicks), "id", "pinned") == [(1, 1), (2, 0), (3, None)]


def load_one_by_one(base_names, base_articles, incoming):
    names, articles, out = set(base_names), set(base_articles), {}
    for seq, article, name in sorted(incoming):
        if name.strip() in names:
            out[seq] = "name exists"
        elif article.strip() in articles:
            out[seq] = "article number exists"
        else:
            names.add(name.strip())
            articles.add(article.strip())
    return out


def test_product_load_equals_one_by_one(spark):
    rng = random.Random(3)
    incoming = [(i, f"a{rng.randint(0, 25)}", f" n{rng.randint(0, 25)}") for i in range(90)]
    df = spark.createDataFrame(incoming, "seq BIGINT, article_number STRING, name STRING").withColumns(
        {"type": F.lit("Shirt"), "price": F.lit(1).cast("decimal(12,2)"), "job_role_ids": F.array(F.lit(1), F.lit(6)),
         "size_S": F.lit("4"), "size_size_M": F.lit(""), "size_L": F.lit(None).cast("string")})
    base = spark.createDataFrame([(7, "n3", "a4")], "id BIGINT, name STRING, article_number STRING")
    loaded = table_jobs.load_products(base, df)
    want = load_one_by_one(["n3"], ["a4"], incoming)
    assert dict(rows(loaded.rejects, "seq", "reason")) == want
    fresh = len(incoming) - len(want)
    assert [r[0] for r in sorted(rows(loaded.products, "id"))] == sorted(range(8, 8 + fresh))
    assert loaded.links.count() == 2 * fresh
    assert rows(loaded.skus.where("product_id = 8"), "size", "stock") == [("M", 0), ("S", 4)]


def test_bad_size_text_refuses_its_row_only(spark):
    incoming = spark.createDataFrame(
        [(1, "a1", "n1", "4x"), (2, "a1", "n1", " 7 "), (3, "a3", "n3", "")], "seq BIGINT, article_number STRING, name STRING, size_S STRING"
    ).withColumns({"type": F.lit("Shirt"), "price": F.lit(1).cast("decimal(12,2)"), "job_role_ids": F.array(F.lit(1))})
    base = spark.createDataFrame([(7, "n", "a")], "id BIGINT, name STRING, article_number STRING")
    loaded = table_jobs.load_products(base, incoming)
    assert rows(loaded.rejects, "seq", "reason") == [(1, "invalid size amount")]
    assert rows(loaded.skus, "product_id", "stock") == [(8, 7), (9, 0)]


def test_user_load(spark):
    base = table(spark, "users", [{"id": 4, "email": "old@x"}])
    roles = table(spark, "job_roles", [{"id": 7, "name": "Packer"}])
    incoming = spark.createDataFrame(
        [(1, "a", "old@x", "supervisor", 1, None, None, [1]), (2, "b", "new@x", "packer", 1, None, None, [1, 1, 2]),
         (3, "c", "new@x", "supervisor", 1, None, None, []), (4, "d", "d@x", "supervisor", 2, None, None, [])],
        "seq BIGINT, full_name STRING, email STRING, system_role STRING, job_role_id BIGINT, supervisor_id BIGINT,"
        " facility_id BIGINT, site_ids ARRAY<BIGINT>",
    )
    out = table_jobs.load_users(base, incoming, roles)
    assert rows(out.users, "id", "email", "job_role_id") == [(5, "new@x", 7), (6, "d@x", 2)]
    assert rows(out.user_sites) == [(5, 1), (5, 2)]
    assert rows(out.rejects, "seq") == [(1,), (3,)]


def test_user_delete_guards(spark):
    users = table(spark, "users", [{"id": i, "system_role": r} for i, r in ((1, "admin"), (2, "admin"), (3, "supervisor"))])
    asked = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 1, 2), (4, 1, 3), (5, 1, 9)], "seq BIGINT, actor_id BIGINT, user_id BIGINT")
    doomed, refused = table_jobs.guard_user_deletes(users, asked)
    assert rows(doomed) == [(1,), (3,)]
    assert rows(refused, "seq") == [(3,), (5,)]


def test_cascade(spark):
    t = shop(
        spark,
        worker_sizes=[{"team_member_id": 10}, {"team_member_id": 20}],
        order_carts=[{"id": 1, "supervisor_id": 1}, {"id": 2, "supervisor_id": 2}],
        order_items=[{"cart_id": 1, "product_size_id": 1}, {"cart_id": 2, "team_member_id": 10, "product_size_id": 2},
                     {"cart_id": 2, "product_size_id": 1}],
        user_uniforms=[{"team_member_id": 10, "product_size_id": 1}, {"team_member_id": None, "product_size_id": 1}],
    )
    left, _ = cascade_delete(t, "users", spark.createDataFrame([(1,), (None,), (77,)], "user_id BIGINT"))
    assert {n: df.count() for n, df in left.items()} == {
        "users": 2, "team_members": 1, "worker_sizes": 1, "user_uniforms": 1, "order_items": 1, "order_carts": 1}
    left, _ = cascade_delete(t, "products", spark.createDataFrame([("p",)], "product_id STRING"))
    assert {n: df.count() for n, df in left.items()} == {
        "products": 1, "product_sizes": 1, "product_job_roles": 0, "order_items": 1}


def test_refused_roots_hold_back_only_themselves(spark):
    """A root goes unless a row that it does not take along refers to something it would take."""
    plan = Plan(
        (Reference("b", "a_id", "a"), Reference("c", "b_id", "b"), Reference("c", "a_id", "a"), Reference("d", "c_id", "c", refuse=True), Reference("c", "keeper", "b", refuse=True)),
        {"d": None},
    )
    t = SimpleNamespace(
        a=spark.createDataFrame([(i,) for i in range(1, 6)], "id BIGINT"),
        b=spark.createDataFrame([(10, 1), (20, 2), (30, 3), (31, 3), (40, None)], "id BIGINT, a_id BIGINT"),
        c=spark.createDataFrame([(100, 10, None, 10), (200, 20, None, None), (300, 30, None, None), (301, None, 3, 30), (400, None, 4, 20), (500, 40, 5, None)], "id BIGINT, b_id BIGINT, a_id BIGINT, keeper BIGINT"),
        d=spark.createDataFrame([(300,), (None,)], "c_id BIGINT"),
    )
    left, refused = cascade_delete(t, "a", spark.createDataFrame([(i,) for i in range(1, 6)], "id BIGINT"), plan)
    # 2: row 400 keeps b 20 and hangs on another root; 3: d refers to c 300; 1's keeper goes along
    assert rows(refused) == [(2,), (3,)]
    assert {n: sorted(r[0] for r in rows(df, "id")) for n, df in left.items()} == {"a": [2, 3], "b": [20, 30, 31, 40], "c": [200, 300, 301]}


def test_reference_circles_are_refused():
    circle = Plan((Reference("b", "a_id", "a"), Reference("a", "b_id", "b")), {})
    with pytest.raises(ValueError, match="circle"):
        circle.order("a")
    with pytest.raises(ValueError, match="no key"):
        Plan((Reference("b", "a_id", "a"), Reference("c", "b_id", "b")), {"b": None}).order("a")
    order = WORKWEAR.order("users")
    assert order[0] == "users" and all(order.index(r.parent) < order.index(r.child) for r in WORKWEAR.references if not r.refuse and r.parent in order)
    assert WORKWEAR.order("facilities") == ["facilities"]


def test_updates(spark):
    base = table(spark, "products", [{"id": "a", "name": "A", "price": D("1.00")}, {"id": "b", "name": "B", "price": D("2.00")}])
    changes = spark.createDataFrame([("a", " ", None), ("b", " C ", None)], "id STRING, name STRING, price DECIMAL(12,2)")
    got = rows(table_jobs.apply_updates(base, changes, "id", only_if="name"), "id", "name", "price")
    assert got == [("a", "A", D("1.00")), ("b", "C", None)]
    people = table(spark, "team_members", [{"id": 1, "full_name": "x", "employee_number": "E1"}])
    news = spark.createDataFrame([(1, "y", " ")], "id BIGINT, full_name STRING, employee_number STRING")
    got = table_jobs.apply_updates(people, news, "id", only_if="full_name", blank_is_null=("employee_number",)).first()
    assert (got["full_name"], got["employee_number"]) == ("y", None)
    gone = spark.createDataFrame([("a", "A"), ("b", "X")], "id STRING, name STRING")
    assert rows(table_jobs.apply_deletes(base, gone, ["id", "name"]), "id") == [("b",)]


def test_append(spark):
    base = table(spark, "sites", [{"id": 4, "name": "x"}])
    more = spark.createDataFrame([("b",), ("a",)], "name STRING")
    assert rows(table_jobs.append_rows(base, more, ["name"])) == [(4, "x"), (5, "a"), (6, "b")]
    empty = table(spark, "sites", [])
    assert rows(table_jobs.append_rows(empty, more, ["name"])) == [(1, "a"), (2, "b")]
