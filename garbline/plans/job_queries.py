"""Registered queries: batch table jobs, on request batches derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from garbline.operators import cart_jobs, cascade, status_jobs, table_jobs
from garbline.plans.registry import AS_OF, SUPERVISOR, query
from garbline.plans.views import add_view
from garbline.sources.events import status_commands

# ---------------------------------------------------------------------------
# Request batches: a Spark form and the same rows as an oracle view.
# ---------------------------------------------------------------------------

add_view(
    "cart_requests",
    """
SELECT l_orderkey * 8 + l_linenumber AS seq,
       CASE WHEN l_orderkey % 4 = 0 THEN l_suppkey
            ELSE (l_suppkey * 15 + l_linenumber) % (SELECT count(*) FROM supplier) END AS actor_id,
       CASE WHEN l_orderkey % 97 = 0 THEN 'admin' ELSE 'supervisor' END AS actor_role,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey * 15 + l_linenumber END AS team_member_id,
       CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_partkey END AS product_size_id,
       CAST(l_quantity AS INT) AS quantity
FROM lineitem""",
)


def cart_requests(t):
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    worker = F.col("l_suppkey") * 15 + line
    return t.lineitem.select(
        (order * 8 + line).alias("seq"),
        F.when(order % 4 == 0, F.col("l_suppkey")).otherwise(worker % t.n_supervisors).alias("actor_id"),
        F.when(order % 97 == 0, "admin").otherwise("supervisor").alias("actor_role"),
        F.when(line != 7, worker).alias("team_member_id"),
        F.when(order % 50 != 0, F.col("l_partkey")).alias("product_size_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


add_view(
    "bulk_lines",
    """
SELECT p_partkey % (SELECT count(*) FROM supplier) AS order_id, p_partkey AS product_size_id,
       CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '0' WHEN 3 THEN '-2'
            ELSE CAST(p_size % 5 + 1 AS VARCHAR) END AS quantity
FROM part""",
)


def bulk_lines(t):
    key, kind = F.col("p_partkey"), F.col("p_partkey") % 7
    quantity = (
        F.when(kind == 0, "").when(kind == 1, F.lit(None)).when(kind == 2, "0").when(kind == 3, "-2")
        .otherwise((F.col("p_size") % 5 + 1).cast("string"))
    )
    return t.part.select(
        (key % t.n_supervisors).alias("order_id"), key.alias("product_size_id"), quantity.alias("quantity")
    )


add_view("submissions", "SELECT id AS cart_id, created_at AS submitted_at FROM order_carts WHERE status = 'created'")


def submissions(t):
    return t.order_carts.where(F.col("status") == "created").select(
        F.col("id").alias("cart_id"), F.col("created_at").alias("submitted_at")
    )


add_view(
    "commands",
    """
SELECT user_id AS order_id, ts, event_id,
       CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'submitted' WHEN 'view' THEN 'packed'
            WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'cancelled' END AS command
FROM events""",
)


add_view(
    "garment_returns",
    """
SELECT product_size_id, replace(status, 'returned_', '') AS reason,
       CASE WHEN user_id IS NULL THEN 'worker' ELSE 'self' END AS path
FROM user_uniforms WHERE starts_with(status, 'returned_')""",
)


def garment_returns(t):
    returned = t.user_uniforms.where(F.startswith("status", F.lit("returned_")))
    return returned.select(
        "product_size_id",
        F.replace("status", F.lit("returned_"), F.lit("")).alias("reason"),
        F.when(F.col("user_id").isNull(), "worker").otherwise("self").alias("path"),
    )


add_view(
    "receipts",
    """
SELECT l_partkey AS product_size_id,
       CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '-' || CAST(CAST(l_quantity AS INT) AS VARCHAR)
            WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || 'x'
            ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS amount
FROM lineitem""",
)


def receipts(t):
    amount, line = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    text = F.when(line == 1, "").when(line == 2, F.concat(F.lit("-"), amount)).when(
        line == 3, F.concat(amount, F.lit("x"))
    ).otherwise(amount)
    return t.lineitem.select(F.col("l_partkey").alias("product_size_id"), text.alias("amount"))


add_view(
    "size_changes",
    """
SELECT event_id AS seq, user_id AS team_member_id,
       CASE event_id % 3 WHEN 0 THEN 'SHIRT' WHEN 1 THEN 'PANTS' ELSE 'SHOES' END AS product_type,
       CASE WHEN event_type = 'error' THEN ' ' ELSE CAST(30 + event_id % 15 AS VARCHAR) END AS size
FROM events""",
)


def size_changes(t):
    slot = F.col("event_id") % 3
    return t.events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("team_member_id"),
        F.when(slot == 0, "SHIRT").when(slot == 1, "PANTS").otherwise("SHOES").alias("product_type"),
        F.when(F.col("event_type") == "error", " ")
        .otherwise((F.col("event_id") % 15 + 30).cast("string"))
        .alias("size"),
    )


add_view(
    "delegation_inserts",
    """
SELECT id + r.extra * 1000000000 AS seq, from_supervisor_id,
       CASE WHEN id % 3 = 0 THEN to_supervisor_id
            ELSE (to_supervisor_id + 1) % (SELECT count(*) FROM supplier) END AS to_supervisor_id,
       start_date, end_date
FROM supervisor_delegations CROSS JOIN (VALUES (0), (1)) AS r(extra)""",
)


def delegation_inserts(t):
    moved = F.when(F.col("id") % 3 == 0, F.col("to_supervisor_id")).otherwise(
        (F.col("to_supervisor_id") + 1) % t.n_supervisors
    )
    once = t.supervisor_delegations.select(
        F.col("id").alias("seq"), "from_supervisor_id", moved.alias("to_supervisor_id"), "start_date", "end_date"
    )
    again = once.withColumn("seq", F.col("seq") + 1_000_000_000)
    return once.unionByName(again)


def delegation_commands(t):
    key = F.col("id")
    return t.supervisor_delegations.select(
        key.alias("seq"),
        F.when(key % 7 == 0, F.col("to_supervisor_id")).otherwise(F.col("from_supervisor_id")).alias("actor_id"),
        F.when(key % 4 == 0, "delete").otherwise("extend").alias("action"),
        key.alias("delegation_id"),
        F.date_add("end_date", 30).alias("end_date"),
    )


add_view(
    "incoming_products",
    """
SELECT p_partkey AS seq, p_brand || '-' || CAST(p_size AS VARCHAR) AS article_number,
       CASE WHEN p_partkey % 10 = 0 THEN p_name ELSE p_name || ' ' || p_type END AS name,
       CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(p_size AS VARCHAR) END AS "size_S",
       CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 100 AS VARCHAR) END AS "size_M",
       CAST(p_size * 2 AS VARCHAR) AS "size_L"
FROM part""",
)


def incoming_products(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        key.alias("seq"),
        F.concat_ws("-", "p_brand", size.cast("string")).alias("article_number"),
        F.when(key % 10 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("name"),
        F.col("p_type").alias("type"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        F.array((size % 5 + 1).cast("bigint"), F.lit(6).cast("bigint")).alias("job_role_ids"),
        F.when(size % 4 == 0, F.lit(None)).when(size % 4 == 1, "").otherwise(size.cast("string")).alias("size_S"),
        F.when(key % 2 == 0, (key % 100).cast("string")).alias("size_M"),
        (size * 2).cast("string").alias("size_L"),
    )


add_view(
    "incoming_users",
    """
SELECT c_custkey AS seq, c_name AS full_name,
       CASE WHEN c_custkey % 11 = 0 THEN 's' || CAST(c_custkey % (SELECT count(*) FROM supplier) AS VARCHAR)
            ELSE 'c' || CAST(c_custkey // 2 AS VARCHAR) END || '@example.com' AS email,
       CASE WHEN c_custkey % 5 = 0 THEN 'packer' ELSE 'supervisor' END AS system_role,
       c_custkey % 5 + 1 AS job_role_id, c_custkey % 5 AS site_a, c_custkey * 2 % 5 AS site_b
FROM customer""",
)


def incoming_users(t):
    key = F.col("c_custkey")
    name = F.when(key % 11 == 0, F.concat(F.lit("s"), key % t.n_supervisors)).otherwise(
        F.concat(F.lit("c"), F.call_function("div", key, F.lit(2)))
    )
    return t.customer.select(
        key.alias("seq"),
        F.col("c_name").alias("full_name"),
        F.concat(name, F.lit("@example.com")).alias("email"),
        F.when(key % 5 == 0, "packer").otherwise("supervisor").alias("system_role"),
        (key % 5 + 1).alias("job_role_id"),
        F.lit(None).cast("bigint").alias("supervisor_id"),
        F.col("c_nationkey").cast("bigint").alias("facility_id"),
        F.array(key % 5, key * 2 % 5).alias("site_ids"),
    )


add_view(
    "member_changes",
    """
SELECT user_id AS id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN '  ' ELSE ' Renamed ' || CAST(event_id AS VARCHAR) END AS full_name,
       CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'signup' THEN ' ' ELSE 'N' || CAST(event_id AS VARCHAR) END AS employee_number
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
)


def member_changes(t):
    last = t.events.groupBy(F.col("user_id").alias("id")).agg(F.max(F.struct("event_id", "event_type")).alias("e"))
    number, kind = F.col("e.event_id").cast("string"), F.col("e.event_type")
    return last.select(
        "id",
        F.when(kind == "click", "  ").when(kind != "error", F.concat(F.lit(" Renamed "), number)).alias("full_name"),
        F.when(kind == "signup", " ").when(kind != "view", F.concat(F.lit("N"), number)).alias("employee_number"),
    )


# ---------------------------------------------------------------------------
# Carts, bulk orders, checkout
# ---------------------------------------------------------------------------

_CARTS = """
ok AS (
  SELECT r.* FROM cart_requests r
  WHERE r.actor_role <> 'admin' AND r.product_size_id IS NOT NULL AND EXISTS (
    SELECT 1 FROM team_members tm WHERE tm.id = r.team_member_id AND (tm.supervisor_id = r.actor_id OR EXISTS (
      SELECT 1 FROM supervisor_delegations d WHERE d.from_supervisor_id = tm.supervisor_id
        AND d.to_supervisor_id = r.actor_id
        AND d.start_date <= DATE '1998-06-15' AND d.end_date >= DATE '1998-06-15')))),
actors AS (SELECT actor_id, min(seq) AS first_seq FROM ok GROUP BY actor_id),
latest AS (SELECT supervisor_id AS actor_id, id AS cart_id FROM order_carts WHERE status = 'created'
           QUALIFY row_number() OVER (PARTITION BY supervisor_id ORDER BY created_at DESC, id DESC) = 1),
carts AS (
  SELECT a.actor_id, l.cart_id FROM actors a JOIN latest l USING (actor_id)
  UNION ALL
  SELECT actor_id, (SELECT max(id) FROM order_carts) + row_number() OVER (ORDER BY first_seq, actor_id)
  FROM actors WHERE actor_id NOT IN (SELECT actor_id FROM latest))"""


@query(
    "cart_coalesce",
    f"""
WITH {_CARTS},
lines AS (
  SELECT oi.cart_id, oi.product_size_id, oi.team_member_id, sum(oi.quantity) AS quantity, min(oi.price_at_time) AS price,
         -1 AS seq
  FROM order_items oi WHERE oi.cart_id IN (SELECT cart_id FROM carts) GROUP BY ALL
  UNION ALL
  SELECT c.cart_id, ok.product_size_id, ok.team_member_id, sum(ok.quantity), min(p.price), min(ok.seq)
  FROM ok JOIN carts c USING (actor_id) JOIN product_sizes ps ON ps.id = ok.product_size_id
  JOIN products p ON p.id = ps.product_id GROUP BY ALL)
SELECT cart_id, product_size_id, team_member_id, CAST(sum(quantity) AS BIGINT) AS quantity,
       CAST(min_by(price, seq) AS DOUBLE) AS price_at_time
FROM lines GROUP BY cart_id, product_size_id, team_member_id""",
)
def cart_coalesce(t):
    lines, _, _ = cart_jobs.add_to_carts(cart_requests(t), t, AS_OF)
    return lines.withColumn("price_at_time", F.col("price_at_time").cast("double"))


@query(
    "cart_rejects",
    """
SELECT seq, actor_id, team_member_id, product_size_id,
       CASE WHEN actor_role = 'admin' THEN 'admins cannot order'
            WHEN product_size_id IS NULL THEN 'no size selected' ELSE 'invalid team member' END AS reason
FROM cart_requests r
WHERE actor_role = 'admin' OR product_size_id IS NULL OR NOT EXISTS (
  SELECT 1 FROM team_members tm WHERE tm.id = r.team_member_id AND (tm.supervisor_id = r.actor_id OR EXISTS (
    SELECT 1 FROM supervisor_delegations d WHERE d.from_supervisor_id = tm.supervisor_id
      AND d.to_supervisor_id = r.actor_id
      AND d.start_date <= DATE '1998-06-15' AND d.end_date >= DATE '1998-06-15')))""",
)
def cart_rejects(t):
    checked = cart_jobs.check_cart_requests(cart_requests(t), t, AS_OF)
    return checked.where(F.col("reason").isNotNull()).select("seq", "actor_id", "team_member_id", "product_size_id", "reason")


def _bulk_workers(t):
    return t.team_members.select(F.col("supervisor_id").alias("order_id"), F.col("id").alias("team_member_id"))


def _bulk(t, lines=None):
    orders = t.users.where(F.col("system_role") == "supervisor").select(
        F.col("id").alias("order_id"), F.col("id").alias("supervisor_id")
    )
    return cart_jobs.bulk_order(orders, _bulk_workers(t), bulk_lines(t) if lines is None else lines, t)


_BULK_LINES = """
bulk AS (
  SELECT p_partkey % (SELECT count(*) FROM supplier) AS order_id, p_partkey AS product_size_id,
         CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN -2 ELSE p_size % 5 + 1 END AS quantity,
         min(CAST(p_retailprice AS DECIMAL(12,2))) OVER (PARTITION BY p_brand, p_name) AS price
  FROM part),
heads AS (SELECT c_custkey % (SELECT count(*) FROM supplier) AS order_id, count(*) AS workers FROM customer GROUP BY 1)"""


@query(
    "bulk_order",
    f"""
WITH {_BULK_LINES}
SELECT order_id, product_size_id, CAST(quantity AS INT) AS quantity, CAST(price AS DOUBLE) AS price_at_time FROM bulk WHERE quantity > 0""",
)
def bulk_order(t):
    _, lines, _ = _bulk(t)
    return lines.withColumn("price_at_time", F.col("price_at_time").cast("double"))


@query(
    "bulk_order_carts",
    f"""
WITH {_BULK_LINES}
SELECT h.order_id AS id, h.order_id AS supervisor_id, 'created' AS status, h.workers,
       count(*) FILTER (quantity > 0) AS lines,
       CAST(coalesce(sum(quantity * price) FILTER (quantity > 0) * any_value(h.workers), 0) AS DOUBLE) AS total_price
FROM heads h JOIN bulk b ON b.order_id = h.order_id GROUP BY h.order_id, h.workers""",
)
def bulk_order_carts(t):
    carts, _, _ = _bulk(t)
    return carts.withColumn("total_price", F.col("total_price").cast("double"))


@query(
    "bulk_items",
    f"""
WITH {_BULK_LINES}
SELECT b.order_id AS cart_id, b.product_size_id, c_custkey AS team_member_id, CAST(b.quantity AS INT) AS quantity,
       CAST(b.price AS DOUBLE) AS price_at_time
FROM bulk b JOIN customer ON c_custkey % (SELECT count(*) FROM supplier) = b.order_id
WHERE b.quantity > 0 AND b.order_id = {SUPERVISOR}""",
)
def bulk_items(t):
    carts, lines, _ = _bulk(t)
    asked = carts.where(F.col("id") == SUPERVISOR)
    items = cart_jobs.bulk_items(asked, _bulk_workers(t), lines)
    return items.withColumn("price_at_time", F.col("price_at_time").cast("double"))


@query(
    "bulk_rejects",
    """
SELECT DISTINCT p_partkey % (SELECT count(*) FROM supplier) AS order_id,
       p_partkey % (SELECT count(*) FROM supplier) AS supervisor_id, 'invalid quantity' AS reason
FROM part WHERE p_partkey % 30 = 7""",
)
def bulk_rejects(t):
    # some quantities are no numbers
    broken = bulk_lines(t).withColumn(
        "quantity", F.when(F.col("product_size_id") % 30 == 7, F.concat_ws("", F.lit("4"), F.lit("x"))).otherwise(F.col("quantity"))
    )
    return _bulk(t, broken)[2]


_VERDICTS = """
verdicts AS (
  SELECT s.cart_id, s.submitted_at, oc.supervisor_id, coalesce(li.total, 0) AS total, coalesce(us.used, 0) AS used,
         CASE WHEN u.monthly_budget <> 0 THEN u.monthly_budget END AS budget,
         CASE WHEN li.total IS NULL THEN 'cart is empty'
              WHEN u.monthly_budget <> 0 AND coalesce(us.used, 0) + li.total > u.monthly_budget
              THEN 'monthly budget exceeded' END AS reason
  FROM submissions s JOIN order_carts oc ON oc.id = s.cart_id LEFT JOIN users u ON u.id = oc.supervisor_id
  LEFT JOIN (SELECT cart_id, sum(quantity * price_at_time) AS total FROM order_items GROUP BY cart_id) li
    ON li.cart_id = s.cart_id
  LEFT JOIN (SELECT supervisor_id, sum(total_price) AS used FROM order_carts
             WHERE status IN ('packed', 'completed')
               AND created_at >= TIMESTAMP '1998-06-01' AND created_at < TIMESTAMP '1998-07-01'
             GROUP BY supervisor_id) us ON us.supervisor_id = oc.supervisor_id)"""


@query(
    "checkout_budget",
    f"""
WITH {_VERDICTS}
SELECT cart_id, submitted_at, supervisor_id, CAST(total AS DOUBLE) AS total, CAST(used AS DOUBLE) AS used,
       CAST(budget AS DOUBLE) AS budget, reason
FROM verdicts""",
)
def checkout_budget(t):
    verdicts = cart_jobs.budget_verdicts(submissions(t), t, AS_OF)
    return verdicts.withColumns({c: F.col(c).cast("double") for c in ("total", "used", "budget")})


# The oracle walks the carts one by one in order of submission, with the stock of the
# contested SKUs as a list that every accepted cart lowers.
_STOCK_WALK = f"""
WITH RECURSIVE {_VERDICTS},
need AS (
  SELECT v.cart_id, oi.product_size_id AS sku, sum(oi.quantity) AS need
  FROM verdicts v JOIN order_items oi ON oi.cart_id = v.cart_id WHERE v.reason IS NULL GROUP BY ALL),
contested AS (
  SELECT sku, any_value(ps.stock) AS stock, row_number() OVER (ORDER BY sku) AS pos
  FROM need JOIN product_sizes ps ON ps.id = need.sku GROUP BY sku HAVING sum(need) > any_value(ps.stock)),
walk AS (
  SELECT cart_id, row_number() OVER (ORDER BY submitted_at, cart_id) AS step, wants
  FROM (SELECT n.cart_id, list({{'pos': c.pos, 'need': n.need}}) AS wants
        FROM need n JOIN contested c ON c.sku = n.sku GROUP BY n.cart_id)
  JOIN verdicts USING (cart_id)),
sim(step, cart_id, accepted, stock) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), true, (SELECT list(CAST(stock AS HUGEINT) ORDER BY pos) FROM contested)
  UNION ALL
  SELECT w.step, w.cart_id, list_bool_and(list_transform(w.wants, lambda x: s.stock[x.pos] >= x.need)),
         CASE WHEN list_bool_and(list_transform(w.wants, lambda x: s.stock[x.pos] >= x.need))
              THEN list_transform(s.stock, lambda q, i: q - coalesce(list_sum(list_transform(
                     list_filter(w.wants, lambda x: x.pos = i), lambda x: x.need)), 0))
              ELSE s.stock END
  FROM sim s JOIN walk w ON w.step = s.step + 1),
refused AS (SELECT cart_id FROM sim WHERE NOT accepted)"""


@query(
    "checkout_stock",
    f"""{_STOCK_WALK}
SELECT v.cart_id, coalesce(v.reason, CASE WHEN r.cart_id IS NOT NULL THEN 'not enough stock' END, 'submitted') AS outcome
FROM verdicts v LEFT JOIN refused r ON r.cart_id = v.cart_id""",
)
def checkout_stock(t):
    _, _, rejects = cart_jobs.checkout(submissions(t), t, AS_OF)
    asked = submissions(t).select("cart_id")
    return asked.join(rejects, "cart_id", "left").select(
        "cart_id", F.coalesce("reason", F.lit("submitted")).alias("outcome")
    )


@query(
    "checkout_carts",
    f"""{_STOCK_WALK},
done AS (SELECT v.cart_id, v.total FROM verdicts v WHERE v.reason IS NULL AND v.cart_id NOT IN (SELECT cart_id FROM refused))
SELECT oc.id, oc.supervisor_id,
       CASE WHEN d.cart_id IS NULL THEN oc.team_member_id
            ELSE (SELECT min(team_member_id) FROM order_items oi WHERE oi.cart_id = oc.id) END AS team_member_id,
       CASE WHEN d.cart_id IS NULL THEN oc.status ELSE 'submitted' END AS status,
       CAST(CASE WHEN d.cart_id IS NULL THEN oc.total_price ELSE d.total END AS DOUBLE) AS total_price
FROM order_carts oc LEFT JOIN done d ON d.cart_id = oc.id""",
)
def checkout_carts(t):
    carts, _, _ = cart_jobs.checkout(submissions(t), t, AS_OF)
    return carts.select(
        "id", "supervisor_id", "team_member_id", "status", F.col("total_price").cast("double").alias("total_price")
    )


@query(
    "checkout_skus",
    f"""{_STOCK_WALK},
taken AS (SELECT sku, sum(need) AS units FROM need WHERE cart_id NOT IN (SELECT cart_id FROM refused) GROUP BY sku)
SELECT ps.id, CAST(ps.stock - coalesce(t.units, 0) AS BIGINT) AS stock FROM product_sizes ps LEFT JOIN taken t ON t.sku = ps.id""",
)
def checkout_skus(t):
    _, skus, _ = cart_jobs.checkout(submissions(t), t, AS_OF)
    return skus.select("id", "stock")


# ---------------------------------------------------------------------------
# Status, garments, stock
# ---------------------------------------------------------------------------

_FOLD = """
SELECT oc.id, oc.status AS status_before,
       CASE WHEN c.last_cancel IS NOT NULL AND (c.last_set IS NULL OR c.last_cancel > c.last_set)
             AND coalesce(c.set_to, oc.status) NOT IN ('packed', 'completed') THEN 'cancelled'
            ELSE coalesce(c.set_to, oc.status) END AS status
FROM order_carts oc LEFT JOIN (
  SELECT order_id, max((ts, event_id)) FILTER (command <> 'cancelled') AS last_set,
         max((ts, event_id)) FILTER (command = 'cancelled') AS last_cancel,
         max_by(command, (ts, event_id)) FILTER (command <> 'cancelled') AS set_to
  FROM commands GROUP BY order_id) c ON c.order_id = oc.id"""


@query("status_fold", _FOLD)
def status_fold(t):
    before = t.order_carts.select("id", "status", F.col("status").alias("status_before"))
    return status_jobs.apply_status(before, status_commands(t.events)).select("id", "status_before", "status")


@query(
    "issue_garments",
    """
SELECT oi.cart_id, oi.product_size_id, oi.team_member_id, 'active' AS status, TIMESTAMP '1998-06-15' AS issued_at,
       CAST(NULL AS TIMESTAMP) AS returned_at
FROM order_items oi JOIN order_carts oc ON oc.id = oi.cart_id WHERE oc.status = 'completed'""",
)
def issue_garments(t):
    completed = t.order_carts.where(F.col("status") == "completed").select(F.col("id").alias("cart_id"))
    return status_jobs.issue_garments(t.order_items, completed, AS_OF)


@query(
    "returns_restock",
    """
SELECT ps.id, ps.product_id, ps.size, CAST(ps.stock + coalesce(r.n, 0) AS BIGINT) AS stock
FROM product_sizes ps LEFT JOIN (
  SELECT product_size_id, count(*) AS n FROM garment_returns
  WHERE reason <> 'lost' AND (path = 'self' OR reason <> 'stolen') GROUP BY product_size_id) r ON r.product_size_id = ps.id""",
)
def returns_restock(t):
    return status_jobs.restock(t.product_sizes, garment_returns(t))


_GARMENTS = """
garments AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS sku, l_linenumber AS line, min(l_shipdate) AS issued
  FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL),
marks AS (
  SELECT g.id, g.sku, g.issued + to_days(CAST(30 + g.id % 2 * k AS INT)) AS back, g.id * 2 + k AS seq,
         CASE (g.id + k) % 4 WHEN 0 THEN 'worn_out' WHEN 1 THEN 'lost' WHEN 2 THEN 'stolen' ELSE 'damaged' END AS reason
  FROM garments g, (VALUES (0), (1)) AS v(k) WHERE g.id % 3 <> 0)"""


def _garments(t):
    """Garments with a number each, and up to two returns of most of them, some at the same time."""
    garments = (
        t.lineitem.where(F.col("l_linenumber") != 7)
        .groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("product_size_id"))
        .agg(F.min("l_shipdate").alias("issued_at"))
        .withColumns({"status": F.lit("active"), "returned_at": F.lit(None).cast("timestamp_ntz")})
    )
    twice = garments.where(F.col("id") % 3 != 0).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    turn = (F.col("id") + F.col("k")) % 4
    returns = twice.select(
        (F.col("id") * 2 + F.col("k")).alias("seq"),
        F.col("id").alias("garment_id"),
        F.when(turn == 0, "worn_out").when(turn == 1, "lost").when(turn == 2, "stolen").otherwise("damaged").alias("reason"),
        F.lit("self").alias("path"),
        (F.col("issued_at") + F.make_interval(days=(F.lit(30) + F.col("id") % 2 * F.col("k")).cast("int"))).alias("at"),
    )
    return garments, returns


@query(
    "returns_garments",
    f"""
WITH {_GARMENTS},
last AS (SELECT id, sku, arg_max(reason, (back, seq)) AS reason, max(back) AS back FROM marks GROUP BY ALL)
SELECT g.id, g.sku AS product_size_id, coalesce('returned_' || l.reason, 'active') AS status, l.back AS returned_at
FROM garments g LEFT JOIN last l ON l.id = g.id AND l.sku = g.sku
WHERE g.id IN (SELECT id FROM garments GROUP BY id HAVING count(*) = 1)""",
)
def returns_garments(t):
    garments, returns = _garments(t)
    # an order line may hold several SKUs under one number here
    single = garments.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
    after, _ = status_jobs.apply_returns(garments, t.product_sizes, returns)
    return after.join(single, "id", "left_semi").select("id", "product_size_id", "status", "returned_at")


@query(
    "replacements",
    f"""
WITH {_GARMENTS}
SELECT id, sku AS product_size_id, CASE WHEN id % 5 = 1 THEN 'lost' ELSE 'active' END AS status,
       CAST(NULL AS TIMESTAMP) AS returned_at
FROM garments""",
)
def replacements(t):
    garments, _ = _garments(t)
    asked = garments.where(F.col("id") % 5 == 1).select(F.col("id").alias("garment_id"))
    return status_jobs.request_replacement(garments, asked).select("id", "product_size_id", "status", "returned_at")


@query(
    "stock_receipts",
    """
SELECT ps.id, ps.product_id, ps.size, CAST(ps.stock + coalesce(r.n, 0) AS BIGINT) AS stock
FROM product_sizes ps LEFT JOIN (
  SELECT product_size_id, sum(CAST(amount AS BIGINT)) AS n FROM receipts
  WHERE regexp_full_match(amount, '[0-9]+') GROUP BY product_size_id) r ON r.product_size_id = ps.id""",
)
def stock_receipts(t):
    return table_jobs.receive_stock(t.product_sizes, receipts(t))


# ---------------------------------------------------------------------------
# Upserts, toggles, loads, updates, deletes
# ---------------------------------------------------------------------------


@query(
    "merge_sizes",
    """
WITH last AS (SELECT team_member_id, product_type, trim(size) AS size FROM size_changes
              QUALIFY row_number() OVER (PARTITION BY team_member_id, product_type ORDER BY seq DESC) = 1)
SELECT ws.* FROM worker_sizes ws
WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.team_member_id = ws.team_member_id AND l.product_type = ws.product_type)
UNION ALL SELECT * FROM last WHERE size <> ''""",
)
def merge_sizes(t):
    return table_jobs.merge_sizes(t.worker_sizes, size_changes(t))


@query(
    "delegation_insert",
    """
SELECT (SELECT max(id) FROM supervisor_delegations) + row_number() OVER (ORDER BY seq) AS id,
       from_supervisor_id, to_supervisor_id, start_date, end_date
FROM (SELECT from_supervisor_id, to_supervisor_id, start_date, end_date, min(seq) AS seq
      FROM delegation_inserts GROUP BY ALL) i
WHERE NOT EXISTS (SELECT 1 FROM supervisor_delegations d WHERE d.from_supervisor_id = i.from_supervisor_id
  AND d.to_supervisor_id = i.to_supervisor_id AND d.start_date = i.start_date AND d.end_date = i.end_date)""",
)
def delegation_insert(t):
    news, _ = table_jobs.insert_delegations(t.supervisor_delegations, delegation_inserts(t))
    return news.select("id", "from_supervisor_id", "to_supervisor_id", "start_date", "end_date")


@query(
    "delegation_maintain",
    """
SELECT id, from_supervisor_id, to_supervisor_id, start_date,
       CASE WHEN id % 7 <> 0 OR to_supervisor_id = from_supervisor_id THEN CAST(end_date + INTERVAL 30 DAY AS DATE)
            ELSE end_date END AS end_date
FROM supervisor_delegations
WHERE id % 4 <> 0 OR (id % 7 = 0 AND to_supervisor_id <> from_supervisor_id)""",
)
def delegation_maintain(t):
    return table_jobs.maintain_delegations(t.supervisor_delegations, delegation_commands(t))


# The oracle replays the batch for each insert: the delegation's dates after its last change before the insert.
@query(
    "delegation_merge",
    """
WITH cmds AS (
  SELECT id * 10 AS seq, id, id % 4 = 0 AS gone, CAST(end_date + INTERVAL 30 DAY AS DATE) AS to_end FROM supervisor_delegations
  WHERE id % 7 <> 0 OR to_supervisor_id = from_supervisor_id),
ins AS (
  SELECT id * 10 + CASE WHEN id % 2 = 0 THEN -3 ELSE 5 END AS seq, from_supervisor_id, to_supervisor_id, start_date,
         CASE WHEN id % 3 = 0 THEN CAST(end_date + INTERVAL 30 DAY AS DATE) ELSE end_date END AS end_date
  FROM supervisor_delegations),
free AS (
  SELECT i.* FROM ins i WHERE NOT EXISTS (
    SELECT 1 FROM supervisor_delegations d
    WHERE d.from_supervisor_id = i.from_supervisor_id AND d.to_supervisor_id = i.to_supervisor_id AND d.start_date = i.start_date
      AND NOT EXISTS (SELECT 1 FROM cmds c WHERE c.id = d.id AND c.gone AND c.seq <= i.seq)
      AND coalesce((SELECT max_by(to_end, seq) FROM cmds c WHERE c.id = d.id AND c.seq <= i.seq), d.end_date) = i.end_date)),
news AS (SELECT from_supervisor_id, to_supervisor_id, start_date, end_date, min(seq) AS seq FROM free GROUP BY ALL)
SELECT d.id, from_supervisor_id, to_supervisor_id, start_date, coalesce(c.to_end, d.end_date) AS end_date
FROM supervisor_delegations d LEFT JOIN cmds c ON c.id = d.id WHERE NOT coalesce(c.gone, false)
UNION ALL
SELECT (SELECT max(id) FROM supervisor_delegations) + row_number() OVER (ORDER BY seq), from_supervisor_id, to_supervisor_id,
       start_date, end_date FROM news""",
)
def delegation_merge(t):
    key = F.col("id")
    commands = delegation_commands(t).withColumn("seq", F.col("seq") * 10)
    inserts = t.supervisor_delegations.select(
        (key * 10 + F.when(key % 2 == 0, -3).otherwise(5)).alias("seq"), "from_supervisor_id", "to_supervisor_id", "start_date",
        F.when(key % 3 == 0, F.date_add("end_date", 30)).otherwise(F.col("end_date")).alias("end_date"),
    )
    return table_jobs.merge_delegations(t.supervisor_delegations, commands, inserts)[0]


@query("like_toggle", "SELECT post_id, user_id FROM news_likes")
def like_toggle(t):
    return table_jobs.toggle_state(t.news_like_clicks, ["post_id", "user_id"])


@query(
    "pin_toggle",
    """
SELECT np.id, CAST(CASE WHEN c.n IS NULL THEN np.pinned WHEN c.n % 2 = 1 THEN 1 - coalesce(np.pinned, 0)
                   ELSE coalesce(np.pinned, 0) END AS INT) AS pinned
FROM news_posts np LEFT JOIN (SELECT post_id, count(*) AS n FROM news_like_clicks GROUP BY post_id) c ON c.post_id = np.id""",
)
def pin_toggle(t):
    return table_jobs.toggle_pins(t.news_posts.select("id", "pinned"), t.news_like_clicks)


@query(
    "read_marks",
    """
SELECT event_id % (SELECT count(*) FROM documents) AS post_id, user_id, min(ts) AS first_seen
FROM events WHERE event_type = 'view' GROUP BY 1, 2""",
)
def read_marks(t):
    marks = t.events.where(F.col("event_type") == "view").select(
        (F.col("event_id") % t.n_posts).alias("post_id"), "user_id", "ts"
    )
    return table_jobs.first_seen(marks, ["post_id", "user_id"], "ts")


@query(
    "size_unpivot",
    """
SELECT seq, 'S' AS size, coalesce(CAST(nullif("size_S", '') AS BIGINT), 0) AS stock FROM incoming_products WHERE "size_S" IS NOT NULL
UNION ALL
SELECT seq, 'M', coalesce(CAST(nullif("size_M", '') AS BIGINT), 0) FROM incoming_products WHERE "size_M" IS NOT NULL
UNION ALL
SELECT seq, 'L', coalesce(CAST(nullif("size_L", '') AS BIGINT), 0) FROM incoming_products WHERE "size_L" IS NOT NULL""",
)
def size_unpivot(t):
    return table_jobs.unpivot_sizes(incoming_products(t), ["seq"])


# The oracle takes the rows one by one, carrying the names and article numbers accepted so far.
@query(
    "product_load",
    """
WITH RECURSIVE steps AS (
  SELECT seq, name, article_number, row_number() OVER (ORDER BY seq) AS step,
         name IN (SELECT name FROM products) AS old_name,
         article_number IN (SELECT article_number FROM products) AS old_article
  FROM incoming_products),
sim(step, seq, outcome, names, articles) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT step, seq, outcome, CASE WHEN outcome = 'loaded' THEN list_append(names, name) ELSE names END,
         CASE WHEN outcome = 'loaded' THEN list_append(articles, article_number) ELSE articles END
  FROM (SELECT f.step, f.seq, f.name, f.article_number, s.names, s.articles,
               CASE WHEN f.old_name OR list_contains(s.names, f.name) THEN 'name exists'
                    WHEN f.old_article OR list_contains(s.articles, f.article_number) THEN 'article number exists'
                    ELSE 'loaded' END AS outcome
        FROM sim s JOIN steps f ON f.step = s.step + 1))
SELECT i.seq, i.name, i.article_number, sim.outcome FROM incoming_products i JOIN sim ON sim.seq = i.seq""",
)
def product_load(t):
    incoming = incoming_products(t)
    loaded = table_jobs.load_products(t.products, incoming)
    refused = loaded.rejects.select("seq", F.col("reason").alias("outcome"))
    return incoming.select("seq", "name", "article_number").join(refused, "seq", "left").withColumn(
        "outcome", F.coalesce("outcome", F.lit("loaded"))
    )


@query(
    "product_load_rejects",
    """
SELECT seq, name, article_number, 'invalid size amount' AS reason FROM incoming_products WHERE seq % 9 = 4""",
)
def product_load_rejects(t):
    # every ninth row says its size in words
    broken = incoming_products(t).withColumn("size_L", F.when(F.col("seq") % 9 == 4, F.concat(F.col("size_L"), F.lit("x"))).otherwise(F.col("size_L")))
    rejects = table_jobs.load_products(t.products, broken).rejects
    return rejects.where(F.col("reason") == "invalid size amount")


_USERS_FREE = """
first AS (SELECT email, min(seq) AS seq FROM incoming_users GROUP BY email),
free AS (SELECT seq, (SELECT max(id) FROM users) + row_number() OVER (ORDER BY seq) AS id FROM first
         WHERE email NOT IN (SELECT email FROM users))"""


@query(
    "user_load",
    f"""
WITH {_USERS_FREE}
SELECT f.id, i.full_name, i.email, i.system_role,
       CASE WHEN i.system_role = 'packer' THEN (SELECT id FROM job_roles WHERE name = 'Packer') ELSE i.job_role_id END
         AS job_role_id
FROM free f JOIN incoming_users i USING (seq)""",
)
def user_load(t):
    return table_jobs.load_users(t.users, incoming_users(t), t.job_roles).users.select(
        "id", "full_name", "email", "system_role", "job_role_id"
    )


@query(
    "user_load_sites",
    f"""
WITH {_USERS_FREE}
SELECT f.id AS user_id, i.site_a AS site_id FROM free f JOIN incoming_users i USING (seq)
UNION SELECT f.id, i.site_b FROM free f JOIN incoming_users i USING (seq)""",
)
def user_load_sites(t):
    return table_jobs.load_users(t.users, incoming_users(t), t.job_roles).user_sites


def _left(tables, keys):
    """What is left of each table: its keys as text, with the number of rows of each."""
    rows = None
    for name, df in tables.items():
        key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in keys.get(name, ["id"])])
        part = df.groupBy(key.alias("key")).agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("table_name"), "key", "rows_left")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _left_sql(parts: dict[str, tuple[str, str]]) -> str:
    """The same from DuckDB: key expression and condition by table."""
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, {key} AS key, count(*) AS rows_left FROM {name} WHERE {kept} GROUP BY ALL"
        for name, (key, kept) in parts.items()
    )


_DOOMED = """
doomed AS (SELECT id FROM users WHERE monthly_budget IS NULL AND id <> -1),
members AS (SELECT id FROM team_members WHERE supervisor_id IN (SELECT id FROM doomed)),
gone_carts AS (SELECT id FROM order_carts WHERE supervisor_id IN (SELECT id FROM doomed))"""
_NOT_MEMBERS = "(team_member_id IS NULL OR team_member_id NOT IN (SELECT id FROM members))"


@query(
    "cascade_delete",
    f"WITH {_DOOMED}\n"
    + _left_sql(
        {
            "users": ("id::VARCHAR", "id NOT IN (SELECT id FROM doomed)"),
            "team_members": ("id::VARCHAR", "id NOT IN (SELECT id FROM members)"),
            "worker_sizes": ("team_member_id || '/' || product_type", "team_member_id NOT IN (SELECT id FROM members)"),
            "user_uniforms": ("product_size_id || '/' || coalesce(team_member_id::VARCHAR, '-')", _NOT_MEMBERS),
            "order_items": (
                "cart_id || '/' || product_size_id || '/' || coalesce(team_member_id::VARCHAR, '-')",
                f"{_NOT_MEMBERS} AND cart_id NOT IN (SELECT id FROM gone_carts)",
            ),
            "order_carts": ("id::VARCHAR", "id NOT IN (SELECT id FROM gone_carts)"),
        }
    ),
)
def cascade_delete(t):
    requests = t.users.where(F.col("monthly_budget").isNull()).select(
        F.col("id").alias("seq"), F.lit(-1).cast("bigint").alias("actor_id"), F.col("id").alias("user_id")
    )
    doomed, _ = table_jobs.guard_user_deletes(t.users, requests)
    keys = {
        "worker_sizes": ["team_member_id", "product_type"],
        "user_uniforms": ["product_size_id", "team_member_id"],
        "order_items": ["cart_id", "product_size_id", "team_member_id"],
    }
    return _left(cascade.cascade_delete(t, "users", doomed)[0], keys)


@query(
    "cascade_delete_posts",
    "WITH doomed AS (SELECT id FROM news_posts WHERE pinned = 0)\n"
    + _left_sql(
        {
            "news_posts": ("id::VARCHAR", "id NOT IN (SELECT id FROM doomed)"),
            "news_comments": ("id::VARCHAR", "post_id NOT IN (SELECT id FROM doomed)"),
            "news_likes": ("post_id || '/' || user_id", "post_id NOT IN (SELECT id FROM doomed)"),
            "news_reads": ("post_id || '/' || user_id", "post_id NOT IN (SELECT id FROM doomed)"),
        }
    ),
)
def cascade_delete_posts(t):
    doomed = t.news_posts.where(F.col("pinned") == 0).select(F.col("id").alias("post_id"))
    return _left(cascade.cascade_delete(t, "news_posts", doomed)[0], {n: ["post_id", "user_id"] for n in ("news_likes", "news_reads")})


@query(
    "cascade_delete_products",
    """
WITH doomed AS (SELECT id FROM products WHERE type IS NULL),
skus AS (SELECT id FROM product_sizes WHERE product_id IN (SELECT id FROM doomed))
"""
    + _left_sql(
        {
            "products": ("id", "id NOT IN (SELECT id FROM doomed)"),
            "product_sizes": ("id::VARCHAR", "product_id NOT IN (SELECT id FROM doomed)"),
            "product_job_roles": ("product_id || '/' || job_role_id", "product_id NOT IN (SELECT id FROM doomed)"),
            "order_items": ("cart_id || '/' || product_size_id", "product_size_id NOT IN (SELECT id FROM skus)"),
        }
    ),
)
def cascade_delete_products(t):
    doomed = t.products.where(F.col("type").isNull()).select(F.col("id").alias("product_id"))
    keys = {"product_job_roles": ["product_id", "job_role_id"], "order_items": ["cart_id", "product_size_id"]}
    return _left(cascade.cascade_delete(t, "products", doomed)[0], keys)


def _dimension_delete(t, table, rows):
    """What is left of a dimension after a request for ``rows`` of it, and which were refused."""
    left, refused = cascade.cascade_delete(t, table, rows)
    kept = left[table].select("id", F.lit("left").alias("outcome"))
    return kept.unionByName(refused.select(F.col("root_id").alias("id"), F.lit("refused").alias("outcome")))


def _dimension_sql(table, rows, used):
    return f"""
WITH asked AS (SELECT id FROM {table} WHERE {rows}), used AS ({used})
SELECT id, 'left' AS outcome FROM {table} WHERE id NOT IN (SELECT id FROM asked) OR id IN (SELECT id FROM used WHERE id IS NOT NULL)
UNION ALL SELECT id, 'refused' FROM asked WHERE id IN (SELECT id FROM used WHERE id IS NOT NULL)"""


@query(
    "cascade_delete_facilities",
    _dimension_sql("facilities", "id % 2 = 0", "SELECT facility_id AS id FROM users UNION SELECT facility_id FROM team_members"),
)
def cascade_delete_facilities(t):
    return _dimension_delete(t, "facilities", t.facilities.where("id % 2 = 0").select("id"))


@query(
    "cascade_delete_roles",
    _dimension_sql(
        "job_roles", "true", "SELECT job_role_id AS id FROM users UNION SELECT job_role_id FROM team_members UNION SELECT job_role_id FROM product_job_roles"
    ),
)
def cascade_delete_roles(t):
    return _dimension_delete(t, "job_roles", t.job_roles.select("id"))


@query("cascade_delete_sites", _dimension_sql("sites", "id <> 1", "SELECT site_id AS id FROM user_sites"))
def cascade_delete_sites(t):
    return _dimension_delete(t, "sites", t.sites.where("id <> 1").select("id"))


@query(
    "unreferenced_dims",
    """
SELECT 'role' AS kind, id, name FROM job_roles
WHERE id NOT IN (SELECT job_role_id FROM users WHERE job_role_id IS NOT NULL)
  AND id NOT IN (SELECT job_role_id FROM team_members WHERE job_role_id IS NOT NULL)
  AND id NOT IN (SELECT job_role_id FROM product_job_roles)
UNION ALL
SELECT 'facility', id, name FROM facilities
WHERE id NOT IN (SELECT facility_id FROM users WHERE facility_id IS NOT NULL)
  AND id NOT IN (SELECT facility_id FROM team_members WHERE facility_id IS NOT NULL)
UNION ALL
SELECT 'site', id, name FROM sites WHERE id NOT IN (SELECT site_id FROM user_sites)""",
)
def unreferenced_dims(t):
    free = {
        "role": table_jobs.unreferenced(
            t.job_roles,
            [(t.users, "job_role_id"), (t.team_members, "job_role_id"), (t.product_job_roles, "job_role_id")],
        ),
        "facility": table_jobs.unreferenced(
            t.facilities, [(t.users, "facility_id"), (t.team_members, "facility_id")]
        ),
        "site": table_jobs.unreferenced(t.sites, [(t.user_sites, "site_id")]),
    }
    rows = [df.select(F.lit(kind).alias("kind"), "id", "name") for kind, df in free.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "partial_update",
    """
SELECT tm.id, CASE WHEN named THEN trim(c.full_name) ELSE tm.full_name END AS full_name,
       CASE WHEN named THEN nullif(trim(c.employee_number), '') ELSE tm.employee_number END AS employee_number,
       tm.supervisor_id, tm.facility_id, tm.job_role_id
FROM team_members tm LEFT JOIN (SELECT *, coalesce(length(trim(full_name)), 0) > 0 AS named FROM member_changes) c ON c.id = tm.id""",
)
def partial_update(t):
    return table_jobs.apply_updates(
        t.team_members, member_changes(t), "id", only_if="full_name", blank_is_null=("employee_number",)
    )


@query(
    "scoped_delete",
    """
SELECT tm.* FROM team_members tm
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = tm.id
                  AND e.event_id % (SELECT count(*) FROM supplier) = tm.supervisor_id)""",
)
def scoped_delete(t):
    requests = t.events.where(F.col("event_type") == "error").select(
        F.col("user_id").alias("id"), (F.col("event_id") % t.n_supervisors).alias("supervisor_id")
    )
    return table_jobs.apply_deletes(t.team_members, requests, ["id", "supervisor_id"]).select(*t.team_members.columns)


@query(
    "append_rows",
    """
SELECT * FROM team_members
UNION ALL
SELECT (SELECT max(id) FROM team_members) + row_number() OVER (ORDER BY s_name), s_name,
       'S' || CAST(s_suppkey AS VARCHAR), s_suppkey, NULL, NULL
FROM supplier""",
)
def append_rows(t):
    rows = t.supplier.select(
        F.col("s_name").alias("full_name"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("employee_number"),
        F.col("s_suppkey").alias("supervisor_id"),
    )
    return table_jobs.append_rows(t.team_members, rows, ["full_name"])
