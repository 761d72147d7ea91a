"""Registered queries: joined relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from garbline.operators import joins
from garbline.plans.registry import AS_OF, JOB_ROLE, SUPERVISOR, query
from garbline.plans.views import FACTS, WIDE

_LIVE = "start_date <= DATE '1998-06-15' AND end_date >= DATE '1998-06-15'"

_CART_LINES = f"""
WITH {FACTS}
SELECT o AS cart_id, what AS product_name, article AS article_number, fit AS size, q AS quantity, price AS price_at_time,
       worth AS subtotal, who AS worker_name"""


@query(
    "cart_lines",
    f"{_CART_LINES} FROM told WHERE o IN (SELECT o FROM heads WHERE state = 'created')",
)
def cart_lines(t):
    open_carts = t.order_carts.where(F.col("status") == "created").select(F.col("id").alias("cart_id"))
    items = joins.for_keys(t.order_items, open_carts, "cart_id")
    return joins.order_lines(items, t.product_sizes, t.products, t.team_members).drop("employee_number")


@query("order_detail", f"{_CART_LINES}, badge AS employee_number FROM told")
def order_detail(t):
    return joins.order_lines(t.order_items, t.product_sizes, t.products, t.team_members)


@query(
    "order_header",
    f"""
WITH {FACTS}
SELECT o AS order_id, boss AS supervisor_id, state AS status, day AS created_at, CAST(total AS DOUBLE) AS total_price,
       (SELECT s_name FROM supplier WHERE s_suppkey = boss) AS supervisor_name,
       (SELECT who FROM people WHERE w = named) AS worker_name, (SELECT badge FROM people WHERE w = named) AS employee_number
FROM heads""",
)
def order_header(t):
    return joins.order_header(t.order_carts, t.users, t.team_members)


@query(
    "order_contact",
    """
SELECT oc.id AS order_id, oc.supervisor_id, u.full_name, u.email
FROM order_carts oc JOIN users u ON oc.supervisor_id = u.id""",
)
def order_contact(t):
    return joins.order_contact(t.order_carts, t.users)


@query("wide_order_lines", WIDE)
def wide_order_lines(t):
    money = ["total_price", "price_at_time", "subtotal"]
    return joins.wide_order_lines(t).withColumns({c: F.col(c).cast("double") for c in money})


@query(
    "user_directory",
    """
SELECT s_suppkey AS id, 's' || s_suppkey || '@example.com' AS email, 'supervisor' AS system_role, s_name AS full_name,
       nullif(s_suppkey - s_suppkey % 10, s_suppkey) AS supervisor_id,
       CASE WHEN s_suppkey % 4 > 0 THEN ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][s_suppkey % 5 + 1] END AS job_role,
       CASE WHEN s_suppkey % 10 > 0 THEN (SELECT b.s_name FROM supplier b WHERE b.s_suppkey = s.s_suppkey - s.s_suppkey % 10) END
         AS supervisor_name,
       (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) AS facility_name
FROM supplier s
UNION ALL
SELECT -i, [NULL, 'admin1', 'packer1', 'packer2'][i + 1] || '@example.com', CASE WHEN i = 1 THEN 'admin' ELSE 'packer' END,
       [NULL, 'admin1', 'packer1', 'packer2'][i + 1], NULL, NULL, NULL, NULL
FROM range(1, 4) r(i)""",
)
def user_directory(t):
    return joins.user_directory(t.users, t.job_roles, t.facilities)


@query(
    "team_roster",
    """
SELECT tm.supervisor_id, tm.full_name, tm.employee_number, jr.name AS job_role
FROM team_members tm LEFT JOIN job_roles jr ON tm.job_role_id = jr.id""",
)
def team_roster(t):
    return joins.team_roster(t.team_members, t.job_roles)


@query(
    "unread_count",
    """
SELECT u.id AS user_id, u.system_role, count(np.id) AS unread_news_count
FROM users u LEFT JOIN news_posts np
  ON (np.target_role = 'all' OR np.target_role = u.system_role)
 AND NOT EXISTS (SELECT 1 FROM news_reads nr WHERE nr.post_id = np.id AND nr.user_id = u.id)
GROUP BY u.id, u.system_role""",
)
def unread_count(t):
    return joins.unread_counts(t.news_posts, t.news_reads, t.users)


@query(
    "post_flags",
    f"""
SELECT np.id, EXISTS (SELECT 1 FROM news_reads r WHERE r.post_id = np.id AND r.user_id = {SUPERVISOR}) AS is_read,
       EXISTS (SELECT 1 FROM news_likes l WHERE l.post_id = np.id AND l.user_id = {SUPERVISOR}) AS user_liked
FROM news_posts np""",
)
def post_flags(t):
    return joins.post_flags(t.news_posts, t.news_reads, t.news_likes, SUPERVISOR)


@query(
    "eligible_products",
    f"""
SELECT DISTINCT p.id, p.name, p.article_number FROM products p JOIN product_job_roles pj ON p.id = pj.product_id
WHERE pj.job_role_id = {JOB_ROLE} OR pj.job_role_id = (SELECT id FROM job_roles WHERE name = 'Everyone')""",
)
def eligible_products(t):
    return joins.eligible_products(t.products, t.product_job_roles, t.job_roles, JOB_ROLE).select(
        "id", "name", "article_number"
    )


@query(
    "eligibility_pairs",
    """
WITH shared AS (SELECT DISTINCT product_id FROM product_job_roles
                WHERE job_role_id = (SELECT id FROM job_roles WHERE name = 'Everyone'))
SELECT 'everyone' AS reach, CAST(NULL AS BIGINT) AS job_role_id, product_id,
       (SELECT count(*) FROM team_members) AS workers
FROM shared
UNION ALL
SELECT 'role', tm.job_role_id, pj.product_id, count(*)
FROM product_job_roles pj JOIN team_members tm ON tm.job_role_id = pj.job_role_id
WHERE pj.product_id NOT IN (SELECT product_id FROM shared)
GROUP BY tm.job_role_id, pj.product_id""",
)
def eligibility_pairs(t):
    return joins.eligibility(t.team_members, t.product_job_roles, t.job_roles)


@query(
    "products_for_role",
    f"""
SELECT DISTINCT p.id, p.name, p.article_number FROM products p JOIN product_job_roles pj ON p.id = pj.product_id
WHERE pj.job_role_id = {JOB_ROLE}""",
)
def products_for_role(t):
    return joins.products_for_role(t.products, t.product_job_roles, JOB_ROLE).select("id", "name", "article_number")


@query(
    "effective_team",
    f"""
WITH acts AS (
  SELECT id AS acting_id, id AS owner_id FROM users WHERE system_role = 'supervisor'
  UNION SELECT to_supervisor_id, from_supervisor_id FROM supervisor_delegations WHERE {_LIVE})
SELECT a.acting_id, a.owner_id, tm.id AS team_member_id, tm.full_name
FROM acts a JOIN team_members tm ON tm.supervisor_id = a.owner_id""",
)
def effective_team(t):
    return joins.effective_team(t.team_members, t.supervisor_delegations, AS_OF)


@query(
    "orders_by_authority",
    """
SELECT id AS order_id, supervisor_id AS owner_id, CAST(created_at AS DATE) AS day, supervisor_id AS actor_id, 'self' AS reason
FROM order_carts WHERE supervisor_id IS NOT NULL
UNION ALL
SELECT DISTINCT oc.id, oc.supervisor_id, CAST(oc.created_at AS DATE), sd.to_supervisor_id, 'delegate'
FROM order_carts oc JOIN supervisor_delegations sd ON sd.from_supervisor_id = oc.supervisor_id
  AND CAST(oc.created_at AS DATE) BETWEEN sd.start_date AND sd.end_date
WHERE sd.from_supervisor_id <> sd.to_supervisor_id""",
)
def orders_by_authority(t):
    return joins.orders_by_authority(t.order_carts, t.supervisor_delegations)


# Each line carries the list of its garments' states, which is then unfolded.
@query(
    "worker_history",
    f"""
WITH {FACTS},
worn AS (
  SELECT l_partkey AS sku, l_suppkey * 15 + l_linenumber AS w,
         CASE WHEN l_returnflag = 'R' THEN ['worn_out', 'damaged', 'size_exchange', 'stolen', 'lost'][l_linenumber % 5 + 1]
              WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'lost' ELSE 'active' END AS why, l_returnflag = 'R' AS back
  FROM lineitem WHERE l_linenumber <> 7),
counted AS (SELECT sku, w, why, back, count(*) AS n FROM worn GROUP BY ALL),
folded AS (SELECT sku, w, list({{'why': why, 'back': back, 'n': n}}) AS states FROM counted GROUP BY ALL),
unfolded AS (SELECT t.*, unnest(f.states) AS s FROM told t JOIN folded f ON f.sku = t.sku AND f.w = t.w)
SELECT w AS team_member_id, o AS order_id, (SELECT day FROM heads h WHERE h.o = u.o) AS order_date,
       (SELECT state FROM heads h WHERE h.o = u.o) AS status, what AS product_name, fit AS size, q AS quantity,
       CASE WHEN s.back THEN 'returned_' ELSE '' END || s.why AS uniform_status, s.back OR s.why = 'lost' AS returned,
       s.why AS return_reason, s.n AS copies
FROM unfolded u""",
)
def worker_history(t):
    return joins.worker_history(t)


_GARMENT_COLUMNS = """p.name AS product_name, ps.size, uu.status, uu.issued_at, uu.returned_at,
       uu.status <> 'active' AS returned, replace(uu.status, 'returned_', '') AS return_reason"""


@query(
    "team_garments",
    f"""
SELECT tm.supervisor_id, tm.full_name AS worker_name, {_GARMENT_COLUMNS}
FROM user_uniforms uu JOIN product_sizes ps ON uu.product_size_id = ps.id JOIN products p ON ps.product_id = p.id
JOIN team_members tm ON uu.team_member_id = tm.id""",
)
def team_garments(t):
    return joins.team_garments(t)


@query(
    "team_garments_recent",
    f"""
WITH ranked AS (
  SELECT uu.*, tm.supervisor_id, tm.full_name AS worker_name,
         row_number() OVER (PARTITION BY tm.supervisor_id
           ORDER BY uu.issued_at DESC, uu.product_size_id DESC, uu.team_member_id DESC, uu.status DESC) AS rn
  FROM user_uniforms uu JOIN team_members tm ON uu.team_member_id = tm.id)
SELECT uu.supervisor_id, uu.worker_name, {_GARMENT_COLUMNS}
FROM ranked uu JOIN product_sizes ps ON uu.product_size_id = ps.id JOIN products p ON ps.product_id = p.id
WHERE rn <= 10""",
)
def team_garments_recent(t):
    return joins.team_garments(t, limit=10)


@query(
    "user_garments",
    f"""
SELECT uu.user_id, {_GARMENT_COLUMNS}
FROM user_uniforms uu JOIN product_sizes ps ON uu.product_size_id = ps.id JOIN products p ON ps.product_id = p.id
WHERE uu.user_id IS NOT NULL""",
)
def user_garments(t):
    return joins.user_garments(t)


@query(
    "price_snapshot",
    """
SELECT oi.cart_id, oi.product_size_id, oi.quantity, CAST(coalesce(p.price, 0) AS DOUBLE) AS price
FROM order_items oi LEFT JOIN product_sizes ps ON oi.product_size_id = ps.id
LEFT JOIN products p ON ps.product_id = p.id""",
)
def price_snapshot(t):
    return joins.with_price(
        t.order_items.select("cart_id", "product_size_id", "quantity"), t.product_sizes, t.products
    ).withColumn("price", F.col("price").cast("double"))


_GIVEN = """
given AS (
  SELECT s_suppkey AS boss, (s_suppkey + 1 + turn) % (SELECT count(*) FROM supplier) AS other, s_suppkey * 2 + turn AS id,
         make_date(CAST(1996 + s_suppkey % 4 AS INT), CAST(1 + s_suppkey % 12 AS INT), 1) AS since,
         make_date(CAST(1996 + s_suppkey % 4 + turn AS INT), 12, 31) AS until
  FROM supplier, range(0, 2) r(turn))"""


@query(
    "delegations_out",
    f"""
WITH {_GIVEN}
SELECT id, boss AS from_supervisor_id, other AS to_supervisor_id, since AS start_date, until AS end_date,
       (SELECT s_name FROM supplier WHERE s_suppkey = other) AS delegate_name
FROM given""",
)
def delegations_out(t):
    return joins.delegations_out(t.supervisor_delegations, t.users)


@query(
    "delegations_in",
    f"""
WITH {_GIVEN}
SELECT id, other AS to_supervisor_id, since AS start_date, until AS end_date,
       (SELECT s_name FROM supplier WHERE s_suppkey = boss) AS owner_name, boss AS owner_id
FROM given WHERE DATE '1998-06-15' BETWEEN since AND until""",
)
def delegations_in(t):
    return joins.delegations_in(t.supervisor_delegations, t.users, AS_OF)


@query(
    "post_comments",
    """
WITH said AS (
  SELECT event_id, user_id, props, ts, (SELECT s_name FROM supplier WHERE s_suppkey = user_id) AS who
  FROM events WHERE event_type = 'purchase')
SELECT event_id AS id, event_id % (SELECT count(*) FROM documents) AS post_id, user_id, props AS comment, ts AS created_at,
       who AS full_name
FROM said WHERE who IS NOT NULL""",
)
def post_comments(t):
    return joins.post_comments(t.news_comments, t.users)


_RETURNED = "status NOT IN ('active', 'issued', '')"


@query(
    "returns_report",
    f"""
WITH origin AS (
  SELECT product_size_id, team_member_id, count(DISTINCT cart_id) AS order_count,
         min(cart_id) AS first_order_id, max(cart_id) AS last_order_id
  FROM order_items WHERE team_member_id IS NOT NULL GROUP BY product_size_id, team_member_id)
SELECT uu.returned_at, tm.full_name AS worker_name, u.full_name AS supervisor_name, p.name AS product_name, ps.size,
       replace(uu.status, 'returned_', '') AS return_reason,
       CASE replace(uu.status, 'returned_', '') WHEN 'stolen' THEN 'Stolen' WHEN 'lost' THEN 'Lost'
            WHEN 'worn_out' THEN 'Worn out' WHEN 'damaged' THEN 'Damaged'
            WHEN 'size_exchange' THEN 'Size exchange' END AS reason_label,
       coalesce(o.order_count, 0) AS order_count, o.first_order_id, o.last_order_id
FROM user_uniforms uu JOIN product_sizes ps ON uu.product_size_id = ps.id JOIN products p ON ps.product_id = p.id
LEFT JOIN team_members tm ON uu.team_member_id = tm.id LEFT JOIN users u ON tm.supervisor_id = u.id
LEFT JOIN origin o ON o.product_size_id = uu.product_size_id AND o.team_member_id = uu.team_member_id
WHERE uu.{_RETURNED}""",
)
def returns_report(t):
    return joins.returns_report(t)


@query(
    "return_orders",
    f"""
SELECT DISTINCT oi.product_size_id, oi.team_member_id, oi.cart_id AS order_id
FROM order_items oi JOIN (SELECT * FROM user_uniforms WHERE {_RETURNED}) uu
  ON uu.product_size_id = oi.product_size_id AND uu.team_member_id = oi.team_member_id""",
)
def return_orders(t):
    return joins.return_orders(t)


@query(
    "authority_pairs",
    f"""
SELECT id AS actor_id, id AS supervisor_id, 'self' AS reason FROM users WHERE system_role = 'supervisor'
UNION ALL
SELECT DISTINCT to_supervisor_id, from_supervisor_id, 'delegate' FROM supervisor_delegations
WHERE {_LIVE} AND to_supervisor_id <> from_supervisor_id
UNION ALL
SELECT id, NULL, 'admin' FROM users WHERE system_role = 'admin'""",
)
def authority_pairs(t):
    return joins.authority_pairs(t.users, t.supervisor_delegations, AS_OF)
