"""The domain tables as DuckDB views, used only by the oracle queries."""

from __future__ import annotations

import re

VIEWS = {
    "users": """
SELECT s_suppkey AS id, s_name AS full_name, 's' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS email,
       'supervisor' AS system_role,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 5 + 1 END AS job_role_id,
       CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_suppkey - s_suppkey % 10 END AS supervisor_id,
       CAST(s_nationkey AS BIGINT) AS facility_id,
       CASE WHEN s_acctbal <= 0 THEN NULL
            ELSE CAST(CAST(s_acctbal AS DECIMAL(12,2)) * 200 AS DECIMAL(14,2)) END AS monthly_budget
FROM supplier
UNION ALL
SELECT CAST(t.id AS BIGINT), t.full_name, t.full_name || '@example.com', t.system_role,
       CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DECIMAL(14,2))
FROM (VALUES (-1,'admin1','admin'),(-2,'packer1','packer'),(-3,'packer2','packer')) AS t(id, full_name, system_role)""",
    "team_members": """
SELECT c_custkey AS id, c_name AS full_name,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'E' || CAST(c_custkey AS VARCHAR) END AS employee_number,
       c_custkey % (SELECT count(*) FROM supplier) AS supervisor_id,
       CAST(c_nationkey AS BIGINT) AS facility_id,
       CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
            WHEN 'HOUSEHOLD' THEN 4 ELSE NULL END AS BIGINT) AS job_role_id
FROM customer""",
    "user_measurements": """
SELECT c_custkey AS user_id,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(38 + c_custkey % 10 AS VARCHAR) END AS shoe_size
FROM customer""",
    "job_roles": """
SELECT CAST(id AS BIGINT) AS id, name
FROM (VALUES (1,'AUTOMOBILE'),(2,'BUILDING'),(3,'FURNITURE'),(4,'HOUSEHOLD'),
             (5,'MACHINERY'),(6,'Everyone'),(7,'Packer')) AS t(id, name)""",
    "worker_sizes": """
SELECT c_custkey AS team_member_id, t.product_type,
       CAST(28 + (c_custkey * 3 + t.k) % 10 AS VARCHAR) AS size
FROM customer CROSS JOIN (VALUES (0,'SHIRT'),(1,'PANTS'),(2,'SHOES')) AS t(k, product_type)
WHERE (c_custkey + t.k) % 4 <> 0""",
    "products": """
SELECT p_brand || '/' || p_name AS id, p_name AS name, p_brand || '/' || p_name AS article_number,
       CASE min(p_type) WHEN 'ECONOMY' THEN 'Shirt' WHEN 'LARGE' THEN 'PANTS' WHEN 'MEDIUM' THEN 'shoes'
            WHEN 'PROMO' THEN 'Jacket' ELSE NULL END AS type,
       min(CAST(p_retailprice AS DECIMAL(12,2))) AS price
FROM part GROUP BY p_brand, p_name""",
    "product_sizes": """
SELECT p_partkey AS id, p_brand || '/' || p_name AS product_id,
       CAST(p_size AS VARCHAR) AS size, CAST((p_partkey * 37) % 1500 AS BIGINT) AS stock
FROM part""",
    "product_job_roles": """
SELECT DISTINCT p_brand || '/' || p_name AS product_id,
       CAST(CASE WHEN p_size % 9 = 0 THEN 6 ELSE p_size % 5 + 1 END AS BIGINT) AS job_role_id
FROM part""",
    "order_carts": """
SELECT o_orderkey AS id, c_custkey % (SELECT count(*) FROM supplier) AS supervisor_id,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS team_member_id,
       CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'packed'
            WHEN o_orderpriority = '5-LOW' THEN 'created'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'cancelled'
            ELSE 'submitted' END AS status,
       CAST(o_totalprice AS DECIMAL(12,2)) AS total_price, o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "order_items": """
SELECT l_orderkey AS cart_id, l_partkey AS product_size_id,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey * 15 + l_linenumber END AS team_member_id,
       CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price_at_time,
       l_shipdate AS ordered_at
FROM lineitem""",
    "user_uniforms": """
SELECT l_partkey AS product_size_id, l_suppkey * 15 + l_linenumber AS team_member_id,
       CASE WHEN l_linenumber = 1 THEN l_suppkey ELSE NULL END AS user_id,
       CASE WHEN l_returnflag = 'R' THEN
                 CASE l_linenumber % 5 WHEN 0 THEN 'returned_worn_out' WHEN 1 THEN 'returned_damaged'
                      WHEN 2 THEN 'returned_size_exchange' WHEN 3 THEN 'returned_stolen'
                      ELSE 'returned_lost' END
            WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'lost'
            ELSE 'active' END AS status,
       l_shipdate AS issued_at,
       CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL '30' DAY ELSE NULL END AS returned_at
FROM lineitem WHERE l_linenumber <> 7""",
    "supervisor_delegations": """
SELECT s_suppkey * 2 + t.m AS id, s_suppkey AS from_supervisor_id,
       (s_suppkey + 1 + t.m) % (SELECT count(*) FROM supplier) AS to_supervisor_id,
       make_date(CAST(1996 + s_suppkey % 4 AS INT), CAST(1 + s_suppkey % 12 AS INT), 1) AS start_date,
       make_date(CAST(1996 + s_suppkey % 4 + t.m AS INT), 12, 31) AS end_date
FROM supplier CROSS JOIN (VALUES (0),(1)) AS t(m)""",
    "news_posts": """
SELECT d.doc_id AS id, d.source AS title, d.text AS content,
       d.doc_id % (SELECT count(*) FROM supplier) AS created_by,
       CASE d.lang WHEN 'en' THEN 'all' WHEN 'de' THEN 'supervisor' WHEN 'fr' THEN 'packer' ELSE 'admin' END AS target_role,
       l.quality AS pinned,
       make_date(2024, CAST(1 + d.doc_id % 12 AS INT), CAST(1 + d.doc_id % 28 AS INT)) AS created_at
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "news_reads": """
SELECT DISTINCT event_id % (SELECT count(*) FROM documents) AS post_id, user_id
FROM events WHERE event_type = 'view'""",
    "news_like_clicks": """
SELECT (user_id * 13 + event_id % 3) % (SELECT count(*) FROM documents) AS post_id, user_id, ts FROM events WHERE event_type = 'click'""",
    "news_likes": """
SELECT post_id, user_id FROM news_like_clicks GROUP BY post_id, user_id HAVING count(*) % 2 = 1""",
    "news_comments": """
SELECT event_id AS id, event_id % (SELECT count(*) FROM documents) AS post_id, user_id,
       props AS comment, ts AS created_at
FROM events WHERE event_type = 'purchase'""",
    "facilities": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "sites": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region",
    "user_sites": "SELECT s_suppkey AS user_id, s_suppkey % 5 AS site_id FROM supplier",
}


def add_view(name: str, body: str) -> None:
    """Register a further oracle view (request tables of the batch jobs)."""
    VIEWS[name] = body


def with_views(body: str) -> str:
    """``body`` with the views it names, and the views those name, as leading CTEs."""
    needed: list[str] = []

    def visit(text: str, itself: str | None) -> None:
        for name in VIEWS:
            if name != itself and name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name], name)
                if name not in needed:
                    needed.append(name)

    visit(body, None)
    body = body.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    own = re.match(r"WITH( RECURSIVE)?\s+", body)
    if own:
        return f"WITH{own.group(1) or ''} {ctes},\n{body[own.end():]}"
    return f"WITH {ctes}\n{body}"


# Orders and their lines straight from the base tables, every name looked up where it is needed. Oracles
# of line listings use these instead of joining the domain views.
FACTS = """
heads AS (
  SELECT o_orderkey AS o, o_orderdate AS day, CAST(o_totalprice AS DECIMAL(12,2)) AS total,
         o_custkey % (SELECT count(*) FROM supplier) AS boss, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS named,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'packed'
              ELSE CASE o_orderpriority WHEN '5-LOW' THEN 'created' WHEN '4-NOT SPECIFIED' THEN 'cancelled' ELSE 'submitted' END
         END AS state
  FROM orders),
people AS (SELECT c_custkey AS w, c_name AS who, CASE WHEN c_custkey % 13 <> 0 THEN 'E' || c_custkey END AS badge FROM customer),
goods AS (SELECT p_partkey AS sku, p_name AS what, p_brand || '/' || p_name AS article, CAST(p_size AS VARCHAR) AS fit FROM part),
lines AS (
  SELECT l_orderkey AS o, l_partkey AS sku, CAST(l_quantity AS INT) AS q, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CASE WHEN l_linenumber <> 7 THEN l_suppkey * 15 + l_linenumber END AS w
  FROM lineitem),
told AS (
  SELECT o, sku, w, q, CAST(price AS DOUBLE) AS price, CAST(q * price AS DOUBLE) AS worth,
         (SELECT what FROM goods g WHERE g.sku = l.sku) AS what, (SELECT article FROM goods g WHERE g.sku = l.sku) AS article,
         (SELECT fit FROM goods g WHERE g.sku = l.sku) AS fit,
         (SELECT who FROM people p WHERE p.w = l.w) AS who, (SELECT badge FROM people p WHERE p.w = l.w) AS badge
  FROM lines l)"""
# A line with its order.
WIDE = f"""
WITH {FACTS}
SELECT o AS order_id, h.state AS status, h.day AS created_at, CAST(h.total AS DOUBLE) AS total_price,
       (SELECT s_name FROM supplier WHERE s_suppkey = h.boss) AS supervisor, what AS product, article AS article_number,
       fit AS size, q AS quantity, price AS price_at_time, worth AS subtotal, who AS worker, badge AS employee_number
FROM told JOIN heads h USING (o)"""
