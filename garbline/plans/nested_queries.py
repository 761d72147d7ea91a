"""Registered queries: nested results (shown as text or flat) and composed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from garbline.operators import nested, reports
from garbline.plans import pages
from garbline.plans.registry import AS_OF, JOB_ROLE, SEARCH, SUPERVISOR, VIEWER_ROLE, WORKER, query


def _joined(array: str, *fields: str):
    """An array of structs as text, elements in order, for comparison with SQL."""
    return F.array_join(
        F.transform(array, lambda e: F.concat_ws(":", *[e[f].cast("string") for f in fields])), "|"
    )


def _paged(key: str, sql: str):
    """Register under ``key`` with the usual page size and under ``key_by_three`` with pages of three."""

    def register(build):
        query(key, sql.replace("PAGE", str(nested.PAGE_ITEMS)))(lambda t: build(t, nested.PAGE_ITEMS))
        query(f"{key}_by_three", sql.replace("PAGE", "3"))(lambda t: build(t, 3))
        return build

    return register


# In the oracles a child's page is its rank within the parent, from the base tables, cut by the page size.
_SIZES = """
sku AS (SELECT p_brand || '/' || p_name AS product, p_partkey AS k, p_size::VARCHAR || ':' || ((p_partkey * 37) % 1500)::VARCHAR AS what
        FROM part),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY product ORDER BY k) - 1) // PAGE AS page FROM sku),
sizes AS (SELECT product, page, string_agg(k::VARCHAR || ':' || what, '|' ORDER BY k) AS sizes, count(*) AS size_count
          FROM ranked GROUP BY ALL)"""
_ROLES = """
pairs AS (SELECT DISTINCT p_brand || '/' || p_name AS product, CASE WHEN p_size % 9 = 0 THEN 6 ELSE p_size % 5 + 1 END AS r FROM part),
turns AS (SELECT *, (row_number() OVER (PARTITION BY product ORDER BY r) - 1) // PAGE AS page FROM pairs),
roles AS (SELECT product, page, string_agg(r::VARCHAR, '|' ORDER BY r) AS role_ids FROM turns GROUP BY ALL)"""


@_paged(
    "products_with_sizes",
    f"""
WITH {_SIZES}
SELECT id, name, CAST(page AS INT) AS page, sizes, size_count FROM products JOIN sizes ON product = id""",
)
def products_with_sizes(t, page_items):
    return nested.products_with_sizes(t.products, t.product_sizes, page_items).select(
        "id", "name", "page", _joined("sizes", "id", "size", "stock").alias("sizes"),
        F.size("sizes").cast("bigint").alias("size_count"),
    )


@_paged(
    "products_with_roles",
    f"""
WITH {_ROLES}
SELECT product AS id, CAST(page AS INT) AS page, role_ids FROM roles""",
)
def products_with_roles(t, page_items):
    return nested.products_with_roles(t.products, t.product_job_roles, page_items).select(
        "id", "page", F.array_join("role_ids", "|").alias("role_ids")
    )


@_paged(
    "catalogue_nested",
    f"""
WITH {_SIZES}, {_ROLES}
SELECT coalesce(s.product, r.product) AS id, CAST(coalesce(s.page, r.page) AS INT) AS page, coalesce(sizes, '') AS sizes,
       coalesce(role_ids, '') AS role_ids
FROM sizes s FULL JOIN roles r ON r.product = s.product AND r.page = s.page""",
)
def catalogue_nested(t, page_items):
    shown = pages.catalogue_nested(t, "admin", page_items)
    return shown.select("id", "page", _joined("sizes", "id", "size", "stock").alias("sizes"), F.array_join("role_ids", "|").alias("role_ids"))


@query(
    "size_map",
    """
SELECT team_member_id, string_agg(upper(product_type) || ':' || size, '|' ORDER BY product_type) AS sizes
FROM worker_sizes GROUP BY team_member_id""",
)
def size_map(t):
    entries = nested.size_map(t.worker_sizes).withColumn("entries", F.map_entries("sizes"))
    return entries.select("team_member_id", _joined("entries", "key", "value").alias("sizes"))


@_paged(
    "delegations_with_members",
    """
WITH mine AS (
  SELECT c_custkey % (SELECT count(*) FROM supplier) AS boss, c_name || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE ':E' || c_custkey END AS who,
         c_name, c_custkey FROM customer),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY boss ORDER BY c_name, c_custkey) - 1) // PAGE AS page FROM mine)
SELECT sd.id, sd.to_supervisor_id, (SELECT s_name FROM supplier WHERE s_suppkey = sd.from_supervisor_id) AS owner_name,
       CAST(coalesce(r.page, 0) AS INT) AS page, coalesce(string_agg(r.who, '|' ORDER BY r.c_name, r.c_custkey), '') AS members
FROM supervisor_delegations sd LEFT JOIN ranked r ON r.boss = sd.from_supervisor_id
WHERE sd.start_date <= DATE '1998-06-15' AND sd.end_date >= DATE '1998-06-15' GROUP BY ALL""",
)
def delegations_with_members(t, page_items):
    return nested.delegations_with_members(t, AS_OF, page_items=page_items).select(
        "id", "to_supervisor_id", "owner_name", "page", _joined("members", "full_name", "employee_number").alias("members")
    )


@_paged(
    "delegated_groups",
    """
WITH live AS (
  SELECT s_suppkey AS boss, s_name AS owner_name, s_suppkey * 2 + m AS delegation FROM supplier, (VALUES (0), (1)) AS v(m)
  WHERE make_date(CAST(1996 + s_suppkey % 4 AS INT), CAST(1 + s_suppkey % 12 AS INT), 1) <= DATE '1998-06-15'
    AND make_date(CAST(1996 + s_suppkey % 4 + m AS INT), 12, 31) >= DATE '1998-06-15'),
members AS (SELECT owner_name, delegation, c_custkey, c_name FROM live
            JOIN customer ON c_custkey % (SELECT count(*) FROM supplier) = boss),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY owner_name ORDER BY delegation, c_custkey) - 1) // PAGE AS page FROM members)
SELECT owner_name AS supervisor_name, CAST(page AS INT) AS page, string_agg(delegation || ':' || c_custkey || ':' || c_name, '|' ORDER BY delegation, c_custkey) AS workers
FROM ranked GROUP BY ALL""",
)
def delegated_groups(t, page_items):
    rosters = reports.delegated_team_sizes(t, AS_OF).select("supervisor_name", "delegation_id", "id", "full_name")
    grouped = nested.group_rows(rosters, "supervisor_name", "workers", page_items)
    return grouped.select("supervisor_name", "page", _joined("workers", "delegation_id", "id", "full_name").alias("workers"))


@query(
    "news_feed",
    f"""
SELECT np.id, np.title, np.content, np.target_role, np.created_at, coalesce(np.pinned, 0) AS pinned, u.full_name,
       EXISTS (SELECT 1 FROM news_reads r WHERE r.post_id = np.id AND r.user_id = {SUPERVISOR}) AS is_read,
       (SELECT count(*) FROM news_likes l WHERE l.post_id = np.id) AS like_count,
       EXISTS (SELECT 1 FROM news_likes l WHERE l.post_id = np.id AND l.user_id = {SUPERVISOR}) AS user_liked,
       (SELECT count(*) FROM news_comments c JOIN users cu ON c.user_id = cu.id WHERE c.post_id = np.id) AS comment_count
FROM news_posts np LEFT JOIN users u ON np.created_by = u.id
WHERE np.target_role IN ('all', '{VIEWER_ROLE}')""",
)
def news_feed(t):
    return pages.news_feed(t, SUPERVISOR, VIEWER_ROLE)


@_paged(
    "news_feed_comments",
    """
WITH said AS (
  SELECT event_id % (SELECT count(*) FROM documents) AS post, event_id, ts,
         event_id || ':' || (SELECT s_name FROM supplier WHERE s_suppkey = user_id) || ':' || props AS what
  FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT s_suppkey FROM supplier)),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY post ORDER BY ts, event_id) - 1) // PAGE AS page FROM said)
SELECT doc_id AS id, CAST(coalesce(page, 0) AS INT) AS page, coalesce(string_agg(what, '|' ORDER BY ts, event_id), '') AS comments
FROM documents LEFT JOIN ranked ON post = doc_id WHERE lang IN ('en', 'de') GROUP BY ALL""",
)
def news_feed_comments(t, page_items):
    feed = pages.news_feed_nested(t, SUPERVISOR, VIEWER_ROLE, page_items)
    return feed.select("id", "page", _joined("comments", "id", "full_name", "comment").alias("comments"))


_STOCK = """LEFT JOIN (SELECT product_id, count(*) AS n, sum(stock) AS stock FROM product_sizes GROUP BY product_id) s
  ON s.product_id = p.id"""


@query(
    "catalogue",
    f"""
SELECT p.id, p.article_number, p.name, p.type, CAST(p.price AS DOUBLE) AS price, coalesce(s.n, 0) AS size_count,
       CAST(coalesce(s.stock, 0) AS BIGINT) AS total_stock,
       (SELECT max(ws.size) FROM worker_sizes ws
        WHERE ws.team_member_id = {WORKER} AND upper(ws.product_type) = upper(p.type)) AS recommended_size,
       EXISTS (SELECT 1 FROM product_job_roles pj WHERE pj.product_id = p.id
               AND (pj.job_role_id = {JOB_ROLE} OR pj.job_role_id = (SELECT id FROM job_roles WHERE name = 'Everyone')))
         AS eligible
FROM products p {_STOCK}
WHERE EXISTS (SELECT 1 FROM product_job_roles pj WHERE pj.product_id = p.id AND pj.job_role_id = {JOB_ROLE})""",
)
def catalogue(t):
    return pages.catalogue(t, VIEWER_ROLE, worker=WORKER, worker_role=JOB_ROLE)


@query(
    "catalogue_search",
    f"""
SELECT p.id, p.article_number, p.name, p.type, CAST(p.price AS DOUBLE) AS price, coalesce(s.n, 0) AS size_count,
       CAST(coalesce(s.stock, 0) AS BIGINT) AS total_stock, CAST(NULL AS VARCHAR) AS recommended_size,
       CAST(NULL AS BOOLEAN) AS eligible
FROM products p {_STOCK}
WHERE (contains(lower(p.name), lower('{SEARCH}')) OR contains(lower(p.article_number), lower('{SEARCH}')))
  AND EXISTS (SELECT 1 FROM product_job_roles pj WHERE pj.product_id = p.id
              AND (pj.job_role_id = {JOB_ROLE} OR pj.job_role_id = (SELECT id FROM job_roles WHERE name = 'Everyone')))""",
)
def catalogue_search(t):
    return pages.catalogue(t, "worker", viewer_role_id=JOB_ROLE, search=SEARCH)
