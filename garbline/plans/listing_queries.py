"""Registered queries: listings, exports, filters and classifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.functions.dates import covers
from garbline.functions.text import dash_if_empty, excerpt, money_text, reason_label, status_label, words_label
from garbline.operators import filters as flt
from garbline.operators.nested import to_json_docs
from garbline.plans.registry import AS_OF, SEARCH, SUPERVISOR, query
from garbline.plans.views import WIDE
from garbline.sinks import exports
from garbline.sources.tables import dimension


@query(
    "dim_listing",
    """
SELECT 'product' AS kind, id, name FROM products
UNION ALL SELECT 'user', CAST(id AS VARCHAR), full_name FROM users
UNION ALL SELECT 'role', CAST(id AS VARCHAR), name FROM job_roles
UNION ALL SELECT 'site', CAST(id AS VARCHAR), name FROM sites
UNION ALL SELECT 'facility', CAST(id AS VARCHAR), name FROM facilities""",
)
def dim_listing(t):
    kinds = {"product": t.products, "user": t.users.withColumnRenamed("full_name", "name"), "role": t.job_roles,
             "site": t.sites, "facility": t.facilities}
    rows = [
        df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "name")
        for kind, df in kinds.items()
    ]
    return dimension(reduce(DataFrame.unionByName, rows), "kind", "name", "id")


@query("order_lines_export", WIDE)
def order_lines_export(t):
    return exports.order_lines_export(t)


@query(
    "order_report",
    f"""
SELECT CAST(order_id AS VARCHAR) AS order_id, status, strftime(created_at, '%Y-%m-%d') AS date, supervisor, product, size,
       CAST(quantity AS VARCHAR) AS qty, printf('%.2f', price_at_time) AS price, coalesce(nullif(worker, ''), '-') AS worker
FROM ({WIDE})""",
)
def order_report(t):
    return exports.order_report(t)


@query(
    "order_summary",
    """
SELECT oc.id, u.full_name, CAST(oc.total_price AS DOUBLE) AS total_price, oc.status, oc.created_at
FROM order_carts oc JOIN users u ON oc.supervisor_id = u.id""",
)
def order_summary(t):
    return exports.order_summary_export(t)


@query(
    "sku_json",
    """SELECT CAST(to_json(struct_pack(id := id, product_id := product_id, size := size, stock := stock)) AS VARCHAR) AS doc
FROM product_sizes""",
)
def sku_json(t):
    return to_json_docs(t.product_sizes)


@query(
    "orders_filtered",
    """
SELECT id, supervisor_id, team_member_id, status, CAST(total_price AS DOUBLE) AS total_price, created_at
FROM order_carts
WHERE status <> 'completed' AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1998-06-15'""",
)
def orders_filtered(t):
    return flt.filter_orders(t.order_carts, start="1996-01-01", end=AS_OF).withColumn(
        "total_price", F.col("total_price").cast("double")
    )


@query(
    "orders_visible",
    """
SELECT u.id AS viewer_id, u.system_role, count(oc.id) AS visible_orders,
       CAST(coalesce(sum(oc.total_price), 0) AS DOUBLE) AS visible_value
FROM users u LEFT JOIN order_carts oc ON u.system_role <> 'supervisor' OR oc.supervisor_id = u.id
GROUP BY u.id, u.system_role""",
)
def orders_visible(t):
    return flt.visible_order_counts(t.order_carts, t.users)


@query(
    "product_search",
    f"""
SELECT id, name, article_number, type, CAST(price AS DOUBLE) AS price FROM products
WHERE contains(lower(name), lower('{SEARCH}')) OR contains(lower(coalesce(article_number, '')), lower('{SEARCH}'))""",
)
def product_search(t):
    return flt.search_products(t.products, SEARCH).withColumn("price", F.col("price").cast("double"))


@query(
    "low_stock",
    """
SELECT ps.id AS sku_id, p.name, ps.size, ps.stock FROM product_sizes ps JOIN products p ON ps.product_id = p.id
WHERE ps.stock <= 2 AND ps.stock > 0 ORDER BY ps.stock, ps.id LIMIT 5""",
)
def low_stock(t):
    return flt.low_stock(t.product_sizes, t.products, limit=5)


@query(
    "stock_risk",
    """
SELECT ps.id AS sku_id, p.name, ps.size, ps.stock FROM product_sizes ps JOIN products p ON ps.product_id = p.id
WHERE ps.stock <= 2""",
)
def stock_risk(t):
    return flt.low_stock(t.product_sizes, t.products, include_zero=True)


@query(
    "stock_bands",
    """
SELECT ps.id AS sku_id, p.name, p.article_number, ps.size, ps.stock,
       CASE WHEN ps.stock <= 5 THEN 'critical' WHEN ps.stock <= 15 THEN 'warning' ELSE 'ok' END AS stock_band,
       CASE WHEN ps.stock <= 2 THEN 'low' ELSE 'ok' END AS highlight
FROM product_sizes ps JOIN products p ON ps.product_id = p.id""",
)
def stock_bands(t):
    return flt.stock_bands(t.product_sizes, t.products)


@query(
    "garment_state",
    """
SELECT product_size_id, team_member_id, status, issued_at,
       coalesce(status, '') <> 'active' AS team_returned,
       coalesce(status, '') NOT IN ('active', 'issued', '') AS history_returned,
       CASE WHEN status LIKE 'returned\\_%' ESCAPE '\\' THEN replace(status, 'returned_', '')
            ELSE coalesce(status, '') END AS return_reason
FROM user_uniforms""",
)
def garment_state(t):
    team = flt.garment_state(t.user_uniforms, "team").withColumnRenamed("returned", "team_returned")
    both = flt.garment_state(team.drop("return_reason"), "history")
    return both.select(
        "product_size_id", "team_member_id", "status", "issued_at", "team_returned",
        F.col("returned").alias("history_returned"), "return_reason",
    )


@query(
    "status_labels",
    """
SELECT 'order' AS kind, status AS code,
       CASE WHEN status = 'completed' THEN 'Sent' ELSE upper(left(status, 1)) || lower(substr(status, 2)) END AS label,
       count(*) AS n
FROM order_carts GROUP BY status
UNION ALL
SELECT 'garment', status,
       array_to_string(list_transform(string_split(replace(status, '_', ' '), ' '),
                       lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' '), count(*)
FROM user_uniforms GROUP BY status
UNION ALL
SELECT 'reason', reason,
       CASE WHEN reason IN ('worn_out', 'size_exchange', 'stolen', 'lost', 'damaged')
            THEN upper(left(reason, 1)) || lower(substr(replace(reason, '_', ' '), 2)) ELSE 'Active' END, count(*)
FROM (SELECT replace(status, 'returned_', '') AS reason FROM user_uniforms) GROUP BY reason""",
)
def status_labels(t):
    orders = t.order_carts.groupBy(F.col("status").alias("code")).agg(F.count("*").alias("n"))
    garments = t.user_uniforms.groupBy(F.col("status").alias("code")).agg(F.count("*").alias("n"))
    reasons = flt.garment_state(t.user_uniforms, "team").groupBy(F.col("return_reason").alias("code")).agg(
        F.count("*").alias("n")
    )
    code = F.col("code")
    parts = [("order", orders, status_label(code)), ("garment", garments, words_label(code)),
             ("reason", reasons, reason_label(code))]
    rows = [df.select(F.lit(k).alias("kind"), "code", label.alias("label"), "n") for k, df, label in parts]
    return reduce(DataFrame.unionByName, rows)


@query(
    "delegations_active",
    """
SELECT id, from_supervisor_id, to_supervisor_id, start_date, end_date,
       start_date <= DATE '1998-06-15' AND end_date >= DATE '1998-06-15' AS holds,
       CASE WHEN end_date >= DATE '1998-06-15' THEN 'Active' ELSE 'Expired' END AS flag
FROM supervisor_delegations""",
)
def delegations_active(t):
    holds = covers(F.col("start_date"), F.col("end_date"), AS_OF)
    return t.supervisor_delegations.withColumns({"holds": holds, "flag": flt.delegation_flag(AS_OF)})


@query(
    "directory",
    """
SELECT 'supervisors' AS list, id, full_name FROM users WHERE system_role = 'supervisor'
UNION ALL SELECT 'delegates of 7', id, full_name FROM users WHERE system_role = 'supervisor' AND id <> 7
UNION ALL SELECT 'packers', id, full_name FROM users WHERE system_role = 'packer'
UNION ALL SELECT 'assignable roles', id, name FROM job_roles WHERE name NOT IN ('Everyone', 'Packer')""",
)
def directory(t):
    lists = {
        "supervisors": flt.directory(t.users, "supervisor"),
        "delegates of 7": flt.directory(t.users, "supervisor", exclude_id=7),
        "packers": flt.directory(t.users, "packer"),
        "assignable roles": flt.assignable_roles(t.job_roles).withColumnRenamed("name", "full_name"),
    }
    return reduce(
        DataFrame.unionByName, [df.select(F.lit(n).alias("list"), "id", "full_name") for n, df in lists.items()]
    )


@query(
    "cancellable",
    """
SELECT id, supervisor_id, status, status IN ('created', 'submitted') AS offered,
       status NOT IN ('packed', 'completed') AS accepted
FROM order_carts""",
)
def cancellable(t):
    return t.order_carts.select(
        "id", "supervisor_id", "status", flt.may_cancel("list").alias("offered"),
        flt.may_cancel("handler").alias("accepted"),
    )


@query(
    "cancellable_by_role",
    f"""
SELECT viewer_role, rule, id FROM order_carts, (VALUES ('admin', 'list'), ('admin', 'handler'), ('supervisor', 'list'),
  ('supervisor', 'handler'), ('packer', 'list'), ('packer', 'handler')) v(viewer_role, rule)
WHERE CASE rule WHEN 'list' THEN status IN ('created', 'submitted') AND viewer_role <> 'packer' ELSE status NOT IN ('packed', 'completed') END
  AND (viewer_role <> 'supervisor' OR supervisor_id = {SUPERVISOR})""",
)
def cancellable_by_role(t):
    rows = [
        flt.cancellable(t.order_carts, SUPERVISOR, role, rule).select(F.lit(role).alias("viewer_role"), F.lit(rule).alias("rule"), "id")
        for role in ("admin", "supervisor", "packer")
        for rule in ("list", "handler")
    ]
    return reduce(DataFrame.unionByName, rows)


@query(
    "out_of_stock_products",
    """
SELECT p.id AS product_id, p.name, count(*) AS sizes, count(*) FILTER (ps.stock <> 0) AS orderable_sizes
FROM products p JOIN product_sizes ps ON ps.product_id = p.id
GROUP BY p.id, p.name HAVING NOT bool_or(ps.stock > 0)""",
)
def out_of_stock_products(t):
    return flt.out_of_stock_products(t.products, t.product_sizes)


@query("workers_of", "SELECT id, full_name, employee_number, supervisor_id FROM team_members")
def workers_of(t):
    return flt.workers_of(t.team_members)


@query(
    "workers_of_delegators",
    """
SELECT id, full_name, employee_number, supervisor_id FROM team_members
WHERE supervisor_id IN (SELECT from_supervisor_id FROM supervisor_delegations
                        WHERE start_date <= DATE '1998-06-15' AND end_date >= DATE '1998-06-15')""",
)
def workers_of_delegators(t):
    owners = flt.active_delegations(t.supervisor_delegations, AS_OF).select(
        F.col("from_supervisor_id").alias("supervisor_id")
    )
    return flt.workers_of(t.team_members, owners)


@query(
    "scalar_showcase",
    """
SELECT 'order' AS kind, CAST(id AS VARCHAR) AS id, strftime(created_at, '%d %b %Y') AS shown_date,
       substr(CAST(created_at AS VARCHAR), 1, 10) AS iso_date, printf('%.2f', CAST(total_price AS DOUBLE)) AS amount,
       CASE WHEN status = 'completed' THEN 'Sent' ELSE upper(left(status, 1)) || lower(substr(status, 2)) END AS label,
       CAST(created_at + INTERVAL '1' HOUR AS VARCHAR) AS expires, CAST(month(created_at) AS INT) AS month,
       CAST(year(created_at) AS INT) AS year
FROM order_carts
UNION ALL
SELECT 'post', CAST(id AS VARCHAR), strftime(created_at, '%d %b %Y'), CAST(created_at AS VARCHAR), NULL,
       CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '…' ELSE content END, NULL,
       CAST(month(created_at) AS INT), CAST(year(created_at) AS INT)
FROM news_posts
UNION ALL
SELECT 'garment', CAST(product_size_id AS VARCHAR), coalesce(strftime(returned_at, '%d %b %Y'), '-'),
       substr(CAST(issued_at AS VARCHAR), 1, 10), NULL, upper(status), NULL,
       CAST(month(issued_at) AS INT), CAST(year(issued_at) AS INT)
FROM user_uniforms""",
)
def scalar_showcase(t):
    def shown(column):
        return F.date_format(column, "dd MMM yyyy")

    def parts(column):
        return [F.month(column).alias("month"), F.year(column).alias("year")]

    none = F.lit(None).cast("string")
    orders = t.order_carts.select(
        F.lit("order").alias("kind"), F.col("id").cast("string").alias("id"), shown("created_at").alias("shown_date"),
        F.date_format("created_at", "yyyy-MM-dd").alias("iso_date"), money_text(F.col("total_price")).alias("amount"),
        status_label(F.col("status")).alias("label"),
        F.date_format(F.col("created_at") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss").alias("expires"),
        *parts("created_at"),
    )
    posts = t.news_posts.select(
        F.lit("post").alias("kind"), F.col("id").cast("string").alias("id"), shown("created_at").alias("shown_date"),
        F.date_format("created_at", "yyyy-MM-dd").alias("iso_date"), none.alias("amount"),
        excerpt(F.col("content")).alias("label"), none.alias("expires"), *parts("created_at"),
    )
    garments = t.user_uniforms.select(
        F.lit("garment").alias("kind"), F.col("product_size_id").cast("string").alias("id"),
        dash_if_empty(shown("returned_at")).alias("shown_date"),
        F.date_format("issued_at", "yyyy-MM-dd").alias("iso_date"), none.alias("amount"),
        F.upper("status").alias("label"), none.alias("expires"), *parts("issued_at"),
    )
    return orders.unionByName(posts).unionByName(garments)
