"""Declared schemas of the domain tables, and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = "DECIMAL(12,2)"

# Fixed values of the domain (must equal the source system's, stated as they are).
STATUSES = ["created", "submitted", "packed", "completed", "cancelled"]
ACTIVE_STATUSES = ["created", "submitted", "packed"]
PENDING_STATUSES = ["submitted", "created"]
SPENT_STATUSES = ["packed", "completed"]
CANCEL_OFFERED = ["created", "submitted"]
CANCEL_REFUSED = ["packed", "completed"]
SYSTEM_ROLES = ["admin", "supervisor", "packer"]
PRODUCT_TYPES = ["SHIRT", "PANTS", "SHOES"]
ROLE_EVERYONE = "Everyone"
ROLE_PACKER = "Packer"
AUDIENCE_ALL = "all"
RETURN_BUTTONS = ["worn_out", "damaged", "size_exchange", "stolen", "other"]
RETURNED_PREFIX = "returned_"
LOW_STOCK = 2
STOCK_CUTS = ([5, 15], ["critical", "warning", "ok"])
HIGHLIGHT_CUTS = ([2], ["low", "ok"])
DAYS_CUTS = ([14], ["critical", "warning"])
BUDGET_CUTS = ([70, 90], ["green", "amber", "red"])

# One schema per domain table. Measures are INT, keys BIGINT, money DECIMAL(12,2).
_DDL = {
    "users": "id BIGINT, full_name STRING, email STRING, system_role STRING, job_role_id BIGINT,"
    " supervisor_id BIGINT, facility_id BIGINT, monthly_budget DECIMAL(14,2)",
    "team_members": "id BIGINT, full_name STRING, employee_number STRING, supervisor_id BIGINT,"
    " facility_id BIGINT, job_role_id BIGINT",
    "user_measurements": "user_id BIGINT, shoe_size STRING",
    "job_roles": "id BIGINT, name STRING",
    "worker_sizes": "team_member_id BIGINT, product_type STRING, size STRING",
    "products": "id STRING, name STRING, article_number STRING, type STRING, price DECIMAL(12,2)",
    "product_sizes": "id BIGINT, product_id STRING, size STRING, stock BIGINT",
    "product_job_roles": "product_id STRING, job_role_id BIGINT",
    "order_carts": "id BIGINT, supervisor_id BIGINT, team_member_id BIGINT, status STRING,"
    " total_price DECIMAL(12,2), created_at TIMESTAMP_NTZ",
    "order_items": "cart_id BIGINT, product_size_id BIGINT, team_member_id BIGINT, quantity INT,"
    " price_at_time DECIMAL(12,2), ordered_at TIMESTAMP_NTZ",
    "user_uniforms": "product_size_id BIGINT, team_member_id BIGINT, user_id BIGINT, status STRING,"
    " issued_at TIMESTAMP_NTZ, returned_at TIMESTAMP_NTZ",
    "supervisor_delegations": "id BIGINT, from_supervisor_id BIGINT, to_supervisor_id BIGINT,"
    " start_date DATE, end_date DATE",
    "news_posts": "id BIGINT, title STRING, content STRING, created_by BIGINT, target_role STRING,"
    " pinned INT, created_at DATE",
    "news_reads": "post_id BIGINT, user_id BIGINT",
    "news_like_clicks": "post_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ",
    "news_likes": "post_id BIGINT, user_id BIGINT",
    "news_comments": "id BIGINT, post_id BIGINT, user_id BIGINT, comment STRING,"
    " created_at TIMESTAMP_NTZ",
    "facilities": "id BIGINT, name STRING",
    "sites": "id BIGINT, name STRING",
    "user_sites": "user_id BIGINT, site_id BIGINT",
}

EVENTS_DDL = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)

# table -> {column: type}
SCHEMAS = {
    name: dict(column.strip().split(" ", 1) for column in ddl.split(", ")) for name, ddl in _DDL.items()
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` to the declared schema of ``table``; fail on a missing column."""
    schema = SCHEMAS[table]
    missing = [name for name in schema if name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in schema.items()])
