"""Registered queries: streaming jobs, run over all events and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from garbline.plans.registry import query
from garbline.sources import events as ev
from garbline.streaming import jobs
from garbline.streaming.sinks import absent_to_table, append_to_table, batches_to_table, changes_to_table, latest_rows

WATERMARK = "2 days"
# The given events arrive as so many files, one after the other, and a batch takes one.
ARRIVALS = 3


def _events(t, watermark=None):
    return ev.read_events(t.spark, ev.staged_arrivals(t.events, ARRIVALS), watermark, 1)


def _stream(t):
    return _events(t, WATERMARK)


def _plain(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


@query(
    "events_scan",
    """
SELECT e.event_id, e.ts, e.user_id AS order_id, c.command, CAST(e.value AS DOUBLE) AS value
FROM events e JOIN commands c ON c.event_id = e.event_id""",
)
def events_scan(t):
    events = _events(t)
    scanned = events.select(
        "event_id", _plain("ts"), F.col("user_id").alias("order_id"), ev.command().alias("command"), "value"
    )
    return append_to_table(scanned)


@query(
    "stream_status",
    """
SELECT order_id,
       CASE WHEN last_cancel IS NOT NULL AND (last_set IS NULL OR last_cancel > last_set)
             AND coalesce(set_to, '') NOT IN ('packed', 'completed') THEN 'cancelled' ELSE set_to END AS status
FROM (SELECT order_id, max((ts, event_id)) FILTER (command <> 'cancelled') AS last_set,
             max((ts, event_id)) FILTER (command = 'cancelled') AS last_cancel,
             max_by(command, (ts, event_id)) FILTER (command <> 'cancelled') AS set_to
      FROM commands GROUP BY order_id)""",
)
def stream_status(t):
    return jobs.current_status(changes_to_table(jobs.status_stream(ev.status_commands(_stream(t)))))


@query(
    "stream_stock",
    """
SELECT event_id % (SELECT count(*) FROM part) AS sku,
       CAST(sum(CASE event_type WHEN 'purchase' THEN -1 WHEN 'signup' THEN 1
                ELSE CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END END) AS BIGINT) AS net,
       count(*) AS movements
FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY 1""",
)
def stream_stock(t):
    changes = changes_to_table(jobs.stock_stream(ev.stock_movements(_events(t), t.n_skus)))
    return latest_rows(changes, ["sku"])


@query(
    "stream_spend_daily",
    """
SELECT user_id, date_trunc('day', ts) AS day, date_trunc('month', ts) AS month,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS amount, count(*) AS purchases
FROM events WHERE event_type = 'purchase' GROUP BY 1, 2, 3""",
)
def stream_spend_daily(t):
    changes = changes_to_table(jobs.spend_stream(ev.spend_events(_stream(t))))
    rows = latest_rows(changes, ["user_id", "day"])
    return rows.select("user_id", _plain("day"), _plain("month"), "amount", "purchases")


@query(
    "stream_engagement",
    """
WITH marks AS (
  SELECT (user_id * 13 + event_id % 3) % (SELECT count(*) FROM documents) AS post_id, ts,
         CASE event_type WHEN 'click' THEN 'like' WHEN 'view' THEN 'read' ELSE 'comment' END AS kind
  FROM events WHERE event_type IN ('click', 'view', 'purchase')),
hours AS (SELECT post_id, kind, ts, unnest(range(0, 6)) AS back FROM marks)
SELECT date_trunc('hour', ts) - to_hours(CAST(back AS INT)) AS window_start,
       date_trunc('hour', ts) - to_hours(CAST(back AS INT)) + INTERVAL 6 HOUR AS window_end,
       post_id, kind, count(*) AS marks
FROM hours GROUP BY ALL""",
)
def stream_engagement(t):
    changes = changes_to_table(jobs.engagement_stream(ev.engagement_events(_stream(t), t.n_posts)))
    rows = latest_rows(changes, ["window_start", "window_end", "post_id", "kind"])
    return rows.select(_plain("window_start"), _plain("window_end"), "post_id", "kind", "marks")


@query(
    "stream_read_marks",
    "SELECT DISTINCT (user_id * 13 + event_id % 3) % (SELECT count(*) FROM documents) AS post_id, user_id FROM events WHERE event_type = 'view'",
)
def stream_read_marks(t):
    reads = ev.engagement_events(_events(t), t.n_posts).where(F.col("kind") == "read")
    return absent_to_table(reads, jobs.read_marks_table(t.spark))


@query(
    "outbox",
    """
SELECT event_id, order_id, 'new order' AS kind, 'packer' AS audience, CAST(NULL AS BIGINT) AS recipient_id,
       CAST(NULL AS VARCHAR) AS recipient
FROM commands WHERE command = 'submitted'
UNION ALL
SELECT c.event_id, c.order_id, c.command, NULL, u.id, u.email
FROM commands c JOIN order_carts oc ON oc.id = c.order_id JOIN users u ON u.id = oc.supervisor_id
WHERE c.command IN ('packed', 'completed')""",
)
def outbox(t):
    commands = ev.status_commands(_events(t))
    carts, users = jobs.outbox_sides(t.order_carts, t.users)
    return batches_to_table(commands, lambda batch: jobs.outbox(batch, carts, users), jobs.OUTBOX_SCHEMA)


@query(
    "audience_members",
    "SELECT 'packer' AS audience, id AS recipient_id, email AS recipient FROM users WHERE system_role = 'packer'",
)
def audience_members(t):
    return jobs.audience_members(t.users)
