"""Streams over several files and batches against their batch twins; late data; recovery of a batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from garbline.operators.status_jobs import apply_status
from garbline.schemas import EVENTS_DDL
from garbline.sources import events as ev
from garbline.streaming import jobs
from garbline.streaming.keyed import BUCKETS
from garbline.streaming.sinks import absent_to_table, batches_to_table, changes_to_table, latest_rows
from tests.data import at, rows, table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events in several files, so that the stream takes several batches."""
    path = tmp_path_factory.mktemp("stream")
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    events.repartitionByRange(4, "ts").write.parquet(f"{path}/events.parquet")
    return str(path)


def batch_events(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_status_over_batches(spark, split_events):
    changes = changes_to_table(jobs.status_stream(ev.status_commands(ev.read_events(spark, split_events, files_per_batch=1))))
    assert changes.select("batch").distinct().count() > 1
    got = rows(jobs.current_status(changes), "order_id", "status")
    assert got == rows(jobs.current_status(jobs.status_stream(ev.status_commands(batch_events(spark)))), "order_id", "status")


def test_status_stream_agrees_with_batch_job(spark):
    commands = ev.status_commands(batch_events(spark))
    carts = commands.select(F.col("order_id").alias("id")).distinct().withColumn("status", F.lit("created"))
    assert rows(apply_status(carts, commands), "id", "status") == rows(jobs.current_status(jobs.status_stream(commands)), "order_id", "status")


def test_state_of_old_orders_leaves(spark, tmp_path):
    """Every week brings new orders, and one old order is cancelled long after its state has left."""
    kinds = ["signup", "click", "view"]
    weeks = [[event(100 * w + i, f"2024-{1 + w // 4:02d}-{1 + 7 * (w % 4):02d} 10:00", kinds[i % 3], user=100 * w + i // 3) for i in range(30)] for w in range(12)]
    weeks[8].append(event(99_999, "2024-03-01 11:00", "error", user=0))
    weeks[8].append(event(99_998, "2024-03-01 11:00", "click", user=1))
    write_batches(spark, tmp_path, weeks)
    progress = []
    commands = ev.status_commands(ev.read_events(spark, str(tmp_path), "2 days", files_per_batch=1))
    changes = changes_to_table(jobs.status_stream(commands), progress=progress)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert len(held) >= 12 and max(held) <= 32
    got = dict(rows(jobs.current_status(changes)))
    assert len(got) == 120 and got[1] == "submitted" and {v for k, v in got.items() if k > 1} == {"packed"}
    assert got[0] == "packed"  # a packed order cannot be cancelled, even by a late command


def test_stock_over_batches(spark, split_events):
    changes = changes_to_table(jobs.stock_stream(ev.stock_movements(ev.read_events(spark, split_events, files_per_batch=1), F.lit(50))))
    assert rows(latest_rows(changes, ["sku"])) == rows(jobs.stock_stream(ev.stock_movements(batch_events(spark), F.lit(50))))


def test_outbox_over_batches(spark, split_events):
    users = table(spark, "users", [{"id": -2, "email": "p", "system_role": "packer"}, {"id": 1, "email": "s", "system_role": "supervisor"}])
    carts = table(spark, "order_carts", [{"id": i, "supervisor_id": 1} for i in range(20)])
    commands = ev.status_commands(ev.read_events(spark, split_events, files_per_batch=1))
    sides = jobs.outbox_sides(carts, users)
    got = batches_to_table(commands, lambda batch: jobs.outbox(batch, *sides), jobs.OUTBOX_SCHEMA)
    assert rows(got) == rows(jobs.outbox(ev.status_commands(batch_events(spark)), *sides))
    assert {r["kind"] for r in got.collect()} == {"new order", "packed", "completed"}


def test_outbox_reads_the_buckets_of_its_batch(spark):
    """The files of carts that are read grow with the batch's orders, not with the carts."""
    carts = spark.range(20_000).select(F.col("id"), (F.col("id") % 7).alias("supervisor_id"))
    users = table(spark, "users", [{"id": i, "email": f"s{i}", "system_role": "supervisor"} for i in range(7)])
    sides = jobs.outbox_sides(carts, users)
    files = {}
    for n in (1, 5, 5000):
        batch = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") * 3).alias("order_id"), F.lit("packed").alias("command"))
        files[n] = len(sides[0].near(batch).inputFiles())
        assert jobs.outbox(batch, *sides).count() == n
    assert files[1] == 1 and files[5] <= 5 and files[5000] == BUCKETS
    nothing = batch.where("order_id < 0")
    assert sides[0].near(nothing).count() == 0 and jobs.outbox(nothing, *sides).count() == 0


def write_batches(spark, path, batches):
    """One file per batch, named so that the stream reads them in order."""
    for number, batch in enumerate(batches):
        df = spark.createDataFrame(batch, EVENTS_DDL)
        df.coalesce(1).write.mode("append").parquet(f"{path}/events{number}.parquet")


def event(number, when, kind="purchase", user=1, value=10.0):
    return (number, at(when), user, kind, value, "{}")


def test_late_spend_is_dropped(spark, tmp_path):
    write_batches(spark, tmp_path, [
        [event(1, "2024-01-01 10:00"), event(2, "2024-01-05 10:00")],
        [event(3, "2024-01-05 11:00")],
        [event(4, "2024-01-01 12:00"), event(5, "2024-01-04 12:00")],
    ])
    stream = ev.spend_events(ev.read_events(spark, str(tmp_path), "2 days", files_per_batch=1))
    got = latest_rows(changes_to_table(jobs.spend_stream(stream)), ["user_id", "day"])
    by_day = {d.date(): a for d, a in rows(got.withColumn("day", F.col("day").cast("timestamp_ntz")), "day", "amount")}
    # 1 January is closed when its second purchase arrives; 4 January is within the delay.
    assert by_day == {dt.date(2024, 1, 1): 10.0, dt.date(2024, 1, 4): 10.0, dt.date(2024, 1, 5): 20.0}


def test_read_marks_once_at_any_distance(spark, tmp_path):
    write_batches(spark, tmp_path, [
        [event(3 * i, "2024-01-01 10:00", "view") for i in range(40)],
        [event(300, "2024-01-01 11:00", "view"), event(301, "2024-01-01 11:00", "view")],
        [event(600, "2025-02-01 11:00", "view"), event(602, "2025-02-01 11:00", "view")],
        [event(603, "2023-02-01 11:00", "view")],
    ])
    marks = ev.engagement_events(ev.read_events(spark, str(tmp_path), files_per_batch=1), F.lit(1000))
    got = absent_to_table(marks, jobs.read_marks_table(spark))
    assert rows(got, "post_id", "user_id") == [(13, 1), (14, 1), (15, 1)]


def test_inserting_a_batch_again_changes_nothing(spark, tmp_path):
    marks = jobs.read_marks_table(spark, str(tmp_path / "marks"))
    batch = lambda *pairs: spark.createDataFrame(pairs, "post_id BIGINT, user_id BIGINT")
    marks.insert_absent(batch((1, 1), (1, 2), (1, 1)), 0)
    for _ in range(2):
        marks.insert_absent(batch((1, 2), (2, 2), (3, None)), 1)
    marks.insert_absent(batch((2, 2), (4, 4), (3, None)), 2)
    assert rows(marks.read()) == sorted([(1, 1), (1, 2), (2, 2), (3, None), (4, 4)], key=repr)
    # only the buckets of a batch's keys are read
    assert len(marks.near(batch((1, 1))).inputFiles()) <= 2


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    write_batches(spark, source, [[event(1, "2024-01-01 10:00", "signup")]])
    build = lambda: jobs.stock_stream(ev.stock_movements(ev.read_events(spark, str(source)), F.lit(50)))
    assert rows(latest_rows(changes_to_table(build(), root), ["sku"])) == [(1, 1, 1)]
    write_batches(spark, source, [[event(51, "2024-01-01 11:00", "purchase")]])
    assert rows(latest_rows(changes_to_table(build(), root), ["sku"])) == [(1, 0, 2)]


def test_rows_are_dealt_out_before_they_are_counted(spark):
    when = "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 60)"
    marks = spark.range(400).selectExpr("id % 7 AS post_id", "'like' AS kind", "id AS user_id", f"{when} AS ts", "id AS event_id")
    counted = jobs.engagement_stream(marks.coalesce(1))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange hashpartitioning") > plan.rindex("HashAggregate")
    assert rows(counted) == rows(jobs.engagement_stream(marks))


def test_changes_are_dealt_by_key_before_the_latest_is_taken(spark):
    changes = spark.range(300).selectExpr("id % 100 AS sku", "id AS net", "id div 100 AS batch").coalesce(1)
    last = latest_rows(changes, ["sku"])
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("Exchange") > plan.rindex("Aggregate")
    assert rows(last) == sorted(((k, 200 + k) for k in range(100)), key=repr)
