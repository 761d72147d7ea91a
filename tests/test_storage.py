from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException

from garbline.schemas import SCHEMAS
from garbline.session import cut_and_count, remove_path, scratch_path, shared_dir
from garbline.sinks import exports
from garbline.sources import tables as src
from tests.data import at, rows, table, tables


def test_load_checks_and_casts(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id INT, name STRING").write.parquet(f"{tmp_path}/sites")
    spark.createDataFrame([(1,)], "id INT").write.parquet(f"{tmp_path}/facilities")
    loaded = src.load(spark, str(tmp_path), ["sites"])
    assert dict(loaded["sites"].dtypes) == SCHEMAS["sites"] | {"id": "bigint", "name": "string"}
    with pytest.raises(ValueError, match="name"):
        src.load(spark, str(tmp_path), ["facilities"])


def test_text_load_turns_blanks_to_null(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,name,article_number,type,price\n1,Red , ,,12.50\n")
    row = src.load_text(spark, f"{tmp_path}/p.csv", "products").first()
    assert (row["name"], row["article_number"], row["type"], str(row["price"])) == ("Red", None, None, "12.50")


def sample(spark):
    return tables(
        spark,
        users=[{"id": 1, "full_name": "Boss", "system_role": "supervisor"}],
        products=[{"id": "p", "name": "P", "article_number": "1"}],
        product_sizes=[{"id": 1, "product_id": "p", "size": "S"}],
        order_carts=[{"id": 1, "supervisor_id": 1, "status": "completed", "created_at": at("2024-05-01 10:11:12")},
                     {"id": 2, "supervisor_id": 1, "status": "created", "created_at": at("2024-05-02")}],
        order_items=[{"cart_id": 1, "product_size_id": 1, "quantity": 2, "price_at_time": Decimal("3.00")}],
    )


def test_exports(spark, tmp_path):
    t = sample(spark)
    lines = exports.order_lines_export(t)
    assert len(lines.columns) == 13 and lines.first()["worker"] is None and lines.first()["subtotal"] == 6.0
    assert exports.order_lines_export(t, viewer=2, role="supervisor").count() == 0
    assert exports.order_lines_export(t, status="created").count() == 0
    report = exports.order_report(t).first()
    assert (report["date"], report["price"], report["worker"], report["qty"]) == ("2024-05-01", "3.00", "-", "2")
    for fmt in exports.FORMATS:
        exports.write_export(exports.order_summary_export(t), f"{tmp_path}/{fmt}", fmt)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    exports.write_export(exports.order_summary_export(t), f"{tmp_path}/by", "parquet", partition_by="status")
    assert rows(spark.read.parquet(f"{tmp_path}/by").where("status = 'created'"), "id") == [(2,)]
    with pytest.raises(ValueError):
        exports.write_export(lines, f"{tmp_path}/x", "xlsx")


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    path = scratch_path(spark, "x")
    assert path.startswith(shared_dir(spark)) and path != scratch_path(spark, "x")


def test_cut_lineage_keeps_schema_and_counts(spark):
    df = spark.sql("SELECT id, id * 2 AS n, NULL AS nothing, array(id) AS a FROM range(7)")
    cut, n = cut_and_count(df)
    assert n == 7 and cut.columns == df.columns and sorted(r["n"] for r in cut.collect()) == [2 * i for i in range(7)]
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    remove_path(spark, path)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_orders_join_the_lines_last(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = exports.order_lines_export(sample(spark))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert [r["order_id"] for r in lines.collect()] == [1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # joins from the last to the first: what each adds is not shuffled by those before it in the plan
    keys = [line.split("[")[1].split("#")[0] for line in plan.splitlines() if "SortMergeJoin [" in line]
    assert keys[:3] == ["cart_id", "product_size_id", "team_member_id"]
