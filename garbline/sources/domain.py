"""Domain tables derived from the order-and-supplier star schema of the test data.

Each property is a lazy DataFrame with the declared schema of ``schemas.SCHEMAS``. Foreign
keys of the star schema always resolve, so a column that only needs the key is computed
from the key and costs no join.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garbline.schemas import MONEY, conform
from garbline.session import configure
from garbline.sources.events import post_of_event

# Fixed values of the derivation.
STAFF = [(-1, "admin1", "admin"), (-2, "packer1", "packer"), (-3, "packer2", "packer")]
JOB_ROLES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Everyone", "Packer"]
SIZE_SLOTS = ["SHIRT", "PANTS", "SHOES"]
TYPE_OF_PART = {"ECONOMY": "Shirt", "LARGE": "PANTS", "MEDIUM": "shoes", "PROMO": "Jacket"}
AUDIENCE_OF_LANG = {"en": "all", "de": "supervisor", "fr": "packer"}
REASON_OF_LINE = {
    0: "returned_worn_out",
    1: "returned_damaged",
    2: "returned_size_exchange",
    3: "returned_stolen",
}


def choose(col: Column, mapping: dict, default=None) -> Column:
    chain = None
    for key, value in mapping.items():
        chain = F.when(col == key, value) if chain is None else chain.when(col == key, value)
    return chain.otherwise(F.lit(default).cast("string") if default is None else F.lit(default))


class DomainTables:
    """The domain tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = configure(spark)
        self.path = path

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def _values(self, rows: list[tuple], *columns: str) -> DataFrame:
        """An inline table; unlike rows shipped from Python, the planner knows its size."""
        text = ", ".join(str(row) for row in rows)
        return self.spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(columns)})")

    def _count(self, name: str) -> Column:
        return self.raw(name).agg(F.count("*")).scalar()

    @cached_property
    def n_supervisors(self) -> Column:
        return self._count("supplier")

    @cached_property
    def n_posts(self) -> Column:
        return self._count("documents")

    @cached_property
    def n_skus(self) -> Column:
        return self._count("part")

    @cached_property
    def supplier(self) -> DataFrame:
        return self.raw("supplier")

    @cached_property
    def customer(self) -> DataFrame:
        return self.raw("customer")

    @cached_property
    def part(self) -> DataFrame:
        return self.raw("part")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.raw("lineitem")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    @cached_property
    def users(self) -> DataFrame:
        key = F.col("s_suppkey")
        supervisors = self.supplier.select(
            key.alias("id"),
            F.col("s_name").alias("full_name"),
            F.concat(F.lit("s"), key.cast("string"), F.lit("@example.com")).alias("email"),
            F.lit("supervisor").alias("system_role"),
            F.col("s_nationkey").alias("facility_id"),
            F.when(key % 4 != 0, key % 5 + 1).alias("job_role_id"),
            F.when(key % 10 != 0, key - key % 10).alias("supervisor_id"),
            F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast(MONEY) * 200).alias("monthly_budget"),
        )
        mailed = [(i, name, f"{name}@example.com", role) for i, name, role in STAFF]
        staff = self._values(mailed, "id", "full_name", "email", "system_role")
        return conform(supervisors.unionByName(staff, allowMissingColumns=True), "users")

    @cached_property
    def team_members(self) -> DataFrame:
        key = F.col("c_custkey")
        roles = {segment: str(i + 1) for i, segment in enumerate(JOB_ROLES[:4])}
        return conform(
            self.customer.select(
                key.alias("id"),
                F.col("c_name").alias("full_name"),
                F.when(key % 13 != 0, F.concat(F.lit("E"), key.cast("string"))).alias("employee_number"),
                (key % self.n_supervisors).alias("supervisor_id"),
                F.col("c_nationkey").alias("facility_id"),
                choose(F.col("c_mktsegment"), roles).alias("job_role_id"),
            ),
            "team_members",
        )

    @cached_property
    def user_measurements(self) -> DataFrame:
        key = F.col("c_custkey")
        return conform(
            self.customer.select(
                key.alias("user_id"), F.when(key % 6 != 0, key % 10 + 38).alias("shoe_size")
            ),
            "user_measurements",
        )

    @cached_property
    def job_roles(self) -> DataFrame:
        rows = [(i + 1, name) for i, name in enumerate(JOB_ROLES)]
        return conform(self._values(rows, "id", "name"), "job_roles")

    @cached_property
    def worker_sizes(self) -> DataFrame:
        slots = self.customer.select(
            F.col("c_custkey").alias("team_member_id"),
            F.posexplode(F.array(*[F.lit(s) for s in SIZE_SLOTS])).alias("k", "product_type"),
        )
        worn = slots.where((F.col("team_member_id") + F.col("k")) % 4 != 0)
        return conform(
            worn.withColumn("size", (F.col("team_member_id") * 3 + F.col("k")) % 10 + 28), "worker_sizes"
        )

    @cached_property
    def products(self) -> DataFrame:
        key = F.concat_ws("/", "p_brand", "p_name")
        grouped = self.part.groupBy("p_brand", "p_name").agg(
            F.min("p_type").alias("t"), F.min(F.col("p_retailprice").cast(MONEY)).alias("price")
        )
        return conform(
            grouped.select(
                key.alias("id"),
                F.col("p_name").alias("name"),
                key.alias("article_number"),
                choose(F.col("t"), TYPE_OF_PART).alias("type"),
                "price",
            ),
            "products",
        )

    @cached_property
    def product_sizes(self) -> DataFrame:
        return conform(
            self.part.select(
                F.col("p_partkey").alias("id"),
                F.concat_ws("/", "p_brand", "p_name").alias("product_id"),
                F.col("p_size").alias("size"),
                ((F.col("p_partkey") * 37) % 1500).alias("stock"),
            ),
            "product_sizes",
        )

    @cached_property
    def product_job_roles(self) -> DataFrame:
        size = F.col("p_size")
        links = self.part.select(
            F.concat_ws("/", "p_brand", "p_name").alias("product_id"),
            F.when(size % 9 == 0, F.lit(6)).otherwise(size % 5 + 1).alias("job_role_id"),
        )
        return conform(links.distinct(), "product_job_roles")

    @cached_property
    def order_carts(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "P", "packed")
            .when(F.col("o_orderpriority") == "5-LOW", "created")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "cancelled")
            .otherwise("submitted")
        )
        return conform(
            self.raw("orders").select(
                F.col("o_orderkey").alias("id"),
                (F.col("o_custkey") % self.n_supervisors).alias("supervisor_id"),
                F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("team_member_id"),
                status.alias("status"),
                F.col("o_totalprice").alias("total_price"),
                F.col("o_orderdate").alias("created_at"),
            ),
            "order_carts",
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return conform(
            self.lineitem.select(
                F.col("l_orderkey").alias("cart_id"),
                F.col("l_partkey").alias("product_size_id"),
                F.when(F.col("l_linenumber") != 7, F.col("l_suppkey") * 15 + F.col("l_linenumber")).alias(
                    "team_member_id"
                ),
                F.col("l_quantity").alias("quantity"),
                F.col("l_extendedprice").alias("price_at_time"),
                F.col("l_shipdate").alias("ordered_at"),
            ),
            "order_items",
        )

    @cached_property
    def user_uniforms(self) -> DataFrame:
        line, returned = F.col("l_linenumber"), F.col("l_returnflag") == "R"
        status = (
            F.when(returned, choose(line % 5, REASON_OF_LINE, "returned_lost"))
            .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "lost")
            .otherwise("active")
        )
        return conform(
            self.lineitem.where(line != 7).select(
                F.col("l_partkey").alias("product_size_id"),
                (F.col("l_suppkey") * 15 + line).alias("team_member_id"),
                F.when(line == 1, F.col("l_suppkey")).alias("user_id"),
                status.alias("status"),
                F.col("l_shipdate").alias("issued_at"),
                F.when(returned, F.col("l_shipdate") + F.expr("INTERVAL '30' DAY")).alias("returned_at"),
            ),
            "user_uniforms",
        )

    @cached_property
    def supervisor_delegations(self) -> DataFrame:
        # pmod: the optimizer may carry a date predicate over to staff ids, which are below 0.
        key, m = F.col("s_suppkey"), F.col("m")
        year = (F.pmod(key, F.lit(4)) + 1996).cast("int")
        return conform(
            self.supplier.select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("m")).select(
                (key * 2 + m).alias("id"),
                key.alias("from_supervisor_id"),
                ((key + m + 1) % self.n_supervisors).alias("to_supervisor_id"),
                F.make_date(year, (F.pmod(key, F.lit(12)) + 1).cast("int"), F.lit(1)).alias("start_date"),
                F.make_date(year + m, F.lit(12), F.lit(31)).alias("end_date"),
            ),
            "supervisor_delegations",
        )

    @cached_property
    def news_posts(self) -> DataFrame:
        doc = F.col("doc_id")
        marks = self.raw("labels").select("doc_id", F.col("quality").alias("pinned"))
        return conform(
            self.raw("documents")
            .join(marks, "doc_id", "left")
            .select(
                doc.alias("id"),
                F.col("source").alias("title"),
                F.col("text").alias("content"),
                (doc % self.n_supervisors).alias("created_by"),
                choose(F.col("lang"), AUDIENCE_OF_LANG, "admin").alias("target_role"),
                "pinned",
                F.make_date(
                    F.lit(2024),
                    (F.pmod(doc, F.lit(12)) + 1).cast("int"),
                    (F.pmod(doc, F.lit(28)) + 1).cast("int"),
                ).alias("created_at"),
            ),
            "news_posts",
        )

    def _events_of(self, event_type: str) -> DataFrame:
        return self.events.where(F.col("event_type") == event_type)

    @cached_property
    def news_reads(self) -> DataFrame:
        marks = self._events_of("view").select(
            (F.col("event_id") % self.n_posts).alias("post_id"), "user_id"
        )
        return conform(marks.distinct(), "news_reads")

    @cached_property
    def news_like_clicks(self) -> DataFrame:
        return conform(
            self._events_of("click").select(
                post_of_event(self.n_posts).alias("post_id"), "user_id", "ts"
            ),
            "news_like_clicks",
        )

    @cached_property
    def news_likes(self) -> DataFrame:
        clicks = self.news_like_clicks.groupBy("post_id", "user_id").agg(F.count("*").alias("n"))
        return conform(clicks.where(F.col("n") % 2 == 1), "news_likes")

    @cached_property
    def news_comments(self) -> DataFrame:
        return conform(
            self._events_of("purchase").select(
                F.col("event_id").alias("id"),
                (F.col("event_id") % self.n_posts).alias("post_id"),
                "user_id",
                F.col("props").alias("comment"),
                F.col("ts").alias("created_at"),
            ),
            "news_comments",
        )

    @cached_property
    def facilities(self) -> DataFrame:
        return conform(
            self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
            "facilities",
        )

    @cached_property
    def sites(self) -> DataFrame:
        return conform(
            self.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
            "sites",
        )

    @cached_property
    def user_sites(self) -> DataFrame:
        return conform(
            self.supplier.select(
                F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") % 5).alias("site_id")
            ),
            "user_sites",
        )
