"""The library's tables as told from the star schema and corpus tables that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL = "element_at(array('public', 'internal', 'confidential', 'secret'), cast(pmod({0}, 4) as int) + 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each document: years 2010 to 2024 and none, reliability in tenths, levels in turn."""
    docs = table(spark, sf_dir, "documents")
    year = F.when(F.pmod("doc_id", F.lit(16)) < 15, F.lit(2010) + F.pmod("doc_id", F.lit(16))).cast("int")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("source").alias("source_type"), F.col("lang").alias("language"), year.alias("year"), (F.pmod("doc_id", F.lit(10)) / 10).alias("reliability_score"), F.expr(LEVEL.format("doc_id")).alias("confidentiality"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("source_id"), "text")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each line item: its part has a property (the return flag) with a value range from the quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.col("l_suppkey").alias("source_id"),
        F.col("l_partkey").cast("string").alias("subject"), F.col("l_returnflag").alias("property"), F.lit("between").alias("comparator"), F.lit(None).cast("double").alias("value"),
        F.col("l_quantity").alias("min_value"), (F.col("l_quantity") + 20).alias("max_value"), F.col("l_linestatus").alias("unit"), (1 - F.col("l_discount")).alias("confidence"),
        F.when(F.col("l_linestatus") == "O", "candidate").otherwise("verified").alias("status"), F.when(F.col("l_tax") > 0.05, "suspicious").otherwise("valid").alias("validation_status"),
    )


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as nodes: 1.., 101.. and 1001..; nation to region and customer to nation."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    up = nation.select((F.col("n_nationkey") + 101).cast("long").alias("subject_id"), (F.col("n_regionkey") + 1).cast("long").alias("object_id"), F.lit("in_region").alias("predicate"))
    down = customer.select((F.col("c_custkey") + 1001).alias("subject_id"), (F.col("c_nationkey") + 101).cast("long").alias("object_id"), F.lit("in_nation").alias("predicate"))
    return up.unionByName(down).withColumn("id", F.xxhash64("subject_id", "object_id"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier supplies a part, once for each distinct pair; suppliers are nodes from 10000001 on."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.select((F.col("l_suppkey") + 10_000_000).alias("subject_id"), F.col("l_partkey").alias("object_id"), F.lit("supplies").alias("predicate"), F.lit(1).alias("source_id"), F.lit("line item").alias("evidence")).withColumn("id", F.xxhash64("subject_id", "object_id"))


def supply_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    return part.select(F.col("p_partkey").alias("id"), F.lit("Material").alias("type"), F.col("p_name").alias("name")).unionByName(
        supplier.select((F.col("s_suppkey") + 10_000_000).alias("id"), F.lit("Process").alias("type"), F.col("s_name").alias("name"))
    )


def disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dispute for each order: its priority is the severity, finished orders are resolved, and it is due 30 days after its date."""
    orders = table(spark, sf_dir, "orders")
    severity = F.when(F.col("o_orderpriority").rlike("^1"), "critical").when(F.col("o_orderpriority").rlike("^2"), "high").when(F.col("o_orderpriority").rlike("^3"), "medium").otherwise("low")
    due = F.when(F.col("o_orderpriority").rlike("^5"), None).otherwise(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("fact_id"), severity.alias("severity"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status"), due.alias("due_at"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as review commands on facts, a fact for each user."""
    action = F.when(F.col("event_type") == "click", "verify").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "view", "comment").when(F.col("event_type") == "purchase", "contradict").otherwise("supersede")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("fact_id"), F.col("event_type").alias("reviewer"), F.lit("analyst").alias("role"), action.alias("action"), F.lit(None).cast("string").alias("comment"), F.col("ts").alias("at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users: role by key, department by segment, one in seven inactive."""
    role = F.expr("element_at(array('external_partner', 'researcher', 'analyst', 'manager', 'admin'), cast(pmod(c_custkey, 5) as int) + 1)")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("user_name"), role.alias("role"), F.lower("c_mktsegment").alias("department"), (F.pmod("c_custkey", F.lit(7)) > 0).alias("active"), F.lit(None).cast("timestamp_ntz").alias("deactivated_at"), F.col("c_nationkey").alias("nation"))
