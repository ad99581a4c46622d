"""Test tables as the records that the operators judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.operators.policy import Policy

#: cadence is judged as of February 2024 (events), gifts as of June 2001 (orders)
POLICY = Policy(as_of="2024-02-15", gifts_as_of="2001-06-01", least_days=17, multiplier=25, increment=5_000, least=100_000, most=5_000_000, review_from=4_000_000, campaign_name="Winter Beds")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: last, largest and all gifts in cents. The last is picked by a struct maximum, so map sides combine."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    last = F.max(F.struct("day", "o_orderkey", "cents"))
    return orders.groupBy("o_custkey").agg(last.alias("last"), F.max("cents").alias("largest_cents"), F.sum("cents").alias("lifetime_cents"), F.count("*").alias("n_gifts")).select("o_custkey", F.col("last.cents").alias("last_gift_cents"), F.col("last.day").alias("last_gift_date"), "largest_cents", "lifetime_cents", "n_gifts")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e")).select("user_id", F.to_date("e.ts").alias("last_contact_date"), F.col("e.event_type").alias("last_event"))


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    rows = c.join(gifts(spark, sf_dir), key == F.col("o_custkey"), "left").join(contacts(spark, sf_dir), key == F.col("user_id"), "left")
    segment = F.create_map(*map(F.lit, ("AUTOMOBILE", "general", "BUILDING", "mid_value", "FURNITURE", "major", "HOUSEHOLD", "principal", "MACHINERY", "lapsed")))[F.col("c_mktsegment")]
    return rows.select(
        key.alias("custkey"),
        F.concat(F.lit("CUST-"), key.cast("string")).alias("donor_id"),
        F.element_at(F.split("c_name", "#"), 1).alias("first_name"),
        F.when(key % 3 != 0, F.concat(F.lit("Family"), F.col("c_nationkey").cast("string"))).alias("last_name"),
        F.when(key % 7 == 0, F.lit("Dr.")).alias("title"),
        F.when(key % 5 == 0, F.lit("letter")).otherwise(F.lit("email")).alias("channel"),
        F.when(F.col("last_event") == "error", "denied").when(F.col("last_event") == "view", "unknown").otherwise("granted").alias("consent"),
        (F.col("c_acctbal") < 0).alias("do_not_contact"),
        F.when(key % 11 != 0, F.concat(F.lit("c"), key.cast("string"), F.lit("@example.org"))).alias("email"),
        (key % 13 != 0).alias("has_address"),
        segment.alias("segment"),
        F.when(key % 17 == 0, F.lit("EUR")).otherwise(F.lit("USD")).alias("currency"),
        "last_gift_cents",
        "last_gift_date",
        "largest_cents",
        "lifetime_cents",
        "n_gifts",
        "last_contact_date",
    )


def dealt(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as shuffles have: few bytes that cost much work must not be put together in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def donor_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as facts of their sources: ids repeat within a source, approval comes from the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    fact_id = F.concat(F.lit("donor.doc-"), (F.col("doc_id") % 500).cast("string"))
    # the first of each id is found on narrow rows; texts meet it by their own key, as they meet their labels
    first = docs.select("doc_id", "source", fact_id.alias("fact_id")).groupBy("source", "fact_id").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    rows = docs.withColumn("fact_id", fact_id).join(first, "doc_id", "left").join(labels, "doc_id", "left")
    return rows.select("doc_id", "source", "fact_id", "text", (F.col("quality") == 1).alias("approved"), F.coalesce("first", F.lit(False)).alias("first_of_id"))
