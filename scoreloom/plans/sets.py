"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import ordered
from scoreloom.plans.registry import query
from scoreloom.session import table


def keys(spark: SparkSession, d: str, status: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderstatus") == status).select("o_custkey")


@query("u01_intersection", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u01(spark: SparkSession, d: str) -> DataFrame:
    return keys(spark, d, "F").intersect(keys(spark, d, "O")).intersect(keys(spark, d, "P"))


@query("u02_difference", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u02(spark: SparkSession, d: str) -> DataFrame:
    return keys(spark, d, "F").subtract(keys(spark, d, "P"))


@query("u03_distinct_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def u03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("k"))).distinct()


@query("u04_bag_union", "SELECT o_orderpriority, count(*) AS n FROM (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderpriority FROM orders WHERE o_totalprice > 100000) GROUP BY 1")
def u04(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").select("o_orderpriority").unionByName(orders.where("o_totalprice > 100000").select("o_orderpriority")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("u05_ordered_dedup", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2 ORDER BY 3")
def u05(spark: SparkSession, d: str) -> DataFrame:
    return ordered.first_of(table(spark, d, "documents"), ["source", "lang"], "doc_id").orderBy("doc_id")


@query("u06_set_equality", "WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY 1, 2) SELECT user_id, count(DISTINCT kinds) = 1 AS same, count(*) AS days FROM s GROUP BY 1")
def u06(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return days.groupBy("user_id").agg((F.count_distinct("kinds") == 1).alias("same"), F.count(F.lit(1)).alias("days"))
