"""Queries on ordered rows: queues, trailing windows, latest states, top rows, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.operators import joins, ordered
from scoreloom.plans.registry import query
from scoreloom.session import table


@query("w01_trailing_errors", """SELECT event_id, user_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS n_trailing,
count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) >= 50 AS alert FROM events""")
def w01(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    out = ordered.trailing_count(rows, "user_id", "us", F.col("event_type") == "error", 300_000_000)
    return out.select("event_id", "user_id", "n_trailing", (F.col("n_trailing") >= 50).alias("alert"))


@query("w02_first_answer", """WITH a AS (SELECT conv_id, min(turn) AS first_turn FROM conversations WHERE role = 'assistant' GROUP BY 1), u AS (SELECT c.conv_id, min(turn) AS later FROM conversations c JOIN a ON a.conv_id = c.conv_id WHERE role = 'user' AND turn > first_turn AND contains(text, 'e') GROUP BY 1)
SELECT conv_id, first_turn, later FROM a LEFT JOIN u USING (conv_id)""")
def w02(spark: SparkSession, d: str) -> DataFrame:
    """The first assistant turn of each conversation and the first later user turn with a mark."""
    rows = table(spark, d, "conversations")
    first = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    marked = rows.where((F.col("role") == "user") & F.contains("text", F.lit("e"))).select("conv_id", "turn")
    later = marked.join(first, "conv_id").where("turn > first_turn").groupBy("conv_id").agg(F.min("turn").alias("later"))
    return first.join(later, "conv_id", "left")


@query("w03_last_match", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def w03(spark: SparkSession, d: str) -> DataFrame:
    return ordered.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "value")


@query("w04_round_robin", """WITH w AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier WHERE s_acctbal > 3000), t AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey, s_suppkey AS worker FROM t JOIN w ON t.i % n = w.i""")
def w04(spark: SparkSession, d: str) -> DataFrame:
    """Each queue's tasks go to the live workers in turn, by the position of either."""
    live = joins.numbered(table(spark, d, "supplier").where("s_acctbal > 3000").select("s_suppkey"), "s_suppkey")
    tasks = ordered.queue_positions(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], ["o_orderkey"])
    n = live.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    turns = tasks.join(F.broadcast(n)).withColumn("position", F.pmod(F.col("fifo_position") - 1, F.col("n")) + 1)
    return turns.join(live, "position").select("o_orderkey", F.col("s_suppkey").alias("worker"))


@query("w05_latest_state", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return ordered.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("w06_rotation", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'b,c,a' ELSE 'c,a,b' END AS methods FROM orders")
def w06(spark: SparkSession, d: str) -> DataFrame:
    methods = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(ordered.rotated(methods, F.col("o_orderkey")), ",").alias("methods"))


@query("w07_wait_action", """WITH e AS (SELECT event_id, epoch_us((SELECT max(ts) FROM events)) // 1000000 - epoch_us(ts) // 1000000 AS age, CASE WHEN event_type = 'view' THEN 'pending' ELSE event_type END AS status, user_id % 7 <> 0 AS owner_ok, CAST(user_id % 3 * 400000 AS BIGINT) AS task_timeout FROM events)
SELECT event_id, CASE WHEN NOT owner_ok THEN 'requeue_stale_assignment' WHEN status <> 'pending' THEN 'keep' WHEN age > CASE WHEN task_timeout > 0 AND 600000 > task_timeout THEN task_timeout ELSE 600000 END THEN 'requeue_queue_wait_timeout' ELSE 'keep' END AS action FROM e""")
def w07(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    events = table(spark, d, "events")
    now = events.agg(F.max(seconds).alias("now"))
    status = F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type"))
    action = ordered.wait_action(F.col("now") - seconds, status, F.col("user_id") % 7 != 0, F.col("user_id") % 3 * 400000, F.lit(600000))
    return events.join(F.broadcast(now)).select("event_id", action.alias("action"))


@query("w08_fifo", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS fifo_position FROM orders")
def w08(spark: SparkSession, d: str) -> DataFrame:
    out = ordered.queue_positions(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", F.col("fifo_position").cast("long").alias("fifo_position"))


@query("w09_node_ids", """WITH f AS (SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY 1) SELECT user_id, 'node-' || row_number() OVER (ORDER BY first_seen) AS node FROM f""")
def w09(spark: SparkSession, d: str) -> DataFrame:
    """Ids by first appearance: one row a host reaches the ordering."""
    hosts = ordered.first_of(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")
    return joins.numbered(hosts, "event_id").select("user_id", F.concat(F.lit("node-"), F.col("position").cast("string")).alias("node"))


@query("w10_free_ports", "WITH f AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS service FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) SELECT service, c_custkey AS port FROM f WHERE service <= 3")
def w10(spark: SparkSession, d: str) -> DataFrame:
    """The first three free candidates in order, one a service."""
    used = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    free = table(spark, d, "customer").select("c_custkey").join(used, "c_custkey", "left_anti").orderBy("c_custkey").limit(3)
    return free.select(F.row_number().over(Window.orderBy("c_custkey")).cast("long").alias("service"), F.col("c_custkey").alias("port"))


@query("t01_dequeue", """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 0 WHEN '3' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 20""")
def t01(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.left("o_orderpriority", F.lit(1)).isin("1", "2"), 0).when(F.left("o_orderpriority", F.lit(1)) == "3", 1).otherwise(2)
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(rank, "o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


@query("t03_top_kernels", "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) SELECT * FROM r WHERE rank <= 5")
def t03(spark: SparkSession, d: str) -> DataFrame:
    """The five dearest of each group; Spark keeps no more than five a group and task before the shuffle."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5").withColumn("rank", F.col("rank").cast("long"))


@query("t05_next_retries", "SELECT event_id, ts + INTERVAL 30 SECOND AS due FROM events WHERE event_type = 'error' ORDER BY 2, 1 LIMIT 10")
def t05(spark: SparkSession, d: str) -> DataFrame:
    errors = table(spark, d, "events").where("event_type = 'error'")
    return errors.select("event_id", (F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("due")).orderBy("due", "event_id").limit(10)


@query("t06_due_retries", "SELECT event_id FROM events WHERE event_type = 'error' AND ts + INTERVAL 30 SECOND <= TIMESTAMP '2024-01-10 00:00:00'")
def t06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error' and ts + INTERVAL 30 SECONDS <= TIMESTAMP_NTZ '2024-01-10 00:00:00'").select("event_id")


@query("t07_examples", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) SELECT event_type, event_id FROM r WHERE i <= 3")
def t07(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("event_id")
    return table(spark, d, "events").select("event_type", "event_id", F.row_number().over(w).alias("i")).where("i <= 3").drop("i")


@query("m01_exact_sample", """WITH s AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('1:' || o_orderkey)) AS i FROM orders) SELECT o_orderkey, o_orderstatus FROM s WHERE o_orderstatus = 'F' AND i <= 60 OR o_orderstatus = 'O' AND i <= 40""")
def m01(spark: SparkSession, d: str) -> DataFrame:
    key = F.md5(F.concat(F.lit("1:"), F.col("o_orderkey").cast("string")))
    return ordered.exact_sample(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": 60, "O": 40}, key)


@query("m02_one_row", "SELECT c_custkey FROM customer ORDER BY md5('3:' || c_custkey) LIMIT 1")
def m02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").orderBy(F.md5(F.concat(F.lit("3:"), F.col("c_custkey").cast("string")))).limit(1).select("c_custkey")


@query("m03_trial_seeds", "SELECT l_orderkey, l_linenumber, md5('42:' || l_linenumber) AS seed FROM lineitem")
def m03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.md5(F.concat(F.lit("42:"), F.col("l_linenumber").cast("string"))).alias("seed"))
