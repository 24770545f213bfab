"""Sources and sinks, as round trips through files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.plans.registry import query
from scoreloom.session import table
from scoreloom.sources import cases, files, tables, tail
from scoreloom.streaming import sinks


@query("s01_parquet", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("s02_jsonl", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s02(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    files.append_jsonl(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return files.jsonl(spark, path, "c_custkey long, c_name string, c_mktsegment string")


@query("s03_numbered_jsonl", "SELECT n_nationkey * 2 + 1 AS line_no, n_nationkey, n_name FROM nation")
def s03(spark: SparkSession, d: str) -> DataFrame:
    """Every other line is blank and still counts."""
    path = files.scratch(spark)
    rows = table(spark, d, "nation").select("n_nationkey", F.concat(F.to_json(F.struct("n_nationkey", "n_name")), F.lit("\n")).alias("value"))
    rows.coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(path)
    return files.numbered_jsonl(spark, path, "n_nationkey int, n_name string", "*.txt").select("line_no", "n_nationkey", "n_name")


@query("s04_tolerant_jsonl", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0")
def s04(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    value = F.when(F.col("s_suppkey") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("s_suppkey")))
    table(spark, d, "supplier").select(value.alias("value")).write.text(path)
    return files.jsonl(spark, path, "s_suppkey long", tolerant=True)


@query("s05_recursive_glob", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s05(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both.select(F.col("r_name").alias("region"), F.col("r_name").alias("folder"), "n_name").write.partitionBy("folder").json(path)
    found = spark.read.schema("region string, n_name string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return found.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


#: Log lines that one task sorts, about.
ROWS_A_TASK = 500_000


def worker_seconds(rows: DataFrame) -> DataFrame:
    """The last seconds of each worker and task in a log with a line for each of rows, in many files; those that aren't done tell of no completion."""
    path = files.scratch(rows.sparkSession)
    line = F.when(F.col("done"), F.format_string("INFO Worker w%d completed task t%d_compile in %.1fs", F.col("l_linenumber") % 3, "l_orderkey", "l_quantity")).otherwise(F.format_string("INFO Worker w%d took task t%d_compile", F.col("l_linenumber") % 3, "l_orderkey"))
    parts = rows.count() // ROWS_A_TASK + 1  # what a task sorts is bounded, whatever the input
    rows.repartitionByRange(parts, "l_orderkey").sortWithinPartitions("l_orderkey", "l_quantity").select(line.alias("value")).write.text(path)
    done = files.worker_log(rows.sparkSession, path).repartition(parts, "worker_id", "task_id")
    return done.groupBy("worker_id", "task_id").agg(F.max_by("seconds", F.struct("path", "line_no")).alias("seconds"))


@query("s06_worker_log_whole", "SELECT 'w' || (l_linenumber % 3) AS worker_id, 't' || l_orderkey || '_compile' AS task_id, max(l_quantity) AS seconds FROM lineitem GROUP BY 1, 2")
def s06_whole(spark: SparkSession, d: str) -> DataFrame:
    return worker_seconds(table(spark, d, "lineitem").withColumn("done", F.lit(True)))


@query("s08_log_search_whole", "SELECT 't' || o_orderkey AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN 'worker_' || (o_orderkey % 4) ELSE 'w1' END AS worker FROM orders")
def s08_whole(spark: SparkSession, d: str) -> DataFrame:
    """The first of two workers named with each task, or the name of the log of tasks that none is named with."""
    folder, task = files.scratch(spark), F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))
    named = F.concat(F.lit("Worker w1 took "), task, F.lit(" now\nWorker w2 took "), task, F.lit(" now"))
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("took "), task, F.lit(" now"))).otherwise(named)
    orders = table(spark, d, "orders").select("o_orderkey", task.alias("task_id"), F.format_string("worker_%d.log", F.col("o_orderkey") % 4).alias("file"), line.alias("line"))
    orders.repartition("file").sortWithinPartitions("file", "o_orderkey").foreachPartition(lambda rows: tail.append_lines(folder, rows))
    return files.log_search(spark, folder, orders, "*.log")


def build_steps(rows: DataFrame) -> DataFrame:
    """The steps of a build log with a line for each of rows, some of them no steps."""
    path = files.scratch(rows.sparkSession)
    end = F.col("l_partkey") % 100 + F.col("l_quantity").cast("long")
    good = F.concat_ws("\t", (F.col("l_partkey") % 100).cast("string"), end.cast("string"), F.lit("0"), F.when(F.col("l_linenumber") % 2 == 0, "a.cuda.o").otherwise("b.o"), F.lit("h"))
    line = F.when(F.col("l_linenumber") < 4, good).when(F.col("l_linenumber") == 4, "# comment").when(F.col("l_linenumber") == 5, "1\t2").otherwise("x\ty\tz\tw")
    rows.select(line.alias("value")).write.text(path)
    return files.build_log(rows.sparkSession, path)


@query("s10_build_log_whole", "SELECT l_partkey % 100 AS start_ms, l_partkey % 100 + CAST(l_quantity AS BIGINT) AS end_ms, CASE WHEN l_linenumber % 2 = 0 THEN 'a.cuda.o' ELSE 'b.o' END AS output FROM lineitem WHERE l_linenumber < 4")
def s10_whole(spark: SparkSession, d: str) -> DataFrame:
    return build_steps(table(spark, d, "lineitem"))


@query("s11_settings", "SELECT 'KEY_' || r_regionkey AS key, r_name AS value FROM region")
def s11(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    k = F.concat(F.lit("KEY_"), F.col("r_regionkey").cast("string"))
    table(spark, d, "region").select(F.concat(F.lit("# note\n"), k, F.lit("=old\n"), k, F.lit('="'), F.col("r_name"), F.lit('"')).alias("value")).write.text(path)
    return files.settings(spark, path)


@query("s12_devices", "SELECT p_brand AS name, CAST(p_size AS DOUBLE) AS memory_mb FROM part")
def s12(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    table(spark, d, "part").select(F.format_string("%s, %d MiB", "p_brand", "p_size").alias("value")).write.text(path)
    return files.devices(spark, path)


@query("s16_build_edges", "SELECT 'o' || s_suppkey AS output, 'cc' AS rule, 'n' || s_nationkey AS source FROM supplier")
def s16(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    table(spark, d, "supplier").select(F.format_string("build o%d: cc n%d\n  flag = 1", "s_suppkey", "s_nationkey").alias("value")).write.text(path)
    return files.build_edges(spark, path)


@query("k02_sorted_jsonl", "SELECT n_nationkey, n_name FROM nation")
def k02(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    files.overwrite_jsonl(table(spark, d, "nation").select("n_nationkey", "n_name"), path, "n_nationkey")
    return files.jsonl(spark, path, "n_nationkey int, n_name string")


@query("k04_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1, 'new'")
def k04(spark: SparkSession, d: str) -> DataFrame:
    """A stored table, its even keys changed and one added."""
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("changed")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("new").alias("c_mktsegment")))
    stored = tables.KeyedTable(spark, files.scratch(spark), "c_custkey long, c_mktsegment string", ["c_custkey"], 16)
    stored.upsert(old)
    stored.upsert(new)
    return stored.read()


@query("s09_log_tail_files", "SELECT user_id, event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 1 ELSE 2 END AS INT) AS part FROM events")
def s09_files(spark: SparkSession, d: str) -> DataFrame:
    """A log a worker grows in three parts, and the logs of every fifth worker begin anew before the last: each line is read once, in its part."""
    folder, state, out = files.scratch(spark), files.scratch(spark), files.scratch(spark)
    spark.dataSource.register(tail.LogTail)
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 3).cast("int").alias("part"))
    for part in range(3):
        name, line = F.format_string("worker_%d.log", "user_id"), F.format_string("Worker %d event %d é", "user_id", "event_id")
        lines = rows.where(F.col("part") == part).select(name.alias("file"), line.alias("line"), (F.lit(part == 2) & (F.col("user_id") % 5 == 0)).alias("anew"), "event_id")
        lines.repartition("file").sortWithinPartitions("file", "event_id").foreachPartition(lambda it: tail.append_lines(folder, it))
        stream = spark.readStream.format("log_tail").option("range", 4096).load(folder)
        stream.writeStream.foreachBatch(sinks.by_batch(f"{out}/{part}")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = [sinks.batches(spark, f"{out}/{part}", tail.SCHEMA).select(F.lit(part).alias("part"), "line") for part in range(3)]
    shape = r"^Worker (\d+) event (\d+) é$"
    lines = found[0].unionByName(found[1]).unionByName(found[2])
    return lines.select(*[F.regexp_extract("line", shape, k).cast("long").alias(n) for k, n in ((1, "user_id"), (2, "event_id"))], "part")


@query("x06_cases", """SELECT o_orderkey, i.idx, CASE WHEN o_orderkey % 3 = 0 AND i.idx % 2 = 1 THEN 'given' ELSE 'case_' || i.idx END AS name, CASE WHEN o_orderkey % 3 = 1 THEN '{"m":' || (i.idx // 2 + 1) || ',"n":' || (i.idx % 2 * 8 + 8) || '}' WHEN o_orderkey % 3 = 2 THEN NULL ELSE '' || i.idx END AS inputs
FROM orders, LATERAL (SELECT unnest(range(0, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 ELSE CASE WHEN o_orderkey % 3 = 1 THEN 4 ELSE 1 END END)) AS idx) i""")
def x06(spark: SparkSession, d: str) -> DataFrame:
    """Cases of each order as declared: a list, a grid, or one case without inputs."""
    cases.register(spark)
    given = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 5).cast("int") - 1), lambda i: F.when(i % 2 == 1, F.concat(F.lit('{"name":"given","input":'), i.cast("string"), F.lit("}"))).otherwise(i.cast("string")))
    listed = F.when(F.col("o_orderkey") % 5 == 0, "[]").otherwise(F.concat(F.lit("["), F.array_join(given, ","), F.lit("]")))
    grid = F.lit('{"grid":{"m":[1,2],"n":[8,16]}}')
    spec = F.when(F.col("o_orderkey") % 3 == 0, listed).when(F.col("o_orderkey") % 3 == 1, grid).otherwise('{"outputs":[1]}')
    rows = table(spark, d, "orders").select("o_orderkey", spec.alias("declared"))
    return rows.lateralJoin(cases.Cases(F.col("declared").outer())).select("o_orderkey", F.col("idx").cast("long").alias("idx"), "name", "inputs")
