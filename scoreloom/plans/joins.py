"""Join queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import stats, text
from scoreloom.operators import joins, ordered
from scoreloom.plans.registry import query
from scoreloom.session import table

PAIR_SQL = """WITH r AS (SELECT l_orderkey AS base_task_id, sum(l_extendedprice) AS reference_runtime FROM lineitem WHERE l_quantity > 20 GROUP BY 1),
k AS (SELECT o_orderkey AS base_task_id, o_totalprice AS kernel_runtime, o_orderstatus <> 'P' AS correctness FROM orders) """


def results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders read as kernel results, sums of their lines as reference results."""
    references = table(spark, d, "lineitem").where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("base_task_id")).agg(F.sum("l_extendedprice").alias("reference_runtime"))
    kernels = table(spark, d, "orders").select(F.col("o_orderkey").alias("base_task_id"), F.col("o_totalprice").alias("kernel_runtime"), (F.col("o_orderstatus") != "P").alias("correctness"))
    return kernels, references


@query("j01_pair", PAIR_SQL + "SELECT base_task_id, round(reference_runtime, 3) AS reference_runtime, round(CASE WHEN correctness AND kernel_runtime > 0 AND reference_runtime > 0 THEN reference_runtime / kernel_runtime ELSE 0 END, 6) AS speedup FROM k JOIN r USING (base_task_id)")
def j01(spark: SparkSession, d: str) -> DataFrame:
    kernels, references = results(spark, d)
    out = joins.pair_results(kernels, references).where("reference_runtime >= 0")
    return out.select("base_task_id", F.round("reference_runtime", 3).alias("reference_runtime"), F.round("speedup", 6).alias("speedup"))


@query("j02_pair_outer", PAIR_SQL + "SELECT base_task_id, round(coalesce(reference_runtime, -1.0), 3) AS reference_runtime, round(CASE WHEN correctness AND kernel_runtime > 0 AND coalesce(reference_runtime, -1) > 0 THEN reference_runtime / kernel_runtime ELSE 0 END, 6) AS speedup FROM k LEFT JOIN r USING (base_task_id)")
def j02(spark: SparkSession, d: str) -> DataFrame:
    out = joins.pair_results(*results(spark, d))
    return out.select("base_task_id", F.round("reference_runtime", 3).alias("reference_runtime"), F.round("speedup", 6).alias("speedup"))


@query("j03_lookup", """SELECT c_custkey, coalesce(n_name, r_name, 'unknown') AS place FROM customer LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10) n ON c_nationkey = n_nationkey LEFT JOIN region ON c_nationkey % 5 = r_regionkey""")
def j03(spark: SparkSession, d: str) -> DataFrame:
    """A cache is probed first, another table next."""
    cache = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("place"))
    legacy = table(spark, d, "region").select(F.explode(F.sequence("r_regionkey", F.lit(24), F.lit(5))).alias("k"), F.col("r_name").alias("place"))
    out = joins.lookup(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), [cache, legacy], "k", "place")
    return out.select("c_custkey", F.coalesce("place", F.lit("unknown")).alias("place"))


@query("j04_new_and_existing", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS existing FROM customer")
def j04(spark: SparkSession, d: str) -> DataFrame:
    customers, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    old, new = customers.join(orders, "c_custkey", "left_semi"), customers.join(orders, "c_custkey", "left_anti")
    return old.withColumn("existing", F.lit(True)).unionByName(new.withColumn("existing", F.lit(False)))


@query("j05_last_sample", "WITH s AS (SELECT l_partkey, arg_max(l_quantity, (l_orderkey, l_linenumber)) AS q FROM lineitem GROUP BY 1) SELECT p_partkey, q FROM part JOIN s ON p_partkey = l_partkey")
def j05(spark: SparkSession, d: str) -> DataFrame:
    samples = ordered.latest(table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_partkey"], "l_orderkey", "l_linenumber")
    return table(spark, d, "part").join(samples, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", F.col("l_quantity").alias("q"))


def first_samples(rows: DataFrame) -> DataFrame:
    return rows.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))


@query("j06_first_sample_whole", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY 1")
def j06_whole(spark: SparkSession, d: str) -> DataFrame:
    return first_samples(table(spark, d, "lineitem"))


@query("j07_derived_key", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'task-' || o_orderkey || '_compile' ELSE 'task-' || o_orderkey END AS k FROM orders),
l AS (SELECT 'task-' || l_orderkey || '_compile' AS k, max(l_quantity) AS duration FROM lineitem GROUP BY 1) SELECT o_orderkey, duration FROM o LEFT JOIN l USING (k)""")
def j07(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("task-"), F.col("o_orderkey").cast("string"))
    orders = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(name, F.lit("_compile"))).otherwise(name).alias("k"))
    logs = table(spark, d, "lineitem").groupBy(F.concat(F.lit("task-"), F.col("l_orderkey").cast("string"), F.lit("_compile")).alias("k")).agg(F.max("l_quantity").alias("duration"))
    return orders.join(logs, "k", "left").select("o_orderkey", "duration")


@query("j08_agreement", """SELECT l_orderkey AS sample_idx, count(*) AS scenarios, count(DISTINCT (l_returnflag, l_linestatus)) = 1 AS consistent FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1 HAVING count(*) = 3""")
def j08(spark: SparkSession, d: str) -> DataFrame:
    """Samples in all three scenarios, and whether their rows agree: one aggregation, not a join of scenarios."""
    rows = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("sample_idx"))
    out = rows.agg(F.count(F.lit(1)).alias("scenarios"), F.count_distinct(F.struct("l_returnflag", "l_linestatus")).alias("n"))
    return out.where("scenarios = 3").select("sample_idx", "scenarios", (F.col("n") == 1).alias("consistent"))


@query("j09_baseline", """WITH s AS (SELECT o_orderpriority, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS base, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS tuned FROM orders GROUP BY 1)
SELECT o_orderpriority, round(base / tuned, 4) AS ratio, round(tuned - base, 3) AS delta FROM s WHERE base <> 0 AND tuned <> 0""")
def j09(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.sum("o_totalprice"))
    return wide.where("F <> 0 and O <> 0").select("o_orderpriority", F.round(F.col("F") / F.col("O"), 4).alias("ratio"), F.round(F.col("O") - F.col("F"), 3).alias("delta"))


@query("j10_fuzzy", """SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(p_type, ' ', 1) AS w FROM part) t WHERE contains(lower(p_name), lower(w)) OR contains(lower(w), lower(p_name)))""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Names that match one of the expected words, either way."""
    part = table(spark, d, "part")
    return joins.fuzzy_semi(part, "p_name", part.select(F.substring_index("p_type", " ", 1).alias("w")), "w").select("p_partkey")


@query("j11_clean_names", """WITH n AS (SELECT p_partkey, 'ns::' || replace(p_brand, '#', '_') || '<int>(float*)' AS name FROM part) SELECT p_partkey, replace(split_part(split_part(name, '(', 1), '<', 1), 'ns::', '') AS bare FROM n WHERE contains(name, 'Brand_1')""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("ns::"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit("<int>(float*)"))
    out = table(spark, d, "part").select("p_partkey", text.bare_kernel_name(name).alias("bare"))
    return out.where(F.contains("bare", F.lit("Brand_1")))


SPANS_SQL = """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events), i AS (SELECT event_id AS iter, user_id, s AS start_s, s + 3600 AS end_s FROM e WHERE event_type = 'purchase'),
k AS (SELECT event_id AS kernel, user_id, s AS k_start, s + 600 AS k_end FROM e WHERE event_type = 'click') """


def spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Purchases read as iterations of an hour, clicks as kernels of ten minutes."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    iterations = e.where("event_type = 'purchase'").select(F.col("event_id").alias("iter"), "user_id", F.col("s").alias("start_s"), (F.col("s") + 3600).alias("end_s"))
    kernels = e.where("event_type = 'click'").select(F.col("event_id").alias("kernel"), "user_id", F.col("s").alias("k_start"), (F.col("s") + 600).alias("k_end"))
    return iterations, kernels


@query("j12_interval_overlap", SPANS_SQL + "SELECT iter, count(*) AS n, max(k_end) - min(k_start) AS span FROM i JOIN k ON i.user_id = k.user_id AND NOT (k_end < start_s OR k_start > end_s) GROUP BY 1")
def j12(spark: SparkSession, d: str) -> DataFrame:
    iterations, kernels = spans(spark, d)
    both = joins.interval_join(iterations, kernels, ["user_id"], ("start_s", "end_s"), ("k_start", "k_end"))
    return both.groupBy("iter").agg(F.count(F.lit(1)).alias("n"), (F.max("k_end") - F.min("k_start")).alias("span"))


@query("j13_containment", SPANS_SQL + ", c AS (SELECT DISTINCT iter, kernel FROM i JOIN k ON i.user_id = k.user_id AND k_start BETWEEN start_s AND end_s) SELECT iter, count(*) AS n_kernels, min(props) AS least_props FROM c JOIN events ON event_id = kernel GROUP BY 1")
def j13(spark: SparkSession, d: str) -> DataFrame:
    iterations, kernels = spans(spark, d)
    launches = kernels.withColumn("k_end", F.col("k_start"))
    inside = joins.interval_join(iterations, launches, ["user_id"], ("start_s", "end_s"), ("k_start", "k_end")).select("iter", "kernel").distinct()
    props = table(spark, d, "events").select(F.col("event_id").alias("kernel"), "props")
    return inside.join(props, "kernel").groupBy("iter").agg(F.count(F.lit(1)).alias("n_kernels"), F.min("props").alias("least_props"))


@query("j14_positional", """WITH a AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS position FROM nation), b AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS position FROM nation WHERE n_nationkey <> 7)
SELECT position, a.n_nationkey IS NOT NULL AS in_left, b.n_nationkey IS NOT NULL AS in_right, a.n_name IS NOT DISTINCT FROM b.n_name AS n_name_equal FROM a FULL JOIN b USING (position)""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    return joins.positional_compare(nation, nation.where("n_nationkey <> 7"), "n_nationkey", ["n_name"])


@query("j15_missing_workers", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 AND s_nationkey IS NOT NULL)")
def j15(spark: SparkSession, d: str) -> DataFrame:
    there = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey").join(there, "n_nationkey", "left_anti")


@query("j16_prefix_priority", "SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END)) AS found FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def j16(spark: SparkSession, d: str) -> DataFrame:
    """The primary namespace answers if it has the key, else the legacy one."""
    orders = table(spark, d, "orders")
    part = lambda s, rank: orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.max("o_orderkey").alias("found")).withColumn("rank", F.lit(rank))
    return part("F", 1).unionByName(part("O", 0)).groupBy("o_custkey").agg(F.max_by("found", "rank").alias("found"))


@query("j17_same_device", "SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal > 0 AND b.s_acctbal > 0 AND a.s_suppkey <> b.s_suppkey")
def j17(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").where("s_acctbal > 0").select("s_nationkey", "s_suppkey")
    return s.select("s_nationkey", F.col("s_suppkey").alias("one")).join(s.select("s_nationkey", F.col("s_suppkey").alias("two")), "s_nationkey").where("one <> two").select("one", "two")


@query("j18_cache_probe", """SELECT p_partkey, CASE WHEN i.l_partkey IS NOT NULL AND f.o_orderkey IS NOT NULL THEN 'hit' WHEN f.o_orderkey IS NOT NULL THEN 'fs_hit' WHEN i.l_partkey IS NOT NULL THEN 'stale_missing_file' ELSE 'miss_pending' END AS outcome FROM part
LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) i ON p_partkey = l_partkey LEFT JOIN (SELECT o_orderkey FROM orders) f ON p_partkey = o_orderkey""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("indexed", F.lit(True))
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("p_partkey")).withColumn("on_disk", F.lit(True))
    out = table(spark, d, "part").select("p_partkey").join(index, "p_partkey", "left").join(files, "p_partkey", "left")
    outcome = F.when(F.col("indexed") & F.col("on_disk"), "hit").when(F.col("on_disk"), "fs_hit").when(F.col("indexed"), "stale_missing_file").otherwise("miss_pending")
    return out.select("p_partkey", outcome.alias("outcome"))


@query("j19_children", """WITH c AS (SELECT 't' || l_orderkey || CASE l_linenumber % 3 WHEN 0 THEN '_ref' WHEN 1 THEN '_kernel' ELSE '_compile' END AS id, l_quantity FROM lineitem) SELECT regexp_replace(id, '_(compile|kernel|ref)$', '') AS task, count(*) AS n_children, sum(l_quantity) AS total FROM c GROUP BY 1""")
def j19(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.when(F.col("l_linenumber") % 3 == 0, "_ref").when(F.col("l_linenumber") % 3 == 1, "_kernel").otherwise("_compile")
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string"), suffix).alias("id"), "l_quantity")
    return rows.groupBy(text.base_task(F.col("id")).alias("task")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("l_quantity").alias("total"))


@query("j20_include_lookup", """WITH u AS (SELECT p_brand AS base, min(p_partkey) AS k FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1), q AS (SELECT p_partkey, p_brand, p_partkey % 2 = 0 AS exact FROM part)
SELECT p_partkey, CASE WHEN exact THEN p_partkey ELSE coalesce(k, -1) END AS target FROM q LEFT JOIN u ON base = p_brand""")
def j20(spark: SparkSession, d: str) -> DataFrame:
    """An exact match, else one by a key that is unambiguous, else none."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    exact = part.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_partkey").alias("by_path"))
    by_base = joins.unambiguous(part.withColumnRenamed("p_partkey", "by_base"), "p_brand", "by_base")
    out = part.join(exact, "p_partkey", "left").join(by_base, "p_brand", "left")
    return out.select("p_partkey", F.coalesce("by_path", "by_base", F.lit(-1)).alias("target"))


@query("f22_allclose", """WITH f AS (SELECT label, arg_min(embedding, vec_id) AS x FROM embeddings GROUP BY 1) SELECT vec_id, len(embedding) = len(x) AND list_bool_and(list_transform(range(1, len(x) + 1),
lambda i: abs(x[i]::DOUBLE - embedding[i]::DOUBLE) <= 0.3 + 0.01 * abs(embedding[i]::DOUBLE))) AS close FROM embeddings JOIN f USING (label)""")
def f22(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the first of its label, as outputs against a reference."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("x"))
    return e.join(first, "label").select("vec_id", stats.all_close(F.col("x"), F.col("embedding"), 0.01, 0.3).alias("close"))
