"""Aggregation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import code, stats, text
from scoreloom.operators import documents, ordered
from scoreloom.plans.registry import query
from scoreloom.session import table


def r(c, d: int = 4):
    return F.round(c, d)


@query("a01_timing_stats", """SELECT l_suppkey, CAST(printf('%.2e', avg(l_extendedprice)) AS DOUBLE) AS mean, CAST(printf('%.2e', stddev_pop(l_extendedprice)) AS DOUBLE) AS std, CAST(printf('%.2e', min(l_extendedprice)) AS DOUBLE) AS min,
CAST(printf('%.2e', max(l_extendedprice)) AS DOUBLE) AS max, count(l_extendedprice) AS n FROM lineitem GROUP BY l_suppkey""")
def a01(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of times at three significant digits, and their number."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(*stats.timing_stats(F.col("l_extendedprice"), 3))


@query("a02_metric_summary", """SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, min(l_extendedprice) AS min, round(avg(l_extendedprice), 3) AS avg,
round(median(l_extendedprice), 3) AS p50, list_sort(list(l_extendedprice))[1 + CAST(round_even((count(*) - 1) * 0.95::DOUBLE, 0) AS INT)] AS p95, max(l_extendedprice) AS max FROM lineitem GROUP BY 1, 2""")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return ordered.metric_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("a03_percentiles", """SELECT o_orderpriority, list_sort(list(o_totalprice))[1 + CAST(round_even((count(*) - 1) * 0.95::DOUBLE, 0) AS INT)] AS p95_nearest,
list_sort(list(o_totalprice))[1 + least(count(*) - 1, CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT))] AS p90_truncated,
list_sort(list(o_totalprice))[1 + CAST(round_even((count(*) - 1) * 0.5::DOUBLE, 0) AS INT)] AS p50_nearest, round(median(o_totalprice), 4) AS p50_median FROM orders GROUP BY 1""")
def a03(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"p95_nearest": lambda n: stats.nearest_index(n, 0.95), "p90_truncated": lambda n: stats.truncated_index(n, 0.9), "p50_nearest": lambda n: stats.nearest_index(n, 0.5)}
    out = ordered.summaries(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", [F.count(F.lit(1)).alias("n")], wanted, "p50_median")
    return out.drop("n").withColumn("p50_median", r(F.col("p50_median")))


@query("a06_key_counts", "SELECT CASE WHEN value IS NULL THEN 'None' WHEN value > 50 THEN 'True' ELSE 'False' END AS over_50, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def a06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(text.text_of_flag(F.col("value") > 50).alias("over_50"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a07_composite_counts", "SELECT o_orderstatus, o_orderpriority, o_totalprice > 150000 AS large, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority", (F.col("o_totalprice") > 150000).alias("large")).agg(F.count(F.lit(1)).alias("n"))


@query("a08_nested_counts", "SELECT l_returnflag AS object, l_linestatus AS cache_status, count(*) AS n, count(DISTINCT l_orderkey) AS n_groups FROM lineitem GROUP BY 1, 2")
def a08(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("object"), F.col("l_linestatus").alias("cache_status"))).alias("objects"))
    return nested.select("l_orderkey", F.inline("objects")).groupBy("object", "cache_status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_groups"))


@query("a09_consistency", """SELECT lang, count(*) AS n, round(sum(CASE WHEN coalesce(quality = 1, false) = coalesce(toxic = 0, false) THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS rate,
round(sum(CASE WHEN quality IS NOT NULL AND (quality = 1) = coalesce(toxic = 0, false) THEN 1 ELSE 0 END) / CAST(nullif(count(quality), 0) AS DOUBLE), 4) AS rate_labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def a09(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    same = F.coalesce(F.col("quality") == 1, F.lit(False)) == F.coalesce(F.col("toxic") == 0, F.lit(False))
    return both.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), r(stats.safe_ratio(F.count_if(same), F.count(F.lit(1)))).alias("rate"), r(stats.safe_ratio(F.count_if(same & F.col("quality").isNotNull()), F.count("quality"))).alias("rate_labelled")
    )


@query("a10_column_summaries", """WITH u AS (SELECT 'quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem)
SELECT metric, count(v) AS n, min(v) AS min, round(avg(v), 3) AS avg, round(median(v), 3) AS p50, list_sort(list(v))[1 + CAST(round_even((count(*) - 1) * 0.95::DOUBLE, 0) AS INT)] AS p95, max(v) AS max FROM u GROUP BY metric""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return ordered.metric_summary(rows.unpivot([], ["quantity", "discount", "tax"], "metric", "v"), ["metric"], "v")


KERNEL_SQL = """WITH k AS (SELECT l_orderkey AS task, CASE l_linenumber % 4 WHEN 0 THEN 'aten::mm' WHEN 1 THEN 'ns::my_kernel<int>(float*)' WHEN 2 THEN 'aten::empty' ELSE 'void at::native::x' END AS name,
CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE l_extendedprice END AS cuda, l_quantity AS cpu FROM lineitem) """


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders read as kernels of tasks."""
    kind = F.col("l_linenumber") % 4
    name = F.when(kind == 0, "aten::mm").when(kind == 1, "ns::my_kernel<int>(float*)").when(kind == 2, "aten::empty").otherwise("void at::native::x")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), name.alias("name"), F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_extendedprice")).alias("cuda"), F.col("l_quantity").alias("cpu"))


@query("a11_profile_rollup", KERNEL_SQL + "SELECT task, round(sum(cuda), 3) AS cuda, round(sum(cpu), 3) AS cpu, count(*) AS n_events, sum(CASE WHEN cuda > 0 THEN 1 ELSE 0 END)::BIGINT AS n_kernels FROM k GROUP BY task HAVING sum(cuda) > 0")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return profile(spark, d).groupBy("task").agg(r(F.sum("cuda"), 3).alias("cuda"), r(F.sum("cpu"), 3).alias("cpu"), F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("cuda") > 0).alias("n_kernels")).where("cuda > 0")


@query("a12_coverage", KERNEL_SQL + """SELECT task, sum(CASE WHEN name LIKE 'ns::%' THEN 1 ELSE 0 END)::BIGINT AS n_custom, round(sum(cuda + cpu), 3) AS total_time, round(sum(CASE WHEN name LIKE 'ns::%' THEN cuda ELSE 0 END), 3) AS custom_time,
max(CASE WHEN name = 'aten::mm' THEN cuda ELSE 0 END) AS aten_time, max(cuda) AS max_time, max(cuda) > 0 AND max(CASE WHEN name = 'aten::mm' THEN cuda ELSE 0 END) / nullif(max(cuda), 0) > 0.5 AND sum(CASE WHEN name LIKE 'ns::%' THEN 1 ELSE 0 END) = 0 AS decoy FROM k GROUP BY task""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    custom = ~text.is_framework_kernel(F.col("name"))
    aten = F.coalesce(F.max(F.when(text.is_telling_aten(F.col("name")), F.col("cuda"))), F.lit(0.0))
    decoy = (F.max("cuda") > 0) & F.coalesce(F.try_divide(aten, F.max("cuda")) > 0.5, F.lit(False)) & (F.count_if(custom) == 0)
    return profile(spark, d).groupBy("task").agg(
        F.count_if(custom).alias("n_custom"), r(F.sum(F.col("cuda") + F.col("cpu")), 3).alias("total_time"), r(F.sum(F.when(custom, F.col("cuda")).otherwise(0.0)), 3).alias("custom_time"),
        aten.alias("aten_time"), F.max("cuda").alias("max_time"), decoy.alias("decoy"),
    )


@query("a13_coverage_text", "SELECT o_orderpriority, printf('%.2f%%', 100.0 * CASE WHEN count(*) > 0 THEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE / count(*) ELSE 0 END) AS coverage FROM orders GROUP BY 1")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(stats.percent(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("coverage"))


@query("a14_wall_and_stages", """SELECT l_orderkey, date_diff('day', min(l_shipdate), max(l_shipdate)) AS wall_days, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 3) AS a_sum, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0), 3) AS n_sum,
round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 3) AS r_sum FROM lineitem GROUP BY 1""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    part = lambda f: r(F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))), F.lit(0.0)), 3)
    wall = F.date_diff(F.max("l_shipdate").cast("date"), F.min("l_shipdate").cast("date")).cast("long")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(wall.alias("wall_days"), part("A").alias("a_sum"), part("N").alias("n_sum"), part("R").alias("r_sum"))


@query("a15_pooling", """SELECT l_partkey, CASE WHEN bool_and(l_quantity > 1) THEN round(avg(l_extendedprice), 3) END AS mean, CASE WHEN bool_and(l_quantity > 1) THEN round(var_pop(l_extendedprice), 1) END AS var, bool_and(l_quantity > 1) AS ok,
sum(CASE WHEN l_quantity > 1 THEN 0 ELSE 1 END)::BIGINT AS n_errors FROM lineitem GROUP BY 1""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    ok = F.every(F.col("l_quantity") > 1)
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.when(ok, r(F.avg("l_extendedprice"), 3)).alias("mean"), F.when(ok, r(F.var_pop("l_extendedprice"), 1)).alias("var"), ok.alias("ok"), F.count_if(~(F.col("l_quantity") > 1)).alias("n_errors")
    )


@query("a16_pairwise_deltas", """WITH p AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS o, avg(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT o_orderpriority, round(f - o, 3) AS f_o, round(f - p, 3) AS f_p, round(o - p, 3) AS o_p FROM p""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return wide.select("o_orderpriority", r(F.col("F") - F.col("O"), 3).alias("f_o"), r(F.col("F") - F.col("P"), 3).alias("f_p"), r(F.col("O") - F.col("P"), 3).alias("o_p"))


@query("a17_queue_depth", "SELECT o_orderpriority, o_orderstatus, count(*) AS depth FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), (o_orderstatus), ())")
def a17(spark: SparkSession, d: str) -> DataFrame:
    """Depth by queue, by each of its parts, and in all: grouping sets in one pass, an extension."""
    both = [F.col("o_orderpriority"), F.col("o_orderstatus")]
    return table(spark, d, "orders").groupingSets([both, both[:1], both[1:], []], *both).agg(F.count(F.lit(1)).alias("depth"))


@query("a18_batch_totals", "SELECT user_id, count(*) AS total, count(*) - sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS completed, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0 AS all_passed FROM events GROUP BY 1")
def a18(spark: SparkSession, d: str) -> DataFrame:
    bad = F.count_if(F.col("event_type") == "error")
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - bad).alias("completed"), bad.alias("failed"), F.every(F.col("event_type") != "error").alias("all_passed"))


@query("a19_running_stats", """SELECT user_id, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS completed, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failed, round(sum(value), 3) AS total_time,
round(sum(value) / nullif(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 0), 3) AS average, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.col("event_type") != "error")
    return table(spark, d, "events").groupBy("user_id").agg(
        done.alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed"), r(F.sum("value"), 3).alias("total_time"), r(stats.safe_ratio(F.sum("value"), done), 3).alias("average"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type")
    )


@query("a20_problematic", "SELECT user_id, count(*) AS error_count FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("error_count")).where("error_count >= 3").orderBy(F.desc("error_count"), "user_id")


@query("a21_min_per_key", "SELECT l_partkey, min(l_extendedprice) AS least FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 10 GROUP BY 1 ORDER BY 1 LIMIT 50")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'N' and l_quantity > 10").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("least")).orderBy("l_partkey").limit(50)


@query("a22_stage_costs", """WITH m AS (SELECT o_orderstatus, o_orderpriority, median(o_totalprice) AS md, avg(o_totalprice) AS mn FROM orders GROUP BY 1, 2), p AS (SELECT o_orderpriority, max(CASE WHEN o_orderstatus = 'F' THEN md END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN md END) AS o,
max(CASE WHEN o_orderstatus = 'F' THEN mn END) AS fm, max(CASE WHEN o_orderstatus = 'O' THEN mn END) AS om FROM m GROUP BY 1) SELECT o_orderpriority AS stage, round(f - o, 3) AS median_delta, round(fm - om, 3) AS mean_delta FROM p ORDER BY 2 DESC, 1""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderstatus IN ('F', 'O')").select(F.col("o_orderpriority").alias("stage"), "o_orderstatus", "o_totalprice")
    modes = ordered.summaries(rows, ["stage", "o_orderstatus"], "o_totalprice", [F.avg("o_totalprice").alias("mn")], {}, "md")
    wide = modes.groupBy("stage").pivot("o_orderstatus", ["F", "O"]).agg(F.max("md").alias("md"), F.max("mn").alias("mn"))
    return wide.select("stage", r(F.col("F_md") - F.col("O_md"), 3).alias("median_delta"), r(F.col("F_mn") - F.col("O_mn"), 3).alias("mean_delta")).orderBy(F.desc("median_delta"), "stage")


@query("a23_resources", "SELECT l_returnflag AS device, min(l_quantity) AS min, round(avg(l_quantity), 4) AS avg, max(l_quantity) AS max FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def a23(spark: SparkSession, d: str) -> DataFrame:
    """By device and overall in one rollup."""
    return table(spark, d, "lineitem").rollup(F.col("l_returnflag").alias("device")).agg(F.min("l_quantity").alias("min"), r(F.avg("l_quantity")).alias("avg"), F.max("l_quantity").alias("max"))


@query("a24_health", """WITH t AS (SELECT date_trunc('hour', ts) AS tick, avg(value) AS mean, max(value) AS peak FROM events GROUP BY 1) SELECT count(*) AS ticks, round(min(mean), 3) AS min_mean, round(avg(mean), 3) AS avg_mean,
round(list_sort(list(mean))[1 + CAST(round_even((count(*) - 1) * 0.5::DOUBLE, 0) AS INT)], 3) AS p50_mean, round(list_sort(list(mean))[1 + CAST(round_even((count(*) - 1) * 0.95::DOUBLE, 0) AS INT)], 3) AS p95_mean, max(peak) AS max_peak FROM t""")
def a24(spark: SparkSession, d: str) -> DataFrame:
    ticks = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("tick")).agg(F.avg("value").alias("mean"), F.max("value").alias("peak"))
    m = F.col("mean")
    plain = [F.count(F.lit(1)).alias("ticks"), r(F.min(m), 3).alias("min_mean"), r(F.avg(m), 3).alias("avg_mean"), F.max("peak").alias("max_peak")]
    out = ordered.summaries(ticks, [], "mean", plain, {"p50_mean": lambda n: stats.nearest_index(n, 0.5), "p95_mean": lambda n: stats.nearest_index(n, 0.95)})
    return out.withColumns({"p50_mean": r(F.col("p50_mean"), 3), "p95_mean": r(F.col("p95_mean"), 3)})


@query("a25_percent_text", "SELECT l_returnflag, round(avg(TRY_CAST(rtrim(CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) || '%' END, '%') AS DOUBLE)), 4) AS avg_percent FROM lineitem GROUP BY 1")
def a25(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%")))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.avg(text.number(shown))).alias("avg_percent"))


@query("a26_correctness", """SELECT l_orderkey, bool_and(abs(l_discount - l_tax) <= 0.05) AS correct, sum(CASE WHEN abs(l_discount - l_tax) <= 0.05 THEN 1 ELSE 0 END)::BIGINT AS passed, round(max(abs(l_discount - l_tax)), 6) AS max_diff, round(avg(abs(l_discount - l_tax)), 6) AS mean_diff FROM lineitem GROUP BY 1""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    diff = F.abs(F.col("l_discount") - F.col("l_tax"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.every(diff <= 0.05).alias("correct"), F.count_if(diff <= 0.05).alias("passed"), r(F.max(diff), 6).alias("max_diff"), r(F.avg(diff), 6).alias("mean_diff"))


@query("a27_weighted_mean", "SELECT l_partkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 3) AS weighted FROM lineitem GROUP BY 1")
def a27(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(r(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 3).alias("weighted"))


@query("a28_bytes", "SELECT lang, sum(strlen(text))::BIGINT AS n_bytes, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.char_length("text")).alias("n_chars"))


@query("a28_nested_bytes", "SELECT event_id, k + 1 AS n_tensors, 2 * k + 1 AS depth, 8 * k + 8 * user_id AS n_bytes FROM (SELECT event_id, user_id, event_id % 8 AS k FROM events)")
def a28_nested(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of all tensors in a structure of objects and arrays, up to 15 deep."""
    k = (F.col("event_id") % 8).cast("int")
    inner = F.concat(F.lit('{"numel":'), F.col("user_id").cast("string"), F.lit(',"size":8}'))
    document = F.concat(F.repeat(F.lit('{"t":{"numel":2,"size":4},"inner":['), k), inner, F.repeat(F.lit("]}"), k))
    found = documents.leaves(table(spark, d, "events").select("event_id", document.alias("document")), ["event_id"], "document")
    value = lambda name: F.max(F.when(F.endswith("path", F.lit(f".{name}")), F.col("value").cast("long")))
    tensors = found.groupBy("event_id", F.regexp_replace("path", r"\.(numel|size)$", "").alias("tensor")).agg((value("numel") * value("size")).alias("n"), F.max("depth").alias("depth"))
    return tensors.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_tensors"), F.max("depth").cast("long").alias("depth"), F.sum("n").alias("n_bytes"))


@query("p17_leaves", """SELECT event_id, '$.a[0].k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, '$.a[1].list[' || i || ']', '' || (event_id + i) FROM events, (SELECT unnest(range(0, 3)) AS i) WHERE i < event_id % 4
UNION ALL SELECT event_id, '$.a[1].list', '[]' FROM events WHERE event_id % 4 = 0""")
def p17_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of documents, without artifact keys at any depth."""
    items = F.transform(F.slice(F.array(*map(F.lit, range(3))), F.lit(1), (F.col("event_id") % 4).cast("int")), lambda i: (F.col("event_id") + i).cast("string"))
    document = F.concat(F.lit('{"session": {"x": 1}, "a": [{"code": {"z": [2]}, "k": '), F.get_json_object("props", "$.k"), F.lit('}, {"list": ['), F.array_join(items, ","), F.lit("]}]}"))
    found = documents.leaves(table(spark, d, "events").select("event_id", document.alias("document")), ["event_id"], "document")
    return documents.without(found, code.ARTIFACT_KEYS).select("event_id", "path", "value")


@query("a29_distinct_lists", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY 1")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("a30_pool", "SELECT sum(CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END)::BIGINT AS alive, sum(CASE WHEN c_acctbal BETWEEN 0 AND 1000 THEN 1 ELSE 0 END)::BIGINT AS idle, sum(CASE WHEN c_acctbal > 1000 THEN 1 ELSE 0 END)::BIGINT AS busy, count(*) AS total FROM customer")
def a30(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(spark, d, "customer").agg(F.count_if(b >= 0).alias("alive"), F.count_if(b.between(0, 1000)).alias("idle"), F.count_if(b > 1000).alias("busy"), F.count(F.lit(1)).alias("total"))


@query("a31_stress", """SELECT event_type, count(*) AS n, min(value) AS min, list_sort(list(value))[1 + CAST(round_even((count(*) - 1) * 0.5::DOUBLE, 0) AS INT)] AS p50, list_sort(list(value))[1 + CAST(round_even((count(*) - 1) * 0.95::DOUBLE, 0) AS INT)] AS p95, max(value) AS max FROM events GROUP BY 1""")
def a31(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    plain = [F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max")]
    return ordered.summaries(table(spark, d, "events"), ["event_type"], "value", plain, {"p50": lambda n: stats.nearest_index(n, 0.5), "p95": lambda n: stats.nearest_index(n, 0.95)})


@query("a32_sizes", "SELECT lang, source, sum(n_chars)::BIGINT AS size FROM documents GROUP BY ROLLUP (lang, source)")
def a32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("lang", "source").agg(F.sum("n_chars").alias("size"))


@query("a34_products", "SELECT p_brand, sum(CAST(p_size AS BIGINT) * length(p_type))::BIGINT AS total FROM part GROUP BY 1")
def a34(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.sum(F.col("p_size").cast("long") * F.char_length("p_type")).alias("total"))
