"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import code, rules, stats, text
from scoreloom.plans.registry import query
from scoreloom.session import table


@query("p01_known_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")


@query("p03_first_not_null", "SELECT doc_id, coalesce(quality, toxic, -1) AS flag, coalesce(nullif(lang, ''), 'Model') AS name FROM documents LEFT JOIN labels USING (doc_id)")
def p03(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return both.select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).alias("flag"), F.coalesce(F.nullif("lang", F.lit("")), F.lit("Model")).alias("name"))


@query("p04_fallback_text", "SELECT doc_id, md5(CASE WHEN source IN ('src1', 'src2') THEN text ELSE source END) AS chosen FROM documents")
def p04(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("source") == "src2", "   ").when(F.col("source") != "src1", F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.first_text(first, F.col("text"))).alias("chosen"))


@query("p06_split_by_flag", "SELECT doc_id, toxic = 1 AS flag FROM labels WHERE toxic IS NOT NULL AND doc_id IS NOT NULL")
def p06(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").where("toxic is not null and doc_id is not null")
    yes, no = known.where("toxic = 1"), known.where("toxic <> 1")
    return yes.select("doc_id", F.lit(True).alias("flag")).unionByName(no.select("doc_id", F.lit(False).alias("flag")))


@query("p08_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%'")
def p08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_type").startswith("PROMO")).select("p_partkey", "p_type")


@query("p09_infra_errors", "SELECT event_id, event_type IN ('error', 'signup') OR contains(props, '7') AS infra FROM events")
def p09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.col("event_type").isin("error", "signup") | F.contains("props", F.lit("7"))).alias("infra"))


@query("p11_validators", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice NOT BETWEEN 1000 AND 300000 THEN 'price' END, CASE WHEN length(o_orderpriority) NOT BETWEEN 1 AND 8 THEN 'priority' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders""")
def p11(spark: SparkSession, d: str) -> DataFrame:
    checks = {"price": ~F.col("o_totalprice").between(1000, 300000), "priority": ~F.length("o_orderpriority").between(1, 8), "status": F.col("o_orderstatus") == "P"}
    return table(spark, d, "orders").select("o_orderkey", F.array_join(rules.failed(checks), ",").alias("errors"))


@query("p13_framework_names", "SELECT p_partkey, starts_with(trim(p_type), 'ECONOMY') AS economy, NOT (starts_with(trim(p_type), 'ECONOMY')) AND NOT regexp_matches(p_type, 'TIN|BRASS') AS telling FROM part")
def p13(spark: SparkSession, d: str) -> DataFrame:
    economy = F.trim("p_type").startswith("ECONOMY")
    return table(spark, d, "part").select("p_partkey", economy.alias("economy"), (~economy & ~text.contains_any(F.col("p_type"), ("TIN", "BRASS"))).alias("telling"))


@query("p15_routing", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'cpu' WHEN o_orderstatus = 'O' THEN 'gpu' WHEN o_orderkey % 2 = 0 THEN 'cpu' WHEN lower(trim(o_orderpriority)) = '1-urgent' THEN 'cpu' ELSE 'gpu' END AS resource FROM orders""")
def p15(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.when(F.col("o_orderstatus") == "F", "compile").when(F.col("o_orderstatus") == "O", "cuda")
    stage = F.when(F.lower(F.trim("o_orderpriority")) == "1-urgent", "compilation")
    return table(spark, d, "orders").select("o_orderkey", rules.resource(wanted, F.col("o_orderkey") % 2 == 0, stage, F.lit(None).cast("string")).alias("resource"))


@query("p19_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'COMPILATION_ERROR' WHEN o_totalprice < 100000 THEN 'CORRECTNESS_ERROR' END AS error_code FROM orders")
def p19(spark: SparkSession, d: str) -> DataFrame:
    compiled, correct = F.col("o_orderstatus") != "P", F.col("o_totalprice") >= 100000
    out = rules.kernel_error(compiled, correct, F.lit(None).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.when(compiled, "completed").otherwise("failed").alias("status"), out["code"].alias("error_code"))


@query("p24_decoy", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 OR l_discount > 0.08 THEN false ELSE true END AS decoy FROM lineitem")
def p24(spark: SparkSession, d: str) -> DataFrame:
    used = F.col("l_discount") > 0.08
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.cuda_decoy(F.when(F.col("l_quantity") > 40, 1).otherwise(0), used, F.lit(False)).alias("decoy"))


@query("p25_cases", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber > 2 THEN l_returnflag END, 'case_' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)) AS name FROM lineitem")
def p25(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("given")))).alias("cases"))
    return cases.select("l_orderkey", F.inline(F.transform("cases", lambda c, i: F.struct(c["l_linenumber"].alias("l_linenumber"), F.coalesce(c["given"], F.concat(F.lit("case_"), i.cast("string"))).alias("name")))))


@query("p26_containment", "SELECT conv_id, turn FROM conversations WHERE NOT contains(text, 'ent')")
def p26(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return rows.where(~F.contains("text", F.lit("ent"))).select("conv_id", "turn")


ERROR_CASE = " ".join(f"WHEN regexp_matches(m, '{'|'.join(p)}') THEN '{c}'" for c, p in text.ERROR_PATTERNS.items())
CATEGORY_CASE = " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in text.CATEGORIES.items())


@query("f01_error_classes", f"WITH d AS (SELECT doc_id, lower(text || CASE doc_id % 9 WHEN 0 THEN ' nvcc fatal error' WHEN 1 THEN ' CUDA compilation timeout' WHEN 2 THEN ' Task timed out' WHEN 3 THEN ' queue is full' WHEN 4 THEN ' out of memory' ELSE '' END) AS m FROM documents), c AS (SELECT doc_id, CASE {ERROR_CASE} ELSE 'UNKNOWN_ERROR' END AS code FROM d) SELECT doc_id, code, CASE code {CATEGORY_CASE} END AS category FROM c")
def f01(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 9 == 0, " nvcc fatal error").when(F.col("doc_id") % 9 == 1, " CUDA compilation timeout").when(F.col("doc_id") % 9 == 2, " Task timed out").when(F.col("doc_id") % 9 == 3, " queue is full").when(F.col("doc_id") % 9 == 4, " out of memory").otherwise("")
    code = text.classify_error(F.concat("text", tail))
    return table(spark, d, "documents").select("doc_id", code.alias("code")).select("doc_id", "code", text.error_category(F.col("code")).alias("category"))


MEMORY_OR = " OR ".join(f"contains(m, '{m}')" for m in text.MEMORY_MARKS)
LOCK_OR = " OR ".join(f"contains(m, '{m}')" for m in text.LOCK_MARKS)


@query("f03_error_marks", f"WITH d AS (SELECT doc_id, lower(CASE doc_id % 5 WHEN 0 THEN 'CUDA error at ' WHEN 1 THEN 'no such file or directory: a.lock ' WHEN 2 THEN 'FileBaton ' ELSE '' END || text) AS m FROM documents) SELECT doc_id, {MEMORY_OR} AS memory, ({LOCK_OR}) OR contains(m, 'no such file or directory') AND contains(m, '.lock') AS lock FROM d")
def f03(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 5 == 0, "CUDA error at ").when(F.col("doc_id") % 5 == 1, "no such file or directory: a.lock ").when(F.col("doc_id") % 5 == 2, "FileBaton ").otherwise("")
    m = F.concat(head, F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.is_memory_error(m).alias("memory"), text.is_lock_error(m).alias("lock"))


@query("f05_flags", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN true WHEN page_id % 3 = 1 THEN false END AS compiled, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages""")
def f05(spark: SparkSession, d: str) -> DataFrame:
    feedback = F.when(F.col("page_id") % 3 == 0, '{"Compiled" : TRUE}').when(F.col("page_id") % 3 == 1, '{"compiled":false}').otherwise("{}")
    title = F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", text.compiled_flag(feedback).alias("compiled"), title.alias("title"))


@query("f07_names", r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))), ',') AS tags FROM pages")
def f07(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"))
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("tags"))


@query("f13_file_kinds", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'cuda_object' WHEN 1 THEN 'object' WHEN 2 THEN 'library' ELSE 'other' END AS kind FROM part")
def f13(spark: SparkSession, d: str) -> DataFrame:
    """Files named after parts, some in a folder whose name ends like a file's."""
    ending = F.get(F.array(F.lit(".cuda.o"), F.lit(".o"), F.lit(".so"), F.lit(".txt")), (F.col("p_size") % 4).cast("int"))
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "build.so/").otherwise(""), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), ending)
    return table(spark, d, "part").select("p_partkey", text.file_kind(name).alias("kind"))


@query("f14_arch", "SELECT p_partkey, (p_size // 10 + 1) || '.' || (p_size % 10) || ';9.0' AS arch FROM part")
def f14(spark: SparkSession, d: str) -> DataFrame:
    digits = (F.col("p_size") + 10).cast("string")
    return table(spark, d, "part").select("p_partkey", text.arch_list(F.concat(F.lit("sm_"), digits, F.lit("+PTX, 9.0"))).alias("arch"))


@query("f16_retry_suffix", "SELECT o_orderkey, 't' || o_custkey || repeat('_retry1', greatest(0, CAST(o_orderkey % 4 AS INT) - 1)) AS original FROM orders")
def f16(spark: SparkSession, d: str) -> DataFrame:
    """Up to three suffixes, of which the last goes."""
    name = F.concat(F.lit("t"), F.col("o_custkey").cast("string"), F.repeat(F.lit("_retry1"), (F.col("o_orderkey") % 4).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", text.without_retry(name).alias("original"))


@query("f17_prefixes", "SELECT doc_id, left(text, 50) AS head, array_to_string(list_slice(string_split(text, chr(10)), 1, 2), '|') AS two_lines, replace(left(text, 20), 'e', '_') AS replaced FROM documents")
def f17(spark: SparkSession, d: str) -> DataFrame:
    lines = F.array_join(F.slice(F.split("text", "\n"), 1, 2), "|")
    return table(spark, d, "documents").select("doc_id", F.left("text", F.lit(50)).alias("head"), lines.alias("two_lines"), F.replace(F.left("text", F.lit(20)), F.lit("e"), F.lit("_")).alias("replaced"))


@query("f19_content_keys", "SELECT sha256(lang || chr(0) || text) AS key, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def f19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(text.content_key(F.col("lang"), F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("f20_times", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'bad' END AS TIMESTAMP) AS parsed, epoch_us(ts) AS us FROM events")
def f20(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("bad")
    return table(spark, d, "events").select("event_id", shown.try_cast("timestamp_ntz").alias("parsed"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("f24_units", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 1e6, 9) AS ms, round(CASE WHEN l_discount > 0 THEN l_quantity / l_discount END, 6) AS rate FROM lineitem")
def f24(spark: SparkSession, d: str) -> DataFrame:
    rate = stats.safe_ratio(F.col("l_quantity"), F.when(F.col("l_discount") > 0, F.col("l_discount")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 1e6, 9).alias("ms"), F.round(rate, 6).alias("rate"))


@query("f26_json", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.none'), 'missing') AS absent FROM events")
def f26(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "int"), F.lit(-1)).alias("k"), F.coalesce(F.try_variant_get(v, "$.none", "string"), F.lit("missing")).alias("absent"))


@query("f27_arrays", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS n_positive, list_bool_or(list_transform(embedding, lambda x: x > 0.3::FLOAT)) AS has_large FROM embeddings")
def f27(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.element_at(e, 1).cast("double"), 6).alias("first"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("n_positive"), F.exists(e, lambda x: x > F.lit(0.3).cast("float")).alias("has_large"))


@query("f30_timings", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE p_size / 1000.0 END AS ms FROM part")
def f30(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "ms").otherwise("us"))
    return table(spark, d, "part").select("p_partkey", text.milliseconds(shown).alias("ms"))


@query("f32_ids", "SELECT o_orderkey, printf('%s_%03d_%d', o_orderstatus, o_orderkey % 1000, o_custkey) AS id FROM orders")
def f32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.format_string("%s_%03d_%d", "o_orderstatus", F.col("o_orderkey") % 1000, "o_custkey").alias("id"))


@query("f34_lists", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ',' || (p_size + 1) WHEN 1 THEN p_size || ',7' WHEN 2 THEN '' || p_size ELSE '0' END AS gpus FROM part")
def f34(spark: SparkSession, d: str) -> DataFrame:
    """A JSON list, a list with commas, one number, and a text without any."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    given = F.when(k == 0, F.concat(F.lit("["), size, F.lit(", "), (F.col("p_size") + 1).cast("string"), F.lit("]"))).when(k == 1, F.concat(size, F.lit(", 7"))).when(k == 2, size).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(rules.int_list(given, [0]), ",").alias("gpus"))


@query("f10_kernel_checks", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'VALIDATION_ERROR' WHEN 1 THEN 'SYNTAX_ERROR' WHEN 2 THEN 'IMPORT_ERROR' END AS error FROM part")
def f10(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_partkey") % 5
    source = F.when(kind == 0, "x = 1").when(kind == 1, "class ModelNew:\n  def (").when(kind == 2, "class ModelNew:\n  pass").when(kind == 3, "import triton\nclass ModelNew:\n  pass").otherwise("class ModelNew:\n  x = 'torch.cuda'")
    return table(spark, d, "part").select("p_partkey", code.kernel_check(source, F.when(kind == 4, "cuda").otherwise("triton")).alias("error"))


@query("f12_open_calls", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 3 + p_size WHEN 1 THEN 1 + p_size END AS line FROM part")
def f12(spark: SparkSession, d: str) -> DataFrame:
    """Calls below some lines of comment: without a semicolon, never closed, closed on another line, and none."""
    kind = F.col("p_partkey") % 4
    source = F.when(kind == 0, "REG(a(b)) ;\n\nREG(c)\nx;").when(kind == 1, "REG(a(b;").when(kind == 2, "REG(a,\n (b)) \n;").otherwise("none")
    above = F.repeat(F.concat(F.lit("// "), F.col("p_name"), F.lit("\n")), F.col("p_size").cast("int"))
    return table(spark, d, "part").select("p_partkey", code.open_call(F.concat(above, source), "REG").alias("line"))


@query("p17_without_keys", """SELECT event_id, '{"a":[{"k":' || json_extract_string(props, '$.k') || '}]}' AS document FROM events""")
def p17(spark: SparkSession, d: str) -> DataFrame:
    nested = F.concat(F.lit('{"session": 1, "a": [{"code": {"z": 2}, "k": '), F.get_json_object("props", "$.k"), F.lit("}]}"))
    return table(spark, d, "events").select("event_id", code.without_keys(nested).alias("document"))
