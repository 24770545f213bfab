"""Nested records, submissions, names, full sorts and the rules over workers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.functions import code, records, rules, stats, text
from scoreloom.operators import joins, ordered
from scoreloom.plans.registry import query
from scoreloom.session import table
from scoreloom.sources import files


@query(
    "p02_flat_response",
    """WITH o AS (SELECT *, o_orderkey % 2 = 0 AS even, o_orderkey % 3 = 0 AS third, o_orderkey % 4 = 0 AS fourth, o_orderkey % 5 = 0 AS bad, o_orderkey % 7 = 0 AS down FROM orders)
    SELECT o_orderkey AS task_id, 'plain' AS scenario, even AS split_requested, o_orderkey % 10 AS sample_idx, o_custkey AS source_row, third AS feedback_compiled, round(o_totalprice / 7, 3) AS elapsed_sec,
    CASE WHEN bad THEN 'http_error' ELSE 'completed' END AS status, CASE WHEN NOT bad THEN o_orderstatus = 'F' END AS compiled, CASE WHEN NOT bad THEN o_orderstatus <> 'P' END AS correctness, CASE WHEN down THEN 'E7' END AS error_code,
    CASE WHEN down THEN 'Worker shutdown: ' || o_orderkey END AS error_message, bad OR down AS infra_error, even AS metadata_split_compile_and_execute, fourth AS metadata_precompiled_artifact_used, CASE WHEN third THEN true END AS metadata_inline_gpu_execute_completed,
    fourth AS metadata_compile_artifact_cache_hit, true AS metadata_compile_artifact_cache_enabled, third AS metadata_compile_only, CASE WHEN even THEN 'compile' END AS metadata_task_stage, CASE WHEN fourth THEN 'ninja' ELSE 'direct' END AS build_backend,
    '{"build_backend":"direct","total_sec":' || CAST(CAST(o_custkey AS DOUBLE) AS VARCHAR) || '}' AS compile_timing, CASE WHEN even THEN 'w1' ELSE 'inline' END AS worker_id, CASE WHEN third THEN 'cuda:1' ELSE 'cpu' END AS worker_device,
    '{"status":"' || CASE WHEN bad THEN 'http_error' ELSE 'completed","compiled":' || (o_orderstatus = 'F') || ',"correctness":' || (o_orderstatus <> 'P') END || CASE WHEN bad THEN '"' ELSE '' END || CASE WHEN down THEN ',"error_code":"E7","error_message":"Worker shutdown: ' || o_orderkey || '"' ELSE '' END
    || ',"metadata":{"split_compile_and_execute":' || even || ',"precompiled_artifact_used":' || fourth || CASE WHEN third THEN ',"inline_gpu_execute_completed":true' ELSE '' END || ',"compile_artifact_cache_hit":' || fourth || ',"compile_artifact_cache_enabled":true,"compile_only":' || third
    || CASE WHEN even THEN ',"task_stage":"compile"' ELSE '' END || ',"compile_artifact":{"build_backend":"' || CASE WHEN fourth THEN 'ninja' ELSE '' END || '","compile_timing":{"build_backend":"direct","total_sec":' || CAST(CAST(o_custkey AS DOUBLE) AS VARCHAR) || '}}'
    || CASE WHEN even THEN ',"worker_id":"w1"' ELSE '' END || ',"inline_compile_worker_id":"inline"' || CASE WHEN third THEN ',"worker_device":"cuda:1"' ELSE '' END || ',"inline_compile_worker_device":"cpu"},"unknown":"x"}' AS raw_result FROM o""",
)
def p02(spark: SparkSession, d: str) -> DataFrame:
    """All 25 columns of a response as a flat row."""
    k = F.col("o_orderkey")
    even, third, fourth, bad, down = (k % n == 0 for n in (2, 3, 4, 5, 7))
    timing = F.struct(F.lit("direct").alias("build_backend"), F.col("o_custkey").cast("double").alias("total_sec"))
    artifact = F.struct(F.when(fourth, "ninja").otherwise("").alias("build_backend"), timing.alias("compile_timing"))
    meta = F.struct(
        even.alias("split_compile_and_execute"), fourth.alias("precompiled_artifact_used"), F.when(third, True).alias("inline_gpu_execute_completed"), fourth.alias("compile_artifact_cache_hit"), F.lit(True).alias("compile_artifact_cache_enabled"),
        third.alias("compile_only"), F.when(even, "compile").alias("task_stage"), artifact.alias("compile_artifact"), F.when(even, "w1").alias("worker_id"), F.lit("inline").alias("inline_compile_worker_id"),
        F.when(third, "cuda:1").alias("worker_device"), F.lit("cpu").alias("inline_compile_worker_device"),
    )
    message = F.when(down, F.concat(F.lit("Worker shutdown: "), k.cast("string")))
    body = F.to_json(F.struct(
        F.when(bad, "http_error").otherwise("completed").alias("status"), F.when(~bad, F.col("o_orderstatus") == "F").alias("compiled"), F.when(~bad, F.col("o_orderstatus") != "P").alias("correctness"),
        F.when(down, "E7").alias("error_code"), message.alias("error_message"), meta.alias("metadata"), F.lit("x").alias("unknown"),
    ))
    own = [
        k.alias("task_id"), F.lit("plain").alias("scenario"), even.alias("split_requested"), (k % 10).alias("sample_idx"), F.col("o_custkey").alias("source_row"), third.alias("feedback_compiled"),
        F.round(F.col("o_totalprice") / 7, 3).alias("elapsed_sec"),
    ]
    rows = table(spark, d, "orders").select(*own, body.alias("body"))
    return rows.select(*[c for c in rows.columns if c != "body"], *records.flat_response(F.col("body")))


@query("p08_prefix_indexed", "SELECT i AS index, p_partkey FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_partkey, p_type FROM part) WHERE p_type LIKE 'PROMO%'")
def p08_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The filter keeps the index that each row had before."""
    rows = joins.numbered(table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey")
    return rows.where(F.col("p_type").startswith("PROMO")).select((F.col("position") - 1).cast("long").alias("index"), "p_partkey")


@query("p10_missing_fields", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'code,name' ELSE 'name' END AS missing FROM events")
def p10(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("id"), F.lit("1"))).otherwise(F.create_map(F.lit("id"), F.lit("1"), F.lit("code"), F.lit("x")))
    return table(spark, d, "events").select("event_id", F.array_join(rules.missing_fields(given, ["name", "id", "code"]), ",").alias("missing"))


@query(
    "p12_request_errors",
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'Missing required fields: code, name' END,
    CASE WHEN o_totalprice NOT BETWEEN 1000 AND 300000 THEN 'price must be between 1000 and 300000' END], lambda x: x IS NOT NULL), '; ') AS errors FROM orders""",
)
def p12(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("o_orderstatus") == "P", F.create_map(F.lit("id"), F.lit("1"))).otherwise(F.create_map(F.lit("code"), F.lit("c"), F.lit("name"), F.lit("n")))
    missing = rules.missing_fields(given, ["code", "name"])
    errors = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", "))),
        F.when(~F.col("o_totalprice").between(1000, 300000), "price must be between 1000 and 300000"),
    ))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(errors, "; ").alias("errors"))


@query(
    "p13_kernel_predicates",
    """SELECT p_partkey, p_partkey % 6 <> 2 AS framework, p_partkey % 6 = 4 AS telling FROM part""",
)
def p13_kernels(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["", "void at::native::add<float>(int)", "my_kernel(float*)", " at::native::copy", "aten::matmul_fused_own", "x::at::native::y"]))
    name = F.get(kinds, (F.col("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.is_framework_kernel(name).alias("framework"), text.is_telling_aten(name).alias("telling"))


@query("p16_metadata", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS worker, c_acctbal::VARCHAR AS other, false AS kept_old FROM customer")
def p16(spark: SparkSession, d: str) -> DataFrame:
    """A value under its new name, or else under the first of its old ones."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    other = F.lit("other"), F.col("c_acctbal").cast("string")
    both = F.create_map(F.lit("worker"), name, F.lit("worker_name"), segment, *other)
    given = F.when(F.col("c_custkey") % 2 == 0, both).otherwise(F.create_map(F.lit("host"), name, F.lit("worker_name"), segment, *other))
    told = rules.metadata_first(given, "worker", ["worker_name", "host"])
    kept = F.map_contains_key(told, "worker_name") | F.map_contains_key(told, "host")
    return table(spark, d, "customer").select("c_custkey", F.element_at(told, "worker").alias("worker"), F.element_at(told, "other").alias("other"), kept.alias("kept_old"))


@query("p18_json_safe", """SELECT p_partkey, CASE WHEN k <= 10 THEN repeat('[', k) || '1' || repeat(']', k) ELSE repeat('[', 11) || '"' || repeat('[', k - 11) || '1' || repeat(']', k - 11) || '"' || repeat(']', 11) END AS document
FROM (SELECT p_partkey, CAST(p_partkey % 14 AS INTEGER) AS k FROM part)""")
def p18(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("p_partkey") % 14).cast("int")
    nested = F.concat(F.repeat(F.lit("["), k), F.lit("1"), F.repeat(F.lit("]"), k))
    return table(spark, d, "part").select("p_partkey", records.json_safe(nested).alias("document"))


@query("p20_worker_kinds", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN 'gpu' ELSE 'cpu' END AS kind FROM supplier")
def p20(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    return table(spark, d, "supplier").select("s_suppkey", rules.worker_kind(F.when(k == 0, "CPU").otherwise("gpu"), F.when(k == 1, "cpu:0").otherwise("cuda:0")).alias("kind"))


@query("p21_entry_point", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 AND p_partkey % 2 = 1 THEN 'Model' ELSE 'ModelNew' END AS entry FROM part")
def p21(spark: SparkSession, d: str) -> DataFrame:
    """A class asked for by its own name, by the usual one where only some sources have the new class, or not at all."""
    size, new = F.col("p_size") % 3, F.col("p_partkey") % 2 == 0
    source = F.concat(F.lit("class "), F.when(new, "ModelNew").otherwise(F.col("p_type")), F.lit(":\n  pass"))
    asked = F.when(size == 0, F.col("p_type")).when(size == 1, "Model").otherwise("")
    return table(spark, d, "part").select("p_partkey", records.entry_point(source, asked).alias("entry"))


@query("p23_backends", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'triton' WHEN 1 THEN 'triton' WHEN 4 THEN 'cuda_agent' ELSE 'cuda' END AS backend FROM part")
def p23(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(F.lit(None).cast("string"), F.lit(" Triton "), F.lit("torch-compile"), F.lit("tilelang"), F.lit("CUDA_AGENT"), F.lit("unknown"))
    return table(spark, d, "part").select("p_partkey", records.backend(F.get(names, (F.col("p_partkey") % 6).cast("int"))).alias("backend"))


@query("p27_columns_and_row", "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST((SELECT count(*) FROM (DESCRIBE orders)) AS INTEGER) AS n_columns FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def p27(spark: SparkSession, d: str) -> DataFrame:
    """The row of one key, here the last, and how many columns the table has."""
    orders = table(spark, d, "orders")
    last = orders.agg(F.max("o_orderkey").alias("o_orderkey"))
    return orders.join(last, "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(len(orders.columns)).alias("n_columns"))


SUBMISSIONS = (
    # model, sources, mode; message, code, binding
    ("", {"a.cu": "x"}, "files"), ("class Other: pass", {"a.cu": "x"}, "files"), ("class ModelNew:\n  pass", {"a.cu": "x"}, "files"),
    ("import cuda_extension\nclass ModelNew:\n  pass", {}, "files"), ("import cuda_extension\nclass ModelNew:\n  pass", {"a.cpp": "x"}, "inline"),
    ("import cuda_extension\nclass ModelNew:\n  pass", {"a.cu": "x", "b.cpp": "x"}, "files"),
    ("import cuda_extension\nclass ModelNew:\n  pass", {"a.cu": "x", "b.cpp": '#include "../binding_registry.h"\nREGISTER_BINDING(f(1))\nint x;'}, ""),
    ("import cuda_extension\nclass ModelNew:\n  pass", {"a.cu": "x", "b.cpp": '#include "../binding_registry.h"\nREGISTER_BINDING(f(1)) ;'}, "files"),
    ("import cuda_extension\nclass ModelNew:\n  pass", {"a.cu": "torch::Tensor x"}, "tvm_ffi"), ("import cuda_extension\nclass ModelNew:\n  pass", {"a.cu": "x"}, "TVM_FFI"),
    ("import cuda_extension\nclass ModelNew:\n  pass", {"a.cu": "tvm::ffi::Tensor x"}, "tvm_ffi"), ("import cuda_extension\nclass ModelNew:\n  pass", {"a.cu": "tvm::ffi::Tensor torch::Tensor"}, "tvm_ffi"),
    ("import cuda_extension\nclass ModelNew:\n  pass", {"a.cu": "REGISTER_BINDING(f)", "b.cpp": '#include "../binding_registry.h"\nREGISTER_BINDING(f(1));'}, "files"),
)


@query(
    "f11_submissions",
    """SELECT p_partkey, CASE WHEN m = '' THEN '' ELSE 'Precheck failed: ' || m END AS message, nullif(c, '') AS code, b AS binding_api FROM part JOIN (VALUES
    (0, 'Code is required', 'VALIDATION_ERROR', 'unknown'), (1, 'Code must contain a ''ModelNew'' class', 'VALIDATION_ERROR', 'unknown'), (2, 'model_new.py must use cuda_extension', 'IMPORT_ERROR', 'unknown'),
    (3, 'CUDA sources are required for CUDA-Agent compilation', 'VALIDATION_ERROR', 'unknown'), (4, 'CUDA-Agent sources must include at least one .cu file', 'VALIDATION_ERROR', 'unknown'),
    (5, 'binding source must include ../binding_registry.h', 'VALIDATION_ERROR', 'unknown'), (6, 'b.cpp:2 has REGISTER_BINDING(...) without a trailing '';''', 'SYNTAX_ERROR', 'python_extension'),
    (7, '', '', 'python_extension'), (8, 'source_mode=''tvm_ffi'' requires TVM-FFI exports instead of REGISTER_BINDING/pybind bindings', 'VALIDATION_ERROR', 'python_extension'),
    (9, 'source_mode=''tvm_ffi'' requires TVM_FFI_DLL_EXPORT_TYPED_FUNC(...) or tvm::ffi Tensor bindings', 'VALIDATION_ERROR', 'unknown'), (10, '', '', 'tvm_ffi'), (11, '', '', 'mixed'), (12, '', '', 'python_extension')) t(k, m, c, b) ON p_partkey % 13 = k""",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    none = F.from_json(F.lit("{}"), "map<string,string>")
    given = F.array(*[
        F.struct(F.lit(m).alias("model"), (F.create_map(*[F.lit(x) for kv in s.items() for x in kv]) if s else none).alias("sources"), F.lit(mode).alias("mode"))
        for m, s, mode in SUBMISSIONS
    ])
    rows = table(spark, d, "part").select("p_partkey", F.get(given, (F.col("p_partkey") % len(SUBMISSIONS)).cast("int")).alias("x"))
    return rows.select("p_partkey", records.submission_check(F.col("x.model"), F.col("x.sources"), F.col("x.mode")).alias("c")).select("p_partkey", "c.*")


@query("f06_fenced", r"SELECT doc_id, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS kernel, trim(lang, ' ') AS binding, '' AS model FROM documents WHERE text IS NOT NULL AND NOT contains(text, '```')")
def f06(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a document as their kernel's code."""
    docs = table(spark, d, "documents").where("text is not null and not contains(text, '```')")
    answer = F.concat(F.lit("# Kernel\n```cuda\n\n"), F.col("text"), F.lit("\n\n```\nand\n## BINDING \n```\n"), F.col("lang"), F.lit("\n```\nz\n```\nw\n```"))
    return docs.select("doc_id", *[text.fenced(answer, s).alias(s) for s in ("kernel", "binding", "model")])


@query("f07_kernel_names", "SELECT p_partkey, array_to_string(list_sort(list_distinct([replace(p_name, ' ', '_'), lower(p_type) || '_' || p_partkey])), ',') AS names FROM part")
def f07_kernels(spark: SparkSession, d: str) -> DataFrame:
    """Two kernels named after each part, one of them defined twice, beside a function that is none."""
    one, two = F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.concat(F.lower("p_type"), F.lit("_"), F.col("p_partkey").cast("string"))
    source = F.concat(F.lit("__global__ void "), one, F.lit("(int x) {}\n__global__  ns::T<int> "), one, F.lit(" (int) {}\n__global__ void\n"), two, F.lit("(float* y);\nvoid c(int);"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.kernel_names(source), ",").alias("names"))


@query("f23_same_structure", "SELECT l_orderkey, l_linenumber, l_linenumber % 4 = 0 AS same FROM lineitem")
def f23(spark: SparkSession, d: str) -> DataFrame:
    """Nested values that agree, differ in a number, in a length or in a key."""
    k = F.col("l_linenumber") % 4
    shape = "struct<a:array<double>,m:map<string,struct<x:double,n:string>>>"
    value = lambda xs, key: F.struct(xs.alias("a"), F.create_map(key, F.struct(F.col("l_discount").alias("x"), F.lit(None).cast("string").alias("n"))).alias("m")).cast(shape)
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", value(F.array("l_quantity", "l_tax"), F.lit("k")).alias("a"),
        value(F.when(k == 1, F.array(F.col("l_quantity") + 1, "l_tax")).when(k == 2, F.array("l_quantity")).otherwise(F.array(F.col("l_quantity") * (1 + 1e-6), "l_tax")), F.when(k == 3, "other").otherwise("k")).alias("b"),
    )
    return rows.select("l_orderkey", "l_linenumber", records.same_structure(F.col("a"), F.col("b"), rows.schema["a"].dataType).alias("same"))


@query("f25_significant", "SELECT o_orderkey, CAST(printf('%.2e', o_totalprice) AS DOUBLE) AS shown, CAST(printf('%.2e', o_totalprice / 1e9) AS DOUBLE) AS small FROM orders")
def f25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", stats.significant(F.col("o_totalprice")).alias("shown"), stats.significant(F.col("o_totalprice") / 1e9).alias("small"))


@query("f28_merge", "SELECT c_custkey, 'n' || c_nationkey AS place, CASE WHEN c_acctbal > 0 THEN c_name END AS name, c_mktsegment AS segment, CAST(CASE WHEN c_acctbal > 0 THEN 3 ELSE 2 END AS INT) AS n_keys FROM customer")
def f28(spark: SparkSession, d: str) -> DataFrame:
    """Two maps as one, of which the first may be missing; the second's value wins."""
    place = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    first = F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("place"), F.lit("somewhere"), F.lit("name"), F.col("c_name")))
    merged = joins.merge_metadata(first, F.create_map(F.lit("place"), place, F.lit("segment"), F.col("c_mktsegment")))
    return table(spark, d, "customer").select("c_custkey", *[F.element_at(merged, k).alias(k) for k in ("place", "name", "segment")], F.size(merged).alias("n_keys"))


@query("f31_failures", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Trace of ' || o_orderkey ELSE o_orderpriority || ': no ' || o_custkey END AS verbose, 'no ' || o_custkey AS plain FROM orders")
def f31(spark: SparkSession, d: str) -> DataFrame:
    kind, message = F.col("o_orderpriority"), F.concat(F.lit("no "), F.col("o_custkey").cast("string"))
    trace = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Trace of "), F.col("o_orderkey").cast("string"))).when(F.col("o_orderstatus") == "P", "")
    return table(spark, d, "orders").select("o_orderkey", records.failure_text(kind, message, trace).alias("verbose"), records.failure_text(kind, message, trace, False).alias("plain"))


@query("f33_sources", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN replace(p_name, ' ', '_') || '.cu=' || p_size || ',z.cpp=' || p_brand WHEN 2 THEN 'kernels/kernel.cu=' || p_name END AS sources FROM part")
def f33(spark: SparkSession, d: str) -> DataFrame:
    """Blank sources, the text of a dict of two files, bare text, and a dict that ends too soon."""
    k, name = F.col("p_size") % 4, F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    literal = F.concat(F.lit(" {'z.cpp': '"), F.col("p_brand"), F.lit("', \""), name, F.lit('.cu": '), F.col("p_size").cast("string"), F.lit("}"))
    given = F.when(k == 0, "  \n").when(k == 1, literal).when(k == 2, F.col("p_name")).otherwise(F.concat(F.lit("{'"), name))
    told = records.sources_map(given)
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries(told), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return table(spark, d, "part").select("p_partkey", F.when(told.isNotNull(), pairs).alias("sources"))


@query("k03_summary_whole", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def k03_whole(spark: SparkSession, d: str) -> DataFrame:
    """The summary document, read again as the rows that it was made of."""
    document = files.summary_document(table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))
    column = document.columns[0]
    return document.select(F.explode(F.from_json(column, "rows array<struct<o_orderstatus:string,n:long>>")["rows"]).alias("r")).select("r.*")


@query("s07_log_paths", """WITH l AS (SELECT n_nationkey AS k, n_regionkey AS dir, '/logs/n' || n_regionkey || '/worker' || CASE WHEN n_nationkey % 5 = 0 THEN 's' ELSE '_' || n_nationkey END || '.log' AS path FROM nation),
d AS (SELECT path, min(dir) AS dir FROM l GROUP BY path) SELECT path, row_number() OVER (ORDER BY dir, CASE WHEN path LIKE '%/workers.log' THEN path END NULLS FIRST, path) AS position FROM d""")
def s07(spark: SparkSession, d: str) -> DataFrame:
    """A listing of folders in order, some files twice under other names; workers.log comes last in its folder."""
    r, k = F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")
    name = F.when(F.col("n_nationkey") % 5 == 0, "workers.log").otherwise(F.concat(F.lit("worker_"), k, F.lit(".log")))
    listing = table(spark, d, "nation").select(F.col("n_regionkey").alias("folder"), F.explode(F.array(F.concat(F.lit("/logs/n"), r, F.lit("/"), name), F.concat(F.lit("/logs/./n"), r, F.lit("//"), name), F.lit("/logs/other.txt"))).alias("path"))
    return files.log_paths(listing)


@query("s09_log_tail", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'whole new log' ELSE 'line ' || event_id END AS delta FROM events")
def s09(spark: SparkSession, d: str) -> DataFrame:
    before = F.concat(F.lit("old é "), F.repeat(F.lit("x"), (F.col("event_id") % 5).cast("int")))
    after = F.when(F.col("event_id") % 3 == 0, "whole new log").otherwise(F.concat(before, F.lit("line "), F.col("event_id").cast("string")))
    return table(spark, d, "events").select("event_id", text.appended(before, after).alias("delta"))


@query("t02_kernels_by_time", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS place FROM lineitem")
def t02(spark: SparkSession, d: str) -> DataFrame:
    """The kernels of each profile by time; of equal times the earlier comes first."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("t04_rank_whole", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal < 0, s_nationkey DESC, s_acctbal DESC, s_suppkey) AS place FROM supplier")
def t04_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every row's place: errors last, then by nation, within which ranges of the balance are numbered."""
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") < 0).alias("error"), (-F.col("s_nationkey")).alias("nation"), (-F.col("s_acctbal")).alias("balance"))
    within = ordered.queue_positions(rows, ["error", "nation"], ["balance", "s_suppkey"])
    sizes = rows.groupBy("error", "nation").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("error", "nation").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("error", "nation", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each group of the first keys
    return within.join(starts, ["error", "nation"]).select("s_suppkey", (F.col("start") + F.col("fifo_position")).alias("place"))


@query("t08_shuffle_whole", "SELECT p_partkey, md5('7:' || p_partkey) AS key FROM part")
def t08_whole(spark: SparkSession, d: str) -> DataFrame:
    """All rows in the order of a keyed digest."""
    key = F.md5(F.concat(F.lit("7:"), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select("p_partkey", key.alias("key")).orderBy("key", "p_partkey")


@query("t09_by_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def t09(spark: SparkSession, d: str) -> DataFrame:
    return joins.numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("position").cast("long").alias("place"))


@query("a33_all_passed", "SELECT l_orderkey, bool_and(l_quantity > 5) AS passed, count(*) FILTER (WHERE l_quantity <= 5) AS n_failed FROM lineitem GROUP BY 1")
def a33(spark: SparkSession, d: str) -> DataFrame:
    passed = F.col("l_quantity") > 5
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(passed).alias("passed"), F.count_if(~passed).alias("n_failed"))
