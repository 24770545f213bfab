"""Golden cases of expressions and operators that the driver's tables don't reach."""

from __future__ import annotations

import math
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import rules, stats, text
from scoreloom.operators import joins, ordered
from scoreloom.plans import registry
from scoreloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "index"), [(1, 0), (11, 10), (20, 18), (10, 9), (2, 1)])
def test_nearest_rank_rounds_half_to_even(spark, n, index):
    assert spark.range(n).select(F.col("id").cast("double").alias("v")).agg(stats.nearest_rank(F.col("v"), 0.95).alias("x")).first()["x"] == index


def test_percentiles_of_nothing_are_null(spark):
    row = spark.range(0).select(F.col("id").alias("v")).agg(*stats.metric_summary(F.col("v"))).first()
    assert (row["n"], row["p95"], row["p50"], row["min"]) == (0, None, None, None)


def test_summaries_equal_sorted_groups(spark):
    """Repeats, nulls, a null key, a group of nulls only, one value alone; and any number of ranges."""
    rows = [("hot", float(i * 37 % 101)) for i in range(1000)] + [("even", float(v)) for v in (4, 1, 3, 2)] + [(None, 7.0), (None, None), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    key = lambda x: repr(tuple(x))
    want = df.groupBy("g").agg(*stats.metric_summary(F.col("v"))).collect()
    assert sorted(ordered.metric_summary(df, ["g"], "v").collect(), key=key) == sorted(want, key=key)
    for parts in (1, 2, 7):
        got = ordered.at_indexes(df, ["g"], "v", {"t": lambda n: stats.truncated_index(n, 0.9)}, parts).collect()
        assert {x["g"]: x["t"] for x in got} == {x["g"]: x["t"] for x in df.groupBy("g").agg(stats.truncated_rank(F.col("v"), 0.9).alias("t")).collect() if x["t"] is not None}
    assert ordered.metric_summary(df.where("false"), [], "v").first()["p95"] is None


@pytest.mark.parametrize("name", ["a02_metric_summary", "a03_percentiles", "a10_column_summaries", "a24_health", "a31_stress"])
def test_percentiles_gather_no_group(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not any(x in plan for x in ("collect_list(", "median(", " percentile("))


@pytest.mark.parametrize(("x", "want"), [(1234.5, 1230.0), (0.0123456, 0.0123), (0.0, 0.0), (2.5, 2.5)])
def test_significant_digits(spark, x, want):
    assert one(spark, stats.significant(F.lit(x))) == want


def test_ties_are_rounded_as_printf_does(spark):
    """Ties of the exact binary value go to the even digit, in statistics and percentages alike; nulls and NaN stay."""
    df = spark.createDataFrame([("a", 122500.0), ("a", 96450.0), ("b", None), ("c", float("nan"))], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in df.groupBy("g").agg(*stats.timing_stats(F.col("v"), 3)).collect()}
    assert got["a"][2:] == (96400.0, 122000.0, 2) and got["b"] == (None, None, None, None, 0) and all(math.isnan(x) for x in got["c"][:4])
    assert one(spark, stats.percent(F.lit(1), F.lit(32))) == "3.12%"


@pytest.mark.parametrize(("x", "want"), [(7775.0, 7.77e-06), (9895.0, 9.89e-06)])
def test_quotients_below_a_tie_are_rounded_down(spark, x, want):
    """x / 1e9 prints as a tie, but its binary value lies below it."""
    assert one(spark, stats.significant(F.lit(x) / 1e9)) == want


@pytest.mark.parametrize(("a", "b", "want"), [("nan", "nan", False), ("inf", "inf", True), ("inf", "-inf", False), ("1", "inf", False), ("1", "1.00001", True), ("1", "1.1", False), ("nan", "1", False)])
def test_allclose(spark, a, b, want):
    assert one(spark, stats.allclose(F.lit(float(a)), F.lit(float(b)))) is want


@pytest.mark.parametrize(
    ("message", "context", "want"),
    [
        ("CUDA compilation timeout", None, "COMPILATION_ERROR"), ("Task timed out", None, "TIMEOUT_ERROR"), ("", "validation", "UNKNOWN_ERROR"), (None, None, "UNKNOWN_ERROR"), ("odd", "during Compile step", "COMPILATION_ERROR"),
        ("odd", "nothing", "UNKNOWN_ERROR"), ("output has a mismatch", None, "CORRECTNESS_ERROR"), ("Queue is full", None, "RESOURCE_ERROR"), ("redis error", None, "SYSTEM_ERROR"), ("missing a class", None, "VALIDATION_ERROR"), ("out of memory", None, "RUNTIME_ERROR"),
    ],
)
def test_error_classes(spark, message, context, want):
    assert one(spark, text.classify_error(F.lit(message).cast("string"), F.lit(context).cast("string"))) == want


@pytest.mark.parametrize(("name", "want"), [("my_kernel(float*, int)", "my_kernel"), ("ns::my_kernel<int>(float)", "my_kernel"), ("plain", "plain"), ("", "")])
def test_bare_names(spark, name, want):
    assert one(spark, text.bare_kernel_name(F.lit(name))) == want


@pytest.mark.parametrize(("name", "framework", "telling"), [("void at::native::x", True, False), ("aten::mm", True, True), ("aten::empty", True, False), ("cudaLaunchKernel", True, False), ("my_kernel(float*)", False, False), ("", True, False)])
def test_kernel_kinds(spark, name, framework, telling):
    assert one(spark, text.is_framework_kernel(F.lit(name))) is framework
    assert one(spark, text.is_telling_aten(F.lit(name))) is telling


@pytest.mark.parametrize(("raw", "want"), [("sm_80", "8.0"), ("8.0+PTX; compute_90", "8.0;9.0"), ("7.5, 8.6 sm_120", "7.5;8.6;12.0"), ("", "")])
def test_arch_lists(spark, raw, want):
    assert one(spark, text.arch_list(F.lit(raw))) == want


def test_small_parsers(spark):
    assert one(spark, text.compiled_flag(F.lit('x "Compiled" : TRUE'))) is True
    assert one(spark, text.compiled_flag(F.lit("none"))) is None
    assert one(spark, text.without_retry(F.lit("a_retry1_retry2"))) == "a_retry1"
    assert one(spark, text.without_retry(F.lit("a"))) == "a"
    assert one(spark, text.number(F.lit("12.5%"))) == 12.5
    assert one(spark, text.number(F.lit(""))) is None
    assert one(spark, text.milliseconds(F.lit("250us"))) == 0.25
    assert one(spark, text.file_kind(F.lit("a.cuda.o"))) == "cuda_object"
    assert one(spark, text.kernel_names(F.lit("__global__ void b(int) __global__ void a(int) __global__ void b(int)"))) == ["a", "b"]
    assert one(spark, text.fenced(F.lit("## Code\n```cpp\n x = 1\n\n```"), "Code")) == "x = 1"
    assert one(spark, text.text_of_flag(F.lit(None).cast("boolean"))) == "None"
    assert one(spark, text.first_text(F.lit("  "), F.lit(" b "))) == " b "
    assert one(spark, rules.int_list(F.lit("[1, 2]"), [0])) == [1, 2]
    assert one(spark, rules.int_list(F.lit("x"), [0])) == [0]


def test_records(spark):
    m = F.create_map(F.lit("old"), F.lit("1"), F.lit("z"), F.lit("2"))
    assert one(spark, rules.metadata_first(m, "new", ["older", "old"])) == {"new": "1", "z": "2"}
    assert one(spark, rules.missing_fields(m, ["z", "b", "a"])) == ["a", "b"]
    assert one(spark, joins.merge_metadata(m, F.create_map(F.lit("z"), F.lit("3")))) == {"old": "1", "z": "3"}
    assert one(spark, rules.kernel_error(F.lit(False), F.lit(False), F.lit("x"))["message"]) == "Kernel compilation failed: x"
    reason = lambda *a: one(spark, rules.restart_reason(*map(F.lit, a)))
    assert [reason(True, 0, 0, True, False, 100), reason(False, 120, 61, True, False, 100), reason(False, 121, 0, True, False, 100), reason(True, 0, 0, True, False, 90), reason(True, 0, 0, False, False, 100)] == ["cuda_error", "offline", "heartbeat", None, None]


def test_pairing(spark):
    kernels = spark.createDataFrame([(1, True, 2.0), (2, True, 0.0), (3, False, 2.0), (4, True, 2.0), (5, None, 1.0)], "base_task_id int, correctness boolean, kernel_runtime double")
    references = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, 4.0), (5, -1.0)], "base_task_id int, reference_runtime double")
    assert {r["base_task_id"]: (r["reference_runtime"], r["speedup"]) for r in joins.pair_results(kernels, references).collect()} == {1: (4.0, 2.0), 2: (4.0, 0.0), 3: (4.0, 0.0), 4: (-1.0, 0.0), 5: (-1.0, 0.0)}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_join_is_closed_and_gives_each_pair_once(spark, width):
    a = spark.createDataFrame([("k", 0, 10), ("k", 10, 30), ("j", 0, 100), ("k", 50, 40)], "k string, a1 long, a2 long")
    b = spark.createDataFrame([("k", 10, 10), ("k", 31, 40), ("j", 99, 300), ("k", -5, 0)], "k string, b1 long, b2 long")
    out = sorted((r["a1"], r["b1"]) for r in joins.interval_join(a, b, ["k"], ("a1", "a2"), ("b1", "b2"), width).collect())
    assert out == [(0, -5), (0, 10), (0, 99), (10, 10)]


def test_trailing_window_leaves_its_far_end_out(spark):
    rows = spark.createDataFrame([("w", 0), ("w", 300_000_000), ("w", 299_999_999), ("v", 1)], "k string, us long")
    out = {(r["k"], r["us"]): r["n_trailing"] for r in ordered.trailing_count(rows, "k", "us", F.lit(True), 300_000_000).collect()}
    assert out == {("w", 0): 1, ("w", 299_999_999): 2, ("w", 300_000_000): 2, ("v", 1): 1}


def test_short_strata_fail(spark):
    with pytest.raises(ValueError, match="too few"):
        ordered.exact_sample(spark.range(3).withColumn("s", F.lit("a")), "s", {"a": 4}, F.col("id"))


def test_wait_actions(spark):
    act = lambda *a: one(spark, ordered.wait_action(*[F.lit(x) for x in a]))
    assert act(61, "pending", True, 60, 600) == "requeue_queue_wait_timeout"
    assert act(60, "pending", True, 60, 600) == "keep"
    assert act(10**6, "processing", True, 60, 600) == "keep"
    assert act(0, "processing", False, 60, 600) == "requeue_stale_assignment"


def test_names_are_registered_once():
    with pytest.raises(KeyError):
        registry.query("a01_timing_stats")(lambda s, d: None)


def test_lines_are_numbered_across_byte_ranges(spark, tmp_path):
    """One file is read by many tasks, and blank lines count."""
    want = {}
    for name, n in (("a.log", 2000), ("b.log", 3)):
        texts = ["" if i % 7 == 0 else f"line {i} é\r" if i % 5 == 0 else f"line {i}" for i in range(n)]
        (tmp_path / name).write_bytes(("\n".join(texts) + "\n" * (name == "a.log")).encode())
        want |= {(name, i + 1): x for i, x in enumerate(texts)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(before, ("1000", "100")):
            spark.conf.set(k, v)
        out = files.numbered_lines(spark, str(tmp_path), "*.log").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(x["path"].rsplit("/", 1)[1], x["line_no"]): x["line"] for x in out} == want and len(out) == len(want)
    assert len({x["task"] for x in out}) > 5


def test_log_search_finds_whole_ids_of_many_tasks(spark, tmp_path):
    """t1 isn't found in lines of t10, and a line that names no worker doesn't count."""
    (tmp_path / "a.log").write_text("t1 queued\nWorker w9 took t10 now\nWorker w1 took t1, now\nWorker w2 took t1 now\n")
    wanted = spark.createDataFrame([("t1",), ("t10",), ("t2",)], "task_id string")
    assert {tuple(x) for x in files.log_search(spark, str(tmp_path), wanted).collect()} == {("t1", "w1"), ("t10", "w9")}


def test_whole_queries_leave_no_order_out(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey").distinct().count()
    steps = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber < 4").count()
    assert registry.QUERIES["j06_first_sample_whole"](spark, d).count() == n
    assert registry.QUERIES["s10_build_log_whole"](spark, d).count() == steps
    assert registry.QUERIES["s08_log_search_whole"](spark, d).count() == spark.read.parquet(f"{d}/orders.parquet").count()


@pytest.mark.parametrize("ranges", [True, False])
def test_queues_are_numbered_by_ranges(spark, monkeypatch, ranges):
    """Ties of the first order column, nulls of it and a null queue; no window holds a queue, unless there are few rows in all."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 0 if ranges else 1000)
    rows = [("hot" if i % 3 else None, None if i % 50 == 0 else i * 7 % 90, i) for i in range(900)]
    df = spark.createDataFrame(rows, "q string, a int, b int").repartition(4)
    out = ordered.queue_positions(df, ["q"], ["a", "b"])
    want = {}
    for q in ("hot", None):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r: i + 1 for i, r in enumerate(mine)}
    assert {tuple(x)[:3]: x["fifo_position"] for x in out.collect()} == want
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (out, registry.QUERIES["w04_round_robin"](spark, "/root/testdata/sf0.001"))]
    assert all("row_number" in x and ("__part" in x or not ranges) and "collect_list(" not in x for x in plans)
