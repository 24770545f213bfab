"""File sources and sinks beyond plain Parquet."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share.

    Where that is unset, one local process, as in tests, takes a temporary folder; a cluster gets an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="scoreloom-")
    return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def numbered_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, line_no from 1, line) of text files; blank lines keep their numbers.

    Files are read in byte ranges, in which lines are counted; a range starts from the count of the ranges before.
    Lines are kept in a scratch folder first, as another reading could cut the files elsewhere.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    kept = scratch(spark)
    at = F.monotonically_increasing_id().alias("at")
    reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), at, F.col("value").alias("line")).write.parquet(kept)
    rows = spark.read.parquet(kept)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    offsets = blocks.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(offsets, ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def log_paths(listing: DataFrame) -> DataFrame:
    """(path, position from 1) of the worker logs in a listing of (folder, path), folders in order.

    In a folder logs come by name and workers.log last; of a file listed again, also under a path with ./ or //,
    the first place counts.
    """
    plain = F.regexp_replace(F.regexp_replace("path", r"/(\./)+", "/"), "/{2,}", "/")
    logs = listing.select("folder", plain.alias("path")).where(F.col("path").rlike(r"/worker[^/]*\.log$"))
    first = logs.groupBy("path").agg(F.min("folder").alias("folder"))
    order = Window.orderBy("folder", F.endswith("path", F.lit("/workers.log")), "path")  # as many rows as there are log files
    return first.select("path", F.row_number().over(order).cast("long").alias("position"))


def jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """Records of JSON lines. Blank lines are skipped; malformed ones fail, or are dropped if tolerant."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def numbered_jsonl(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> DataFrame:
    """Records with the number of the line they stand in; blank lines count and give none."""
    lines = numbered_lines(spark, path, pattern).where(F.trim("line") != "")
    return lines.select("path", "line_no", F.from_json("line", schema).alias("r")).select("path", "line_no", "r.*")


def worker_log(spark: SparkSession, path: str) -> DataFrame:
    """(worker_id, task_id, seconds, path, line_no) of the lines that report a compiled task."""
    shape = r"Worker (\S+) completed task (\S+_compile) in ([0-9.]+)s"
    rows = numbered_lines(spark, path).where(F.col("line").rlike(shape))
    part = lambda i: F.regexp_extract("line", shape, i)
    return rows.select(part(1).alias("worker_id"), part(2).alias("task_id"), part(3).try_cast("double").alias("seconds"), "path", "line_no")


def log_matches(spark: SparkSession, path: str, wanted: DataFrame, pattern: str | None = None, ids: str = r"\bt[0-9][\w-]*") -> DataFrame:
    """(task_id, path, worker): for each task_id of wanted and each log that holds it, the first worker named in a line with it, or else the
    log's name without its ending; ids is the shape of task ids."""
    shape = r"Worker (\S+)"
    lines = numbered_lines(spark, path, pattern).where(F.col("line").rlike(ids))
    named = F.when(F.col("line").rlike(shape), F.regexp_extract("line", shape, 1))
    words = lines.select("path", "line_no", named.alias("worker"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(ids), F.lit(0)))).alias("task_id"))
    found = words.join(wanted.select("task_id").distinct(), "task_id")
    first = F.min_by("worker", F.when(F.col("worker").isNotNull(), F.col("line_no")))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return found.groupBy("task_id", "path").agg(first.alias("worker")).select("task_id", "path", F.coalesce("worker", stem).alias("worker"))


def log_search(spark: SparkSession, path: str, wanted: DataFrame, pattern: str | None = None, ids: str = r"\bt[0-9][\w-]*") -> DataFrame:
    """(task_id, worker) of the first log, by path, that holds the task; see log_matches."""
    return log_matches(spark, path, wanted, pattern, ids).groupBy("task_id").agg(F.min_by("worker", "path").alias("worker"))


def build_log(spark: SparkSession, path: str) -> DataFrame:
    """(start_ms, end_ms, output) of a tab-separated build log without comments, blank, short or non-integer lines."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")) & (F.size(f) >= 4))
    return rows.select(F.get(f, 0).try_cast("long").alias("start_ms"), F.get(f, 1).try_cast("long").alias("end_ms"), F.get(f, 3).alias("output")).where("start_ms is not null and end_ms is not null")


def build_edges(spark: SparkSession, path: str) -> DataFrame:
    """(output, rule, source) of `build out: rule source` lines."""
    shape = r"^build (\S+): (\S+) (\S+)"
    rows = spark.read.text(path).where(F.col("value").rlike(shape))
    return rows.select(*[F.regexp_extract("value", shape, i).alias(n) for i, n in ((1, "output"), (2, "rule"), (3, "source"))])


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of KEY=value lines; comments skipped, paired quotes stripped, the last of a key wins."""
    shape = r"^\s*(?:export\s+)?([A-Za-z_]\w*)=(.*?)\s*$"
    rows = numbered_lines(spark, path).where(F.col("line").rlike(shape) & ~F.ltrim("line").startswith("#"))
    value = F.regexp_replace(F.regexp_extract("line", shape, 2), r"""^(["'])(.*)\1$""", "$2")
    return rows.select(F.regexp_extract("line", shape, 1).alias("key"), value.alias("value"), "line_no").groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def devices(spark: SparkSession, path: str) -> DataFrame:
    """(name, memory_mb) of lines `name, memory`."""
    f = F.from_csv("value", "name string, memory string", {"ignoreLeadingWhiteSpace": "true"})
    return spark.read.text(path).where(F.trim("value") != "").select(f.alias("r")).select("r.name", F.regexp_extract("r.memory", "([0-9.]+)", 1).try_cast("double").alias("memory_mb"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_jsonl(df: DataFrame, path: str, order: str) -> None:
    """One file in order. It is made by one task: for reports of bounded size, not for whole tables."""
    df.coalesce(1).sortWithinPartitions(order).write.mode("overwrite").json(path)


def summary_document(df: DataFrame) -> DataFrame:
    """The rows of a small report as one JSON document."""
    return df.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("rows"), F.count(F.lit(1)).alias("n"))).alias("document"))
