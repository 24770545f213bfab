"""What the training-data operators share."""

from __future__ import annotations

import functools
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of the filters that precede a join with few keys; their broadcast has at most so many rows, whatever the input.
BUCKETS = 1 << 20
#: Bytes of texts that a task works on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share.

    Where it is unset, one local process, as in tests, gets a temporary folder of its own; a cluster gets an error,
    since a folder of one machine would be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="scoreloom-")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from spark.checkpoint.dir from then on; lost executors take nothing with them."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key may be one of wanted's, and all that are: a filter without a shuffle of df.

    What is broadcast are the numbers of buckets, BUCKETS rows at most; with far more keys the filter lets all pass.
    """
    few = wanted.select(bucket(F.col(key)).alias("__bucket")).distinct()
    return df.withColumn("__bucket", bucket(F.col(key))).join(F.broadcast(few), "__bucket", "left_semi").drop("__bucket")


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts of about size bytes in column, a row at least each; an empty batch is one part."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    at = 0
    if not len(lengths):
        yield batch
    ends = np.cumsum(lengths)
    while at < len(lengths):
        past = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, past + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop
