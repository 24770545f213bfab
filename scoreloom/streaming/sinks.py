"""Sinks of streams that write each batch once, however often it is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def by_batch(path: str, form: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: a batch is the folder of its number below path, which a batch that is run again replaces."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(form).save(f"{path}/batch={number}")

    return put


def batches(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """What by_batch wrote, with the column batch."""
    return spark.read.schema(f"{schema}, batch int").format(form).load(path)


class Requeue:
    """For foreachBatch: of each worker's overdue tasks the first `most` go back into the queue, others wait for the next batch.

    A batch and what waits after it are folders of its number, so that a batch that is run again gives the same.
    """

    def __init__(self, path: str, schema: str, worker: str, order: list[str], most: int = 200):
        self.path, self.schema, self.worker, self.order, self.most = path, schema, worker, order, most
        self.last = -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.schema(self.schema).parquet(f"{self.path}/waiting/{number - 1}"))
        scan = F.row_number().over(Window.partitionBy(self.worker).orderBy(*self.order))
        kept = f"{self.path}/scanned/{number}"  # a batch's rows are computed once
        rows.withColumn("__i", scan).write.mode("overwrite").parquet(kept)
        scanned = spark.read.schema(f"{self.schema}, __i int").parquet(kept)
        scanned.where(F.col("__i") > self.most).drop("__i").write.mode("overwrite").parquet(f"{self.path}/waiting/{number}")
        by_batch(f"{self.path}/requeued")(scanned.where(F.col("__i") <= self.most).drop("__i"), number)
        self.last = number

    def drain(self, spark: SparkSession) -> None:
        """Batches without new rows, until nothing waits."""
        while self.last >= 0 and not spark.read.schema(self.schema).parquet(f"{self.path}/waiting/{self.last}").isEmpty():
            self(spark.createDataFrame([], self.schema), self.last + 1)
