"""The session that the library's semantics assume."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that change results, not only speed.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with SEMANTICS and adaptive execution; on a cluster leave master unset."""
    builder = SparkSession.builder.appName("scoreloom")
    if master:
        builder = builder.master(master)
    conf = SEMANTICS | {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | more
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if "SPARK_DRIVER_MEMORY" in os.environ:
        conf.setdefault("spark.driver.memory", os.environ["SPARK_DRIVER_MEMORY"])
    return builder.config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the tables below sf_dir, as Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of executors on which it is not installed."""
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="scoreloom-")) / package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)  # Spark copies it to the executors
