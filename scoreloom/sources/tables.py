"""A stored table with keys: an upsert writes only the buckets that it touches, and readers see a whole version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import ordered


class KeyedTable:
    """Rows in folders of hash buckets of their keys. A version is a small file that names the folder of each bucket; it is renamed into
    place once all is written, so that a reader has the rows of one version, the old or the new. Two writers of one version: the second fails.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{self.path}/versions")
        return hadoop, at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The latest version; 0 before the first."""
        _, fs, at = self._files()
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        lines = self.spark.read.text(f"{self.path}/versions/{version}").collect()  # one a bucket
        return {int(k): v for k, v in (r[0].split("\t") for r in lines if r[0])}

    def read(self, version: int | None = None) -> DataFrame:
        folders = self.folders(version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders.values()])

    def upsert(self, new: DataFrame) -> int:
        """The new version: rows of new in place of those of the same keys. Keys come once in new."""
        version = self.version()
        folders = self.folders(version)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        columns = self.spark.createDataFrame([], self.schema).columns
        kept = f"{self.path}/new/{uuid.uuid4().hex}"  # the touched buckets are counted and written from the same rows
        new.select(*columns, bucket.alias("__bucket")).write.parquet(kept)
        fresh = self.spark.read.schema(f"{self.schema}, __bucket int").parquet(kept)
        touched = sorted(r[0] for r in fresh.select("__bucket").distinct().collect())  # as many as buckets at most
        old = [f"{self.path}/{folders[b]}" for b in touched if b in folders]
        rows = fresh
        if old:
            before = self.spark.read.schema(self.schema).parquet(*old)
            rows = ordered.upsert(before.select("*", bucket.alias("__bucket")), fresh, [*self.keys, "__bucket"])
        name = f"rows/{uuid.uuid4().hex}"
        rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        self._commit(version + 1, folders | {b: f"{name}/__bucket={b}" for b in touched})
        return version + 1

    def _commit(self, version: int, folders: dict[int, str]) -> None:
        hadoop, fs, at = self._files()
        fs.mkdirs(at)
        temporary, final = hadoop.Path(at, f".{uuid.uuid4().hex}"), hadoop.Path(at, str(version))
        out = fs.create(temporary, False)
        try:
            out.write(bytearray("".join(f"{k}\t{v}\n" for k, v in sorted(folders.items())).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise ValueError(f"version {version} of {self.path} was written by another")
