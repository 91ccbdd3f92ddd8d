"""The render cache: pages by the hash of the source's bytes, in a table sharded by hash prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import columns as C

SCHEMA = "sha256 string, title string, page_no int, page binary, marker string, max_aspect double, readable boolean"
_COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


def hits(due: DataFrame, cache: DataFrame) -> DataFrame:
    """Sources whose bytes were rendered before."""
    return due.join(cache.select("sha256").distinct(), "sha256", "left_semi")


def misses(due: DataFrame, cache: DataFrame) -> DataFrame:
    return due.join(cache.select("sha256"), "sha256", "left_anti")


class RenderCache:
    """Appends each new hash once; a read for given hashes opens their shards only."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, asked: DataFrame | None = None) -> DataFrame:
        """What is stored, or with ``asked`` (sha256) what its shards hold: as many as hash prefixes at most."""
        try:
            stored = self.spark.read.schema(SCHEMA + ", shard string").parquet(self.folder)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA + ", shard string")
        if asked is None:
            return stored
        shards = [r.shard for r in asked.select(C.cache_shard(F.col("sha256")).alias("shard")).where("shard is not null").distinct().collect()]
        return stored.where(F.col("shard").isin(shards))

    def put(self, pages: DataFrame) -> None:
        new = misses(pages, self.read(pages)).select(*_COLUMNS, C.cache_shard(F.col("sha256")).alias("shard"))
        new.write.mode("append").partitionBy("shard").parquet(self.folder)
