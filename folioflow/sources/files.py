"""File listings without content, and the content of chosen files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import columns as C
from folioflow.options import Options

LISTING = "path string, mtime double, size bigint"
#: Paths given to one content scan.
SCAN_PATHS = 10_000


def _clean(path: str) -> str:
    return f"regexp_replace({path}, '^file:/+', '/')"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of all files below root; a root that is no folder has none. The scan doesn't
    select content, so no file is opened."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return spark.createDataFrame([], LISTING)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.expr(_clean("path")).alias("path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"))


def inputs(files: DataFrame, o: Options) -> DataFrame:
    """(path, rel, mtime, size) of a listing's inputs: known suffixes, outside of the output tree, with
    paths relative to the vault."""
    path = F.col("path")
    mine = files.where(C.is_input(path) & ~C.under(path, o.output_dir))
    return mine.withColumn("rel", C.relative(path, o.vault_dir)).where("rel is not null").select("path", "rel", "mtime", "size")


def _literal(path: str) -> str:
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def contents(spark: SparkSession, rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` with their content, in blocks of about SCAN_PATHS files, so that a scan opens these files
    only; a scan takes a list of paths, so one block's paths at a time are on the driver. A file that has
    gone since the listing is missing from the result."""
    blocks = max(1, -(-rows.count() // SCAN_PATHS))
    for n in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("path"), F.lit(blocks)) == n) if blocks > 1 else rows
        paths = [_literal(r.path) for r in block.select("path").collect()]
        if paths:
            read = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths)
            yield block.join(read.select(F.expr(_clean("path")).alias("path"), "content"), "path")
