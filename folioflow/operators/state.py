"""The state table: one record for each source, in versioned snapshots behind a pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "rel string, mtime double, size bigint, sha256 string, source_modified string, out_path string, pages int, chars_per_page array<int>, "
    "processed_at double, status string, retries int, render_sha256 string, error string, checked_at double"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
#: Columns that an error record sets; the others keep what they were.
PATCHED = ["mtime", "size", "sha256", "status", "error", "retries"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def merge(state: DataFrame, changes: DataFrame, fresh_retries: bool = True) -> DataFrame:
    """State after a pass. ``changes`` has at most one row for each rel with the columns of state and:
    ok and pending_split records replace what was there, error records patch it and count one more
    retry, touched records (a new time on the same bytes) set time and size alone. Records are never
    removed."""
    old, new = state.alias("o"), changes.alias("n")
    both = old.join(new, F.col("o.rel") == F.col("n.rel"), "full_outer")
    status = F.col("n.status")
    changed_bytes = F.lit(fresh_retries) & ~F.coalesce(F.col("n.sha256") == F.col("o.sha256"), F.lit(False))
    tries = F.when(changed_bytes, 0).otherwise(F.coalesce("o.retries", F.lit(0)))

    def value(c: str):
        old_c, new_c = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == "rel":
            return F.coalesce(new_c, old_c)
        patch = (tries + 1 if c == "retries" else new_c) if c in PATCHED else old_c
        touch = new_c if c in ("mtime", "size") else old_c
        return F.when(status.isNull(), old_c).when(status == "error", patch).when(status == "touched", touch).otherwise(new_c)

    return both.select(*(value(c).alias(c) for c in COLUMNS))


def counters(state: DataFrame) -> DataFrame:
    """ok, error, pending_split and total_pages in one row."""
    is_ = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(s)
    pages = F.coalesce(F.sum(F.when(F.col("status") == "ok", F.coalesce("pages", F.lit(0)))), F.lit(0)).cast("bigint")
    return state.agg(is_("ok"), is_("error"), is_("pending_split"), pages.alias("total_pages"))


def problems(state: DataFrame) -> DataFrame:
    """Records that aren't good, by path."""
    return state.where(F.col("status").isin("error", "pending_split")).select("rel", "status", F.coalesce("retries", F.lit(0)).alias("retries"), F.coalesce("error", F.lit("")).alias("error")).orderBy("rel")


class StateStore:
    """Snapshots v=N under a folder, in order of rel; the pointer file names the current one. One writer at
    a time.

    A snapshot is complete before the pointer is replaced, in one rename, so a pass that dies at any point
    leaves the last state or the new one. Where there is no pointer although there are snapshots, the last
    complete one counts. The folder may be in any store that Spark's Hadoop configuration reaches.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._jvm = jvm

    def version(self) -> int:
        pointer = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(pointer):
            return self._last_complete()
        stream = self._fs.open(pointer)
        try:
            return int(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip())
        finally:
            stream.close()

    def _last_complete(self) -> int:
        if not self._fs.exists(self._path(self.folder)):
            return 0
        names = (f.getPath() for f in self._fs.listStatus(self._path(self.folder)))
        return max((int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and self._fs.exists(self._path(p, "_SUCCESS"))), default=0)

    def read(self) -> DataFrame:
        """The current state; none at all is an empty one, an unreadable one is an error."""
        n = self.version()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v={n}") if n else empty(self.spark)

    def write(self, state: DataFrame, n: int) -> None:
        state.select(*COLUMNS).orderBy("rel").write.mode("overwrite").parquet(f"{self.folder}/v={n}")

    def point(self, n: int) -> None:
        """Make snapshot n the current one: the staged pointer replaces the old one in one rename."""
        staged, pointer = self._path(f"{self.folder}/CURRENT.{n}"), self._path(f"{self.folder}/CURRENT")
        out = self._fs.create(staged, True)
        out.write(bytearray(str(n), "utf-8"))
        out.close()
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        where = self._fs.makeQualified(staged), self._fs.makeQualified(pointer)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where[0].toUri(), self._conf).rename(*where, how)

    def commit(self, state: DataFrame, keep: int = 3) -> int:
        n = self.version() + 1
        self.write(state, n)
        self.point(n)
        old = self._path(f"{self.folder}/v={n - keep}")
        if n > keep and self._fs.exists(old):
            self._fs.delete(old, True)
        return n
