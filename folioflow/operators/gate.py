"""The change gate: which files of a listing are due, decided by one left join and one CASE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.options import Options

SKIPPED_OLD, PREFILTER, UNCHANGED, PENDING, CAPPED, COOLDOWN, QUEUED = (
    "skipped-old", "prefilter-skip", "hash-unchanged", "still-pending-split", "retry-capped", "cooldown", "queued",
)
#: State columns that the gate reads, under the names they have beside a listing.
_STATE = ["mtime", "size", "sha256", "status", "retries", "processed_at"]


def recent(files: DataFrame, o: Options, now: float) -> DataFrame:
    """Files modified within the age limit; a file exactly at the limit stays. 0: no limit."""
    return files if o.max_age_hours <= 0 else files.where(F.col("mtime") >= F.lit(now - o.max_age_hours * 3600))


def with_state(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files with their state record, as s_* columns, and ``seen``."""
    told = state.select("rel", F.lit(True).alias("seen"), *(F.col(c).alias(f"s_{c}") for c in _STATE))
    return files.join(told, "rel", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def unmoved(joined: DataFrame) -> DataFrame:
    """Adds ``unmoved``: known good with the same time and size, so that no content is read."""
    same = F.col("seen") & (F.col("s_status") == "ok") & (F.col("s_mtime") == F.col("mtime")) & (F.col("s_size") == F.col("size"))
    return joined.withColumn("unmoved", F.coalesce(same, F.lit(False)))


def decide(joined: DataFrame, o: Options, now: float) -> DataFrame:
    """Adds ``gate``. Needs ``unmoved`` and, for rows that moved, ``token``; the first rule that holds
    decides. processed_at is in epoch seconds."""
    same = F.coalesce(F.col("seen") & (F.col("s_sha256") == F.col("token")), F.lit(False))
    since = F.lit(now) - F.col("s_processed_at")
    cooling = F.lit(o.min_reprocess_interval > 0) & F.col("seen") & F.coalesce(since < o.min_reprocess_interval, F.lit(False))
    gate = (
        F.when(F.col("unmoved"), PREFILTER)
        .when(same & (F.col("s_status") == "ok"), UNCHANGED)
        .when(same & (F.col("s_status") == "pending_split"), PENDING)
        .when(same & (F.coalesce("s_retries", F.lit(0)) >= o.max_retries), CAPPED)
        .when(cooling, COOLDOWN)
        .otherwise(QUEUED)
    )
    return joined.withColumn("gate", gate)


def change_gate(files: DataFrame, state: DataFrame, o: Options, now: float) -> DataFrame:
    """Gate of files that carry their token column already (rel, mtime, size, token)."""
    return decide(unmoved(with_state(files, state)), o, now)


def summary(gated: DataFrame) -> DataFrame:
    return gated.groupBy("gate").agg(F.count("*").alias("n"))


def split_ready(pages: DataFrame, o: Options) -> DataFrame:
    """Adds ``ready`` to (marker, max_aspect, readable): marked, or no page too tall; unreadable waits."""
    if not o.require_split:
        return pages.withColumn("ready", F.lit(True))
    fine = (F.col("marker") == o.split_marker_value) | (F.col("max_aspect") <= o.split_max_aspect)
    return pages.withColumn("ready", F.col("readable") & F.coalesce(fine, F.lit(False)))


def max_aspect(boxes: DataFrame, key: str) -> DataFrame:
    """(key, max_aspect): the largest height / width of a document's pages; pages of no width don't count."""
    ratio = F.when(F.col("width") != 0, F.col("height") / F.col("width"))
    return boxes.groupBy(key).agg(F.coalesce(F.max(ratio), F.lit(0.0)).alias("max_aspect"))


