"""Session helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and make sure a checkpoint folder is set.

    The folder named by ``spark.checkpoint.dir`` is used as it is; only a local session without one
    (tests, notebooks) gets a folder of its own. On a cluster executors wouldn't see that folder, so there
    a session without one is an error. Checkpoints go when their frames do under
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if _ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioflow-checkpoint-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes in a text column: one pass over that column alone."""
    return int(docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
