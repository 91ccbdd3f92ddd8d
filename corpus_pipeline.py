"""From raw documents to token ids: quality rules, line dedup, SimHash near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes
every stage but the last as Parquet into the shared folder named by ``spark.checkpoint.dir`` and
reads it again, so a lost executor costs one stage at most. What the next stage has been written from is
removed; the last stage's input stays, as its rows are computed when they are asked for.

Every stage takes nulls in any column and gives no rows for an empty table; what it does with nulls, ties
and repeated rows is said at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import lines, mixture, pieces, quality, simhash
from folioflow.llm.runtime import ready


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null texts have no words and go; null languages and sources are
    groups of their own; repeated rows go or stay together."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later occurrences of three-line windows, in order of their ids; a
    document that loses all lines stays with an empty text. Rows with a null id keep theirs and remove none;
    repeated rows are one document and lose the same lines."""
    found = lines.dedup_lines(docs)
    return found.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; without any id, one text of
    the group. Of repeated rows one stays. Texts without words are one group."""
    return simhash.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last one of a shard up to its last word. Texts without
    words are never taken; null sources are a source of their own, the last; repeated rows share what they
    take."""
    return mixture.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, round_trip, token_ids of each row; null texts have no tokens."""
    return pieces.encode_by_blocks(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece_encoding", encoding_stage),
]

#: XXH64 fingerprints, the seeded order of the mix and the piece lattice have no SQL form.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    done: list[str] = []
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        for before in done:
            _remove(spark, before)
        done = [f"{folder}/{name}"]
    return STAGES[-1][1](spark, docs, sf_dir)
