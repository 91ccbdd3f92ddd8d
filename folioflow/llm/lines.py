"""Line dedup over overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.runtime import ready, table

SPAN = 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with kept_text, n_lines, n_removed and removed_spans ([start, end) line numbers).

    Lines are the \\n-split of the text. Each three consecutive lines, not all blank, are hashed (96
    bits); of each window the first occurrence by (id, line) in the corpus stays and the lines of
    every later one go, overlaps merged. Texts of fewer lines and null texts stay as they are; rows
    with a null id are kept and remove nothing; equal rows with equal ids are one document. A text
    that loses every line becomes empty. Extra columns pass through, whatever their names.
    """
    ready(docs.sparkSession)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    id_, text = F.col(f"doc.`{id_col}`"), F.col(f"doc.`{text_col}`")
    keyed = row.withColumns({"id": id_, "of": F.xxhash64(text), "lines": F.split(text, "\n", -1)})
    w = lambda i: [F.get("lines", i), F.get("lines", i + 1), F.get("lines", i + 2)]
    windows = (
        keyed.where(F.col("id").isNotNull() & (F.size("lines") >= SPAN))
        .select("id", "of", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - SPAN), lambda i: F.struct(i.alias("at"), F.xxhash64(*w(i)).alias("h"), F.hash(*w(i)).alias("g"), F.concat(*w(i)).rlike(r"[^\x20\x09-\x0D]").alias("full")))).alias("w"))
        .where("w.full").select("id", "of", "w.at", "w.h", "w.g")
    )
    repeated = windows.groupBy("h", "g").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h", "g"]).where(F.struct("id", "at") > F.col("first"))
    at = F.col("at")
    spans = (
        later.groupBy("id", "of").agg(F.sort_array(F.collect_set("at")).alias("at"))
        .select("id", "of",
            F.filter(at, lambda p, i: (i == 0) | (p - F.get(at, i - 1) > SPAN)).alias("starts"),
            F.transform(F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) - p > SPAN)), lambda p: p + SPAN).alias("ends"))
    )
    joined = keyed.join(spans, ["id", "of"], "left")
    none = F.array().cast("array<int>")
    starts, ends = F.coalesce("starts", none), F.coalesce("ends", none)
    stays = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("a"), F.concat(starts, F.array(F.size("lines"))).alias("b"))
    kept = F.array_join(F.flatten(F.transform(stays, lambda s: F.slice("lines", s["a"] + 1, s["b"] - s["a"]))), "\n")
    return joined.select(
        "doc.*",
        F.when(F.col("starts").isNull(), text).otherwise(kept).alias("kept_text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.aggregate(F.arrays_zip(starts.alias("a"), ends.alias("b")), F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]).cast("long")).alias("n_removed"),
        F.arrays_zip(starts.alias("start"), ends.alias("end")).alias("removed_spans"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i - 1 AS ln, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS w
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)),
f AS (SELECT w, min((doc_id, ln)) AS first FROM w WHERE regexp_matches(w, '[^\\x20\\x09-\\x0D]') GROUP BY w HAVING count(*) > 1),
c AS (SELECT DISTINCT w.doc_id, w.ln + k AS line FROM w JOIN f ON w.w = f.w AND (w.doc_id, w.ln) > f.first, range(3) r(k)),
x AS (SELECT doc_id, i - 1 AS line, ls[i] AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
k AS (SELECT x.doc_id, count(*) AS n_lines, count(c.line) AS n_removed, coalesce(string_agg(s, chr(10) ORDER BY x.line) FILTER (WHERE c.line IS NULL), '') AS kept
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.line = c.line GROUP BY x.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM k
"""
