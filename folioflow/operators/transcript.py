"""Transcripts: page texts folded in order, two layouts, and names that don't collide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import columns as C
from folioflow.options import Options


def fold_tokens(tokens: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, text): a page's token stream joined in order, blank tokens dropped, white space stripped."""
    parts = tokens.where(F.trim(text) != "").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("parts"))
    return parts.select(*keys, C.strip(F.array_join(F.transform("parts", lambda p: p[text]), "")).alias("text"))


def collect_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, pages, n_pages, chars_per_page, chars): pages in order, lengths in code points."""
    got = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
    lengths = F.transform("pages", lambda p: F.length(p["text"]))
    return got.select(
        key, "pages", F.size("pages").cast("bigint").alias("n_pages"), lengths.alias("chars_per_page"),
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, n: s + n).alias("chars"),
    )


def with_front_matter(pages: Column, title: Column, rel: Column, model: str, modified: Column, processed: Column) -> Column:
    """A transcript with its front matter and a link back; ``modified`` may be null and is then left out."""
    lengths = C.json_int_list(F.transform(pages, lambda p: F.length(p["text"])))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        "\n", F.lit("---"), line("source", rel), F.lit(f"model: {model}"), line("source_modified", modified), line("processed_at", processed),
        line("pages", F.size(pages).cast("string")), line("chars_per_page", lengths), F.lit("status: ok\n---\n"),
    )
    sections = F.transform(pages, lambda p: F.concat(F.lit("## Page "), p["page_no"].cast("string"), F.lit("\n\n"), p["text"], F.lit("\n")))
    return F.concat_ws("\n", head, F.concat(F.lit("# "), title), F.lit(""), F.concat(F.lit("Source: [["), rel, F.lit("]]")), F.lit(""), F.array_join(sections, "\n"))


def plain(pages: Column, title: Column) -> Column:
    """A transcript for reading: a title and a section for each page."""
    sections = F.transform(pages, lambda p: F.concat(F.lit("\n## Page "), p["page_no"].cast("string"), F.lit("\n\n"), p["text"], F.lit("\n")))
    return F.concat(F.lit("# "), title, F.lit("\n"), F.when(F.size(pages) > 0, F.concat(F.lit("\n"), F.array_join(sections, "\n"))).otherwise(F.lit("")))


def name_outputs(due: DataFrame, state: DataFrame, o: Options) -> DataFrame:
    """Adds ``out_path`` and ``violation`` to rows of (path, rel, title, sha256).

    A name belongs to the source that state has it for; else to the first by path order in this
    pass. Others get their content hash into the name, and where even that is taken twice, equal
    contents with equal titles in one folder, the whole hash of their own path as well.
    """
    wanted = due.withColumn("plain_path", C.output_path(F.col("path"), F.col("title"), o))
    owners = state.where("out_path is not null").groupBy(F.col("out_path").alias("plain_path")).agg(F.min("rel").alias("owner"))
    told = wanted.join(owners, "plain_path", "left")
    turn = F.row_number().over(Window.partitionBy("plain_path").orderBy(F.when(F.col("owner") == F.col("rel"), 0).otherwise(1), C.components(F.col("rel"))))
    told = told.withColumn("first", F.coalesce(F.col("owner") == F.col("rel"), F.col("owner").isNull() & (turn == 1)))
    tagged = C.output_path(F.col("path"), F.col("title"), o, F.substring("sha256", 1, 8))
    told = told.withColumn("out_path", F.when(F.col("first"), F.col("plain_path")).otherwise(tagged))
    again = F.row_number().over(Window.partitionBy("out_path").orderBy(C.components(F.col("rel"))))
    longer = C.output_path(F.col("path"), F.col("title"), o, F.concat(F.substring("sha256", 1, 8), F.lit("-"), F.sha2("rel", 256)))
    told = told.withColumn("out_path", F.when(again == 1, F.col("out_path")).otherwise(longer))
    return told.withColumn("violation", C.path_violation(F.col("out_path"), F.col("path"), o)).drop("plain_path", "owner", "first")
