"""One incremental pass: list, gate, render, transcribe, write, commit."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import columns as C
from folioflow.operators import bands, gate, stages, state, transcript
from folioflow.operators.backends import Renderer, Transcriber
from folioflow.operators.cache import RenderCache, hits, misses
from folioflow.options import BUNDLE_SUFFIXES, PAGE_SUFFIXES, Options, check_paths
from folioflow.sources import files


@dataclass
class PassResult:
    """gates: rel count by gate. done: transcripts written. failed: rel -> error. entered: sources that
    began to wait for splitting in this pass."""

    gates: dict[str, int]
    done: int
    failed: dict[str, str]
    entered: list[str]
    version: int


def _kept(df: DataFrame) -> DataFrame:
    """Cut lineage, so that backends run once whatever is derived from their rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioflow-"))
    return df.checkpoint(eager=True)


def _each_content(spark: SparkSession, rows: DataFrame, step: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    parts = [_kept(step(block)) for block in files.contents(spark, rows)]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def gated(spark: SparkSession, o: Options, records: DataFrame, now: float) -> tuple[DataFrame, int]:
    """(path, rel, mtime, size, token, gate, s_*) of the inputs, and how many were too old to look at.

    Content is read only for files whose time or size moved; with hash_check off, for none.
    """
    every = _kept(files.inputs(files.list_files(spark, o.source_dir), o))
    looked_at = gate.recent(every, o, now)
    known = _kept(gate.unmoved(gate.with_state(looked_at, records)))
    if o.hash_check:
        moved = known.where(~F.col("unmoved"))
        tokens = _each_content(spark, moved.select("path"), lambda x: x.select("path", C.content_token(F.col("content")).alias("token")), "path string, token string")
        told = known.join(tokens, "path", "left").where("unmoved or token is not null")  # else: gone since the listing
    else:
        told = known.withColumn("token", F.when(~F.col("unmoved"), C.mtime_token(F.col("mtime"), F.col("size"))))
    decided = _kept(gate.decide(told, o, now))
    return decided, every.count() - known.count()


def rendered_rows(spark: SparkSession, due: DataFrame, renderer: Renderer) -> DataFrame:
    """``stages.render`` of sources (path, rel), read in blocks."""
    asked = due.withColumn("suffix", F.lower(C.suffix(F.col("path"))))
    return _each_content(spark, asked, lambda x: stages.render(x.withColumn("sha256", C.content_token(F.col("content"))), renderer), stages.RENDERED)


def rendered_pages(spark: SparkSession, due: DataFrame, renderer: Renderer, cache: RenderCache, hashed: bool) -> DataFrame:
    """Rows of ``stages.render`` for due sources. Where tokens are content hashes, bundles and drawings
    that the cache has are neither opened nor rendered again."""
    suffix = F.lower(C.suffix(F.col("path")))
    due = due.withColumn("suffix", suffix)
    rendered = F.col("suffix").isin(*BUNDLE_SUFFIXES, *PAGE_SUFFIXES)
    asked = due.where(rendered & F.lit(hashed)).withColumn("sha256", F.col("token"))
    stored = cache.read(asked)
    known = _kept(hits(asked, stored).select("rel", "sha256"))
    again = _kept(known.join(stored, "sha256").select("rel", "sha256", "title", "page_no", "page", "marker", "max_aspect", "readable", F.lit(None).cast("string").alias("error")))
    rest = due.join(known, "rel", "left_anti")
    fresh = rendered_rows(spark, rest, renderer)
    new = fresh.where("page is not null").join(due.where(rendered).select("rel"), "rel", "left_semi")
    cache.put(_kept(new.dropDuplicates(["sha256", "page_no"])))
    return fresh.unionAll(again)


def cut_tall(pages: DataFrame, renderer, o: Options) -> tuple[DataFrame, DataFrame]:
    """Pages with the tall ones cut at white bands and all renumbered, and (rel, error) of sources whose
    pages can't be measured or cut; needs profile() and crop()."""
    every = _kept(stages.profiles(pages, renderer)).withColumn("key", F.struct("rel", "page_no"))
    shape = every.where("error is null")
    tall = shape.where((F.col("width") > 0) & (F.col("height") / F.col("width") > o.split_max_aspect))
    rows = bands.rows_of(tall, "key", "profile")
    cuts = bands.cuts(bands.white_bands(rows, "key", float(o.split_whitespace_threshold), o.split_min_gap_height), "key", o.split_target_page_height)
    sized = tall.join(cuts.where(F.size("cuts") > 0), "key").select("key", "cuts", F.size("profile").alias("image_height"), F.col("height").alias("page_height"))
    parts = bands.segments(sized, "key").select("key.rel", "key.page_no", "segment", "top", "bottom")
    cropped = _kept(stages.crop(pages.join(parts, ["rel", "page_no"], "left"), renderer))
    number = F.row_number().over(Window.partitionBy("rel").orderBy("page_no", "segment"))
    wrong = every.select("rel", "page_no", "error").unionAll(cropped.select("rel", "page_no", "error")).where("error is not null")
    whole = cropped.where("error is null").withColumn("page_no", number).select("rel", "page_no", "page")
    return whole, wrong.groupBy("rel").agg(F.min_by("error", "page_no").alias("split_error"))


def run_pass(spark: SparkSession, o: Options, renderer: Renderer, transcriber: Transcriber, now: float | None = None) -> PassResult:
    """Process what is due and commit the state once, after all files are written."""
    check_paths(o)
    now = time.time() if now is None else now
    store, cache = state.StateStore(spark, f"{o.state_dir.rstrip('/')}/manifest"), RenderCache(spark, f"{o.state_dir.rstrip('/')}/rendered")
    records = store.read()
    decided, old = gated(spark, o, records, now)
    gates = {r["gate"]: r["n"] for r in gate.summary(decided).collect()}
    if old:
        gates[gate.SKIPPED_OLD] = old
    due = decided.where(F.col("gate") == gate.QUEUED).select("path", "rel", "mtime", "size", "token", "s_status")
    touched = decided.where(F.col("gate") == gate.UNCHANGED).select("rel", "mtime", "size", F.lit("touched").alias("status"))
    none_due, none_touched = not gates.get(gate.QUEUED), not gates.get(gate.UNCHANGED)
    if none_due and none_touched:
        return PassResult(gates, 0, {}, [], store.version())

    pages = rendered_pages(spark, due, renderer, cache, o.hash_check)
    page_hash = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.sha2("page", 256).alias("h")))), lambda p: p["h"]), ""), 256)
    heads = _kept(pages.groupBy("rel").agg(F.first("sha256").alias("sha256"), F.first("title").alias("visible"), F.max("marker").alias("marker"), F.max("max_aspect").alias("max_aspect"), F.max("readable").alias("readable"), F.max("error").alias("error"), page_hash.alias("render_sha256")))
    sound = pages.where("error is null").select("rel", "page_no", "page")
    if o.auto_split:
        sound, wrong = cut_tall(sound, renderer, o)
        heads = _kept(heads.join(wrong, "rel", "left").withColumn("error", F.coalesce("error", "split_error")).drop("split_error"))
        heads = heads.withColumn("marker", F.when(F.col("error").isNull(), F.lit(o.split_marker_value)))
    ready = gate.split_ready(heads.where("error is null"), o).select("rel", "ready")
    told = _kept(due.join(heads, "rel").join(ready, "rel", "left"))
    texts = _kept(stages.transcribe(sound.join(told.where("ready"), "rel", "left_semi"), transcriber, o.max_px))
    wrong = texts.where("error is not null").groupBy("rel").agg(F.min_by("error", "page_no").alias("page_error"))
    folded = transcript.collect_pages(texts.where("error is null").select("rel", "page_no", "text"), "rel")
    modified = C.iso_seconds(F.timestamp_seconds("mtime"))
    good = (
        told.where("ready").join(wrong, "rel", "left_anti").join(folded, "rel")
        .withColumn("title", F.when(F.lower(C.suffix(F.col("path"))).isin(*BUNDLE_SUFFIXES), C.title(F.col("visible"), C.stem(F.col("path")))).otherwise(C.stem(F.col("path"))))
    )
    named = transcript.name_outputs(good, records, o).withColumn("source_modified", modified)
    body = transcript.with_front_matter(F.col("pages"), F.col("title"), F.col("rel"), o.model, F.col("source_modified"), C.iso_seconds(F.timestamp_seconds(F.lit(now))))
    named = _kept(named.withColumn("transcript", body))
    written = _kept(stages.write_files(named.where("violation is null"), root=o.vault_dir if o.out_alongside else o.output_dir, forbidden=o.forbidden_paths))

    base = {"rel": "rel", "mtime": "mtime", "size": "size", "sha256": "token"}

    def change(rows: DataFrame, **more) -> DataFrame:
        given = {k: F.col(v) for k, v in base.items() if v in rows.columns} | more
        kinds = {part.split()[0]: part.split()[1] for part in state.SCHEMA.split(", ")}
        return rows.select(*(given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in state.COLUMNS))

    failures = [
        told.where("error is not null").select("rel", "mtime", "size", "token", "error"),
        told.join(wrong, "rel").select("rel", "mtime", "size", "token", F.col("page_error").alias("error")),
        named.where("violation is not null").select("rel", "mtime", "size", "token", F.concat(F.lit("output: "), "violation").alias("error")),
        named.join(written.where("error is not null").withColumnRenamed("error", "write_error"), "rel").select("rel", "mtime", "size", "token", F.col("write_error").alias("error")),
    ]
    failed = _kept(reduce(DataFrame.unionAll, failures))
    done = named.join(written.where("error is null").select("rel"), "rel")
    bundle = F.lower(C.suffix(F.col("path"))).isin(*BUNDLE_SUFFIXES, *PAGE_SUFFIXES)
    waiting = told.where("error is null and not ready")
    changes = reduce(DataFrame.unionAll, [
        change(done, source_modified=F.col("source_modified"), out_path=F.col("out_path"), pages=F.col("n_pages"), chars_per_page=F.col("chars_per_page"), processed_at=F.lit(now), status=F.lit("ok"), retries=F.lit(0), render_sha256=F.when(bundle, F.col("render_sha256"))),
        change(failed, status=F.lit("error"), error=F.col("error")),
        change(waiting, status=F.lit("pending_split"), checked_at=F.lit(now)),
        change(touched, status=F.lit("touched")),
    ])
    version = store.commit(state.merge(records, _kept(changes), o.fresh_retries))
    entered = [r.rel for r in waiting.where("s_status is distinct from 'pending_split'").select("rel").orderBy("rel").collect()]
    return PassResult(gates, written.where("error is null").count(), {r.rel: r.error for r in failed.select("rel", "error").collect()}, entered, version)

