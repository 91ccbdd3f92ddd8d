"""Stages of a pass that need Python: rendering, cutting, transcribing, writing files. Each takes and
returns DataFrames; a failure is a row with an error, never a failed task."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import images
from folioflow.operators.backends import Renderer, Transcriber
from folioflow.options import lies_under

RENDERED = "rel string, sha256 string, title string, page_no int, page binary, marker string, max_aspect double, readable boolean, error string"
_RENDERED = pa.schema([("rel", pa.string()), ("sha256", pa.string()), ("title", pa.string()), ("page_no", pa.int32()), ("page", pa.binary()), ("marker", pa.string()), ("max_aspect", pa.float64()), ("readable", pa.bool_()), ("error", pa.string())])


def render(due: DataFrame, renderer: Renderer) -> DataFrame:
    """One row for each page of (rel, sha256, suffix, content), or one with an error and no page."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                base = {"rel": row["rel"], "sha256": row["sha256"]}
                try:
                    got = renderer.render(row["suffix"], row["content"])
                    if not got.pages:
                        raise ValueError("no pages")
                    told = {"title": got.title, "marker": got.marker, "max_aspect": got.max_aspect, "readable": got.max_aspect is not None}
                    rows = [base | told | {"page_no": n, "page": p} for n, p in enumerate(got.pages, 1)]
                except Exception as e:  # one bad file is a row, not the end of the pass
                    rows = [base | {"error": f"render: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, _RENDERED)

    return due.select("rel", "sha256", "suffix", "content").mapInArrow(run, RENDERED)


PROFILES = "rel string, page_no int, width double, height double, profile array<double>, error string"
_PROFILES = pa.schema([("rel", pa.string()), ("page_no", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("profile", pa.list_(pa.float64())), ("error", pa.string())])
CROPPED = "rel string, page_no int, segment long, page binary, error string"
_CROPPED = pa.schema([("rel", pa.string()), ("page_no", pa.int32()), ("segment", pa.int64()), ("page", pa.binary()), ("error", pa.string())])


def profiles(pages: DataFrame, renderer) -> DataFrame:
    """(rel, page_no, width, height, profile, error): a page's size in points and the brightness of its
    pixel rows, or why there is none."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = {"rel": row["rel"], "page_no": row["page_no"]}
                try:
                    width, height, rows = renderer.profile(row["page"])
                    out |= {"width": float(width), "height": float(height), "profile": [float(x) for x in rows]}
                except Exception as e:
                    out["error"] = f"split: {e}"
                yield pa.RecordBatch.from_pylist([out], _PROFILES)

    return pages.select("rel", "page_no", "page").mapInArrow(run, PROFILES)


def crop(pages: DataFrame, renderer) -> DataFrame:
    """(rel, page_no, segment, page, error) of (rel, page_no, segment, top, bottom, page): parts cut out of
    their page; no segment: the page as it is."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = {"rel": row["rel"], "page_no": row["page_no"], "segment": row["segment"] or 0}
                try:
                    out["page"] = row["page"] if row["segment"] is None else renderer.crop(row["page"], row["top"], row["bottom"])
                except Exception as e:
                    out["error"] = f"split: {e}"
                yield pa.RecordBatch.from_pylist([out], _CROPPED)

    return pages.select("rel", "page_no", "segment", "top", "bottom", "page").mapInArrow(run, CROPPED)


def transcribe(pages: DataFrame, transcriber: Transcriber, max_px: int = 0) -> DataFrame:
    """(rel, page_no, text, error). Calls are spread over tasks by page, as each may take minutes. PNG pages
    are shrunk to ``max_px`` pixels a side first (0: not)."""

    def run(batches):
        schema = pa.schema([("rel", pa.string()), ("page_no", pa.int32()), ("text", pa.string()), ("error", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                out = {"rel": row["rel"], "page_no": row["page_no"]}
                try:
                    out["text"] = transcriber.transcribe(images.fit(row["page"], max_px))
                except Exception as e:
                    out["error"] = str(e) or type(e).__name__
                yield pa.RecordBatch.from_pylist([out], schema)

    width = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(width, "rel", "page_no").select("rel", "page_no", "page").mapInArrow(run, "rel string, page_no int, text string, error string")


def write_files(texts: DataFrame, path: str = "out_path", text: str = "transcript", root: str | None = None, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Write each row's text to its path, whole or not at all; (rel, error) for each row.

    Paths are in a file system that driver and executors share. A task that runs again writes the same
    bytes to the same names. With links resolved, a path must lie below ``root`` (if given) and outside of
    the ``forbidden`` folders.
    """

    def run(batches):
        schema = pa.schema([("rel", pa.string()), ("error", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                error, target = None, row["path"]
                staged = f"{target}.{uuid.uuid4().hex}.tmp"
                try:
                    real = os.path.realpath(target)
                    if root is not None and not lies_under(real, os.path.realpath(root)) or any(lies_under(real, os.path.realpath(p)) for p in forbidden):
                        raise OSError(f"output: {real} is outside of where transcripts go")
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(staged, "w", encoding="utf-8", newline="") as f:
                        f.write(row["text"])
                    os.replace(staged, target)
                except OSError as e:
                    error = str(e)
                yield pa.RecordBatch.from_pylist([{"rel": row["rel"], "error": error}], schema)

    return texts.select("rel", F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, "rel string, error string")
