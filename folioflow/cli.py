"""Command line: one pass, the loop, the state's summary, or plain transcripts of given inputs."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import columns as C
from folioflow.operators import stages, state, transcript
from folioflow.operators.backends import ModelClient
from folioflow.operators.readers import renderer
from folioflow.options import Options, check_paths
from folioflow.plans.incremental import rendered_rows, run_pass
from folioflow.sources import files
from folioflow.streaming.loop import Loop


def transcribe_tree(spark: SparkSession, root: str, out: str, renderer, transcriber, max_px: int = 0) -> list[tuple[str, str | None]]:
    """Plain transcripts of a file or of all inputs below a folder, as out/<title>.md. No state is kept,
    equal titles overwrite each other in path order, and what can't be rendered is skipped."""
    single = os.path.isfile(root)
    found = files.list_files(spark, os.path.dirname(os.path.abspath(root)) if single else root).where(C.is_input(F.col("path")))
    if single:
        found = found.where(F.col("path") == os.path.abspath(root))
    pages = rendered_rows(spark, found.select("path", F.col("path").alias("rel")), renderer)
    texts = stages.transcribe(pages.where("error is null"), transcriber, max_px)
    names = pages.where("error is null").groupBy("rel").agg(F.first("title").alias("visible")).withColumn("title", C.safe_title(C.title(F.col("visible"), C.stem(F.col("rel")))))
    whole = transcript.collect_pages(texts.where("error is null").select("rel", "page_no", "text"), "rel").join(names, "rel")
    last = whole.groupBy("title").agg(F.max_by(F.struct("rel", "pages"), F.split("rel", "/")).alias("x")).select("title", "x.*")
    ready = last.withColumn("out_path", F.concat(F.lit(out.rstrip("/") + "/"), "title", F.lit(".md"))).withColumn("transcript", transcript.plain(F.col("pages"), F.col("title")))
    return [(r.rel, r.error) for r in stages.write_files(ready).collect()]


def set_up_logging(state_dir: str, level: str) -> None:
    """Log to the console and to the state folder; a folder that can't be written is a warning."""
    log = logging.getLogger("folioflow")
    log.setLevel(getattr(logging, level.upper(), logging.INFO))
    for handler in list(log.handlers):
        log.removeHandler(handler)
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    try:
        os.makedirs(state_dir, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(state_dir, "folioflow.log")))
    except OSError as e:
        log.warning("no log file in %s: %s", state_dir, e)
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s", "%Y-%m-%dT%H:%M:%S"))
        log.addHandler(handler)


def status_lines(records: DataFrame) -> Iterator[str]:
    """The state's summary and all its problems, by path."""
    c = state.counters(records).first()
    yield f"ok={c['ok']}  error={c['error']}  pending_split={c['pending_split']}  total_pages={c['total_pages']}"
    for r in state.problems(records).toLocalIterator():
        yield f"ERROR    {r.rel}  (retries={r.retries}): {r.error}" if r.status == "error" else f"PENDING  {r.rel}  (waits for a splitter)"


def given_options(args: argparse.Namespace, env: Mapping[str, str]) -> Options:
    """Options from the environment, under those of the command line."""
    named = {k: getattr(args, k) for k in ("model", "model_host", "dpi", "max_px", "cpu", "threads", "timeout", "no_think", "chrome", "pdf_backend", "drawing_backend")}
    return Options.from_env(env).with_(**{k: v for k, v in named.items() if v is not None})


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="folioflow", description=__doc__)
    parser.add_argument("--scan", action="store_true", help="one incremental pass")
    parser.add_argument("--status", action="store_true", help="print the state's summary")
    parser.add_argument("--out", default="ocr_out", help="with an input: folder for plain transcripts")
    parser.add_argument("--model", help="name of the model")
    parser.add_argument("--model-host", help="address of the model's server")
    parser.add_argument("--dpi", type=int, help="dots an inch of page images")
    parser.add_argument("--max-px", type=int, help="pixels that a side of a page image has at most")
    parser.add_argument("--cpu", action=argparse.BooleanOptionalAction, help="keep the model off the GPU")
    parser.add_argument("--threads", type=int, help="threads of the model")
    parser.add_argument("--timeout", type=int, help="seconds that a page may take to answer")
    parser.add_argument("--no-think", action="store_const", const=True, help="ask for the text without reasoning")
    parser.add_argument("--think", dest="no_think", action="store_const", const=False, help="let the model reason")
    parser.add_argument("--chrome", action=argparse.BooleanOptionalAction, help="let the drawing program use a browser")
    parser.add_argument("--pdf-backend", help="auto, none, pdftoppm or a program's path")
    parser.add_argument("--drawing-backend", help="auto, none, rmc or a program's path")
    parser.add_argument("input", nargs="?", help="a file or folder to transcribe without state")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    o = given_options(args, os.environ)
    set_up_logging(o.state_dir, os.environ.get("LOG_LEVEL", "INFO"))
    spark = SparkSession.builder.appName("folioflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.status:
        for line in status_lines(state.StateStore(spark, f"{o.state_dir.rstrip('/')}/manifest").read()):
            print(line)
        return 0
    client = ModelClient(o.model_host, o.model, o.timeout, o.threads, o.no_think, o.cpu)
    pages = renderer(o)
    if args.input:
        failed = [(rel, error) for rel, error in transcribe_tree(spark, args.input, args.out, pages, client, o.max_px) if error]
        for rel, error in failed:
            print(f"FAILED {rel}: {error}")
        return 1 if failed else 0
    check_paths(o)
    if o.model_wait_timeout > 0:
        client.wait_ready(o.model_wait_timeout)
    if args.scan:
        print(run_pass(spark, o, pages, client))
        return 0
    loop = Loop(spark, o, pages, client)
    stop = loop.watch() if o.inotify else None
    try:
        loop.start().awaitTermination()
    finally:
        if stop:
            stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
