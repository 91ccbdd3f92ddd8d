"""Continuous passes: a timer-driven stream whose batches list the source tree anew.

Spark's file stream never reports a path twice, so it can't see a file that was written again; a
rate source only sets the pace here, and each micro-batch is one incremental pass. File events
(``watch``) bring the next pass forward; those that arrive within a short time or while a pass runs are one
more pass, not one each.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.functions.columns import parse_window
from folioflow.operators.backends import Renderer, Transcriber
from folioflow.options import Options
from folioflow.plans.incremental import PassResult, run_pass
from folioflow.streaming.watch import watcher

log = logging.getLogger("folioflow")


def open_now(window: str, now: float) -> bool:
    """Is the run window open at an epoch second (UTC)?"""
    found = parse_window(window)
    if found is None:
        return True
    minute, (start, end) = int(now % 86400 // 60), found
    return start <= minute <= end if start <= end else minute >= start or minute <= end


@dataclass
class Loop:
    """Passes on a timer. ``results`` holds the last ones; a pass that fails is logged and the loop lives."""

    spark: SparkSession
    options: Options
    renderer: Renderer
    transcriber: Transcriber
    clock: Callable[[], float] = time.time
    keep: int = 100
    results: list[PassResult | Exception] = field(default_factory=list)
    #: One pass at a time, whatever asks for it.
    turn: threading.Lock = field(default_factory=threading.Lock)

    def tick(self) -> PassResult | Exception | None:
        """One pass unless the window is closed; waits for one that runs."""
        with self.turn:
            return self._tick()

    def _tick(self) -> PassResult | Exception | None:
        now = self.clock()
        if not open_now(self.options.run_window, now):
            log.info("outside of the run window %s", self.options.run_window)
            return None
        try:
            got: PassResult | Exception = run_pass(self.spark, self.options, self.renderer, self.transcriber, now)
        except Exception as e:
            log.exception("the pass failed")
            got = e
        self.results = [*self.results[1 - self.keep :], got]
        return got

    def watch(self) -> Callable[[], None] | None:
        """Passes on file events, beside the timer's; returns what ends them, or None without events."""
        woken, end = threading.Event(), threading.Event()
        found = watcher(self.options.source_dir, woken.set)
        if found is None:
            return None

        def passes() -> None:
            while not end.is_set():
                if woken.wait(0.5) and not end.wait(self.options.wake_delay):
                    woken.clear()
                    self.tick()

        thread = threading.Thread(target=passes, name="folioflow-wake", daemon=True)
        thread.start()

        def stop() -> None:
            end.set()
            found.stop()
            thread.join()

        return stop

    def start(self, every: str | None = None) -> StreamingQuery:
        """Run until the returned query is stopped, every ``interval`` seconds by default."""
        pace = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return pace.writeStream.foreachBatch(lambda *_: self.tick() and None).trigger(processingTime=every or f"{self.options.interval} seconds").start()


def wake_ups(events: DataFrame, ts: str, seconds: int) -> DataFrame:
    """(wake, n): the passes that events cause when all events of one interval wake one pass."""
    bucket = F.floor(F.unix_timestamp(ts) / seconds) * seconds
    return events.groupBy(bucket.cast("bigint").alias("wake")).agg(F.count("*").alias("n"))


def cooled_down(events: DataFrame, key: str, ts: str, seconds: int, *ties: str) -> DataFrame:
    """Events with ``deferred``: less than ``seconds``, with their fractions, after the previous one of their key.
    ``ties``: columns that order events of one time, which is left open without them."""
    at = F.unix_micros(ts) / 1e6
    gap = at - F.lag(at).over(Window.partitionBy(key).orderBy(ts, *ties))
    return events.withColumn("deferred", F.coalesce(gap < seconds, F.lit(False)))
