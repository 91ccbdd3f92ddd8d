"""Cutting tall pages at bands of white rows: gaps and islands, a greedy fold, and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Segments of less height (in points) are dropped.
SLIVER = 30
#: Fixed values of the cut rule: shares of the target height that a segment must reach and that the
#: look-ahead may reach, and how much wider a later gap must be to win.
NEAR, FAR, WIDER = 0.7, 1.3, 1.3


def rows_of(profile: DataFrame, key: str, values: str) -> DataFrame:
    """(key, y, brightness): one row for each element of a page's brightness profile."""
    return profile.select(key, F.posexplode(values).alias("y", "brightness"))


def row_mean(pixels: DataFrame, key: str) -> DataFrame:
    return pixels.groupBy(key, "y").agg(F.avg("value").alias("brightness"))


def white_bands(rows: DataFrame, key: str, threshold: float, least: int) -> DataFrame:
    """(key, start, height, y): maximal runs of rows brighter than threshold, of at least ``least`` rows,
    that a darker row ends; y is the middle, where a cut would go. A run at the page's end is none."""
    page = Window.partitionBy(key)
    white = rows.withColumn("last", F.max("y").over(page)).where(F.col("brightness") > threshold)
    island = white.withColumn("island", F.col("y") - F.row_number().over(page.orderBy("y")))
    runs = island.groupBy(key, "island").agg(F.min("y").alias("start"), F.count("*").alias("height"), F.max("y").alias("end"), F.max("last").alias("last"))
    closed = runs.where((F.col("end") < F.col("last")) & (F.col("height") >= least))
    return closed.select(key, F.col("start").cast("bigint"), F.col("height").cast("bigint"), (F.col("start") + F.floor(F.col("height") / 2)).cast("bigint").alias("y"))


def greedy_cuts(gaps: Column, target: int) -> Column:
    """Cuts of a page from its gaps, an array<struct<y, gap>>: a fold from the top. A gap far enough
    below the last cut is taken, or in its place the first later gap within reach that is clearly wider."""
    ordered = F.array_sort(gaps)
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("cuts"))

    def step(acc: Column, gap: Column) -> Column:
        better = F.filter(ordered, lambda f: (f["y"] > gap["y"]) & (f["y"] - acc["last"] <= FAR * target) & (f["gap"] > WIDER * gap["gap"]))
        chosen = F.coalesce(F.get(better, F.lit(0))["y"], gap["y"]).cast("bigint")
        taken = F.struct(chosen.alias("last"), F.concat(acc["cuts"], F.array(chosen)).alias("cuts"))
        return F.when(gap["y"] - acc["last"] >= NEAR * target, taken).otherwise(acc)

    return F.aggregate(ordered, start, step, lambda acc: acc["cuts"])


def cuts(bands: DataFrame, key: str, target: int) -> DataFrame:
    """(key, cuts) for pages that have bands."""
    gaps = bands.groupBy(key).agg(F.collect_list(F.struct("y", F.col("height").alias("gap"))).alias("gaps"))
    return gaps.select(key, greedy_cuts(F.col("gaps"), target).alias("cuts"))


def segments(pages: DataFrame, key: str, least: float = SLIVER) -> DataFrame:
    """(key, segment, top, bottom) in points from the page's foot, for pages with cuts, image_height and
    page_height. Segments are numbered from the top after slivers are dropped."""
    point = F.col("page_height") - F.col("cut") * (F.col("page_height") / F.col("image_height"))
    edges = pages.select(key, "page_height", "image_height", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), "cuts", F.array(F.col("image_height").cast("bigint")))).alias("cut")).select(key, point.alias("edge"))
    down = Window.partitionBy(key).orderBy(F.desc("edge"))
    pairs = edges.select(key, F.col("edge").alias("top"), F.lead("edge").over(down).alias("bottom")).where(F.col("bottom").isNotNull() & (F.col("top") - F.col("bottom") >= least))
    return pairs.select(key, F.row_number().over(Window.partitionBy(key).orderBy(F.desc("top"))).cast("bigint").alias("segment"), "top", "bottom")
