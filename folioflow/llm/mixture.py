"""Mixing sources to target weights by Sainte-Lague apportionment."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.runtime import cut, ready, table

WEIGHTS = (5, 2, 1)
#: A document is taken this many times at most.
REPEATS = 3
#: Documents that a shard of a source should hold; a source has as many shards as its documents fill.
SHARD_DOCS = 5000
#: Blocks that the whole mix is cut into, about: the apportionment's resolution.
MIX_BLOCKS = 1 << 20
SEED = 42


def targets(sizes: Sequence[int], weights: Sequence[int], most: int = REPEATS) -> list[Fraction]:
    """Shares of the sum of sizes by weight; no share exceeds ``most`` times its size, and the excess
    goes to the others by weight until none does."""
    out, free, left = [Fraction(0)] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], Fraction(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def sainte_lague(shares: Sequence[Fraction | int], seats: int, limits: Sequence[int]) -> list[int]:
    """Seats by highest quotients share / (2 n + 1), at most ``limits`` each; ties go to the earlier.

    The bulk is given at once: with total T, share * seats / T - 1 seats (rounded down) are always
    below the quotas that the remaining quotients complete one by one.
    """
    total = sum(shares)
    if not total:
        return [0] * len(shares)
    whole = Fraction(seats) / total
    given = [min(limit, max(0, s * whole.numerator // whole.denominator - 1)) for s, limit in zip(shares, limits)]
    heap = [(-Fraction(s) / (2 * g + 1), i) for i, (s, g, limit) in enumerate(zip(shares, given, limits)) if s and g < limit]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < limits[i]:
            heapq.heappush(heap, (-Fraction(shares[i]) / (2 * given[i] + 1), i))
    return given


Key = tuple[pa.Scalar, ...]


def _apportion(key: Key, rows: pa.Table) -> pa.Table:
    """The blocks of one source, dealt to its shards by highest quotients."""
    rows = rows.sort_by("shard")
    words, block, blocks = rows["words"].to_pylist(), rows["block"][0].as_py(), rows["blocks"][0].as_py()
    each = sainte_lague(words, blocks, [REPEATS * w // block for w in words])
    return pa.table({"of_source": rows["source"], "of_shard": rows["shard"], "shard_words": rows["words"], "wanted": pa.array([n * block for n in each], pa.int64())})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, row, size, source_size, target, taken) for each row.

    size is the number of words of the whole text (null: 0). Sources, by code point with null last,
    have ``weights`` in turn and share all words; see ``targets``. The mix consists of blocks of
    equally many words: highest quotients give each source, and then each of its shards, an integer
    number of blocks. A shard's documents are laid out in an order drawn by ``seed`` and cut into blocks
    there; whole rounds over the shard come first and the last round takes the first blocks of the drawn
    order, so a document is taken at most three times over and no source gets more than its target and one
    block. Reruns agree; equal rows are told apart by nothing and may be cut alike. Empty tables give none.

    Collected: one row for each source. Its shards are summed and apportioned in Spark, a source a task.
    """
    spark = ready(docs.sparkSession)
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("row"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
    )
    sized = cut(sized.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "row")))
    by_source = {r.source: (r.words, r.docs) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()}
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [by_source[s][0] for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    # Blocks are small against the mean shard of any source, so that rounding to blocks costs a source half
    # a hundredth at most.
    parts = [max(1, by_source[name][1] // SHARD_DOCS) for name in names]
    block = max(1, min([sum(sizes) // MIX_BLOCKS, *(s // (100 * n) for s, n in zip(sizes, parts) if s)]))
    quota = sainte_lague(goal, int(sum(goal)) // block, [REPEATS * s // block for s in sizes])
    schema = "of_source string, shards int, blocks long, block long, source_size long, target double"
    counts = spark.createDataFrame([(name, n, blocks, block, size, float(target)) for name, n, blocks, size, target in zip(names, parts, quota, sizes, goal)], schema)
    located = sized.join(counts, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("shard", F.pmod("draw", F.col("shards")).cast("int"))
    shards = located.groupBy("source", "shard", "block", "blocks").agg(F.sum("size").alias("words"))
    wanted = shards.groupBy("source").applyInArrow(_apportion, "of_source string, of_shard int, shard_words long, wanted long")
    located = located.join(wanted, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("shard") == F.col("of_shard")))
    order = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "row")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rounds, rest = F.expr("coalesce(wanted div nullif(shard_words, 0), 0)"), F.expr("coalesce(wanted % nullif(shard_words, 0), 0)")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return located.withColumn("taken", taken.cast("long")).select("doc_id", "source", "row", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each document once for every whole time
    that it is taken, and once more up to the word where the shard's last block ends. Equal rows share
    what they take, in whole words."""
    # Equal rows can't be told apart, so they share what they take together.
    got = mix(docs, id_col, text_col, source_col).groupBy("doc_id", "source", "row", "size").agg(F.expr("sum(taken) div count(*)").alias("taken")).where("taken > 0")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    text = F.col(f"d.`{text_col}`")
    key = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("doc_id")) & F.col(f"d.`{source_col}`").cast("string").eqNullSafe(F.col("source")) & (F.xxhash64(text) == F.col("row"))
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    rows = row.join(got, key).withColumn("copy", F.explode(copies))
    rows = rows.withColumn("here", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    # A word with the white space before it, so that the head keeps the text's own spacing.
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("here").cast("int")), "")
    rows = rows.withColumn("new", F.when(F.col("here") < F.col("size"), head).otherwise(text))
    given = {text_col: F.col("new")}
    if "n_chars" in docs.columns:
        given["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(given.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
