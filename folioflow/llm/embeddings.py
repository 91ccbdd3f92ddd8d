"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors that are equal component by component are one point with a count, so a vector that a third
of all rows share is one point. Vectors of each length are compared among themselves. Centroids are fitted
on a bounded sample; every point is then assigned. A cell is one block of points, or several where it is
full, and a block is one row of a checkpointed table, so every point is stored once. A Cartesian product
of that table reads the blocks from there for each pair; no copies of points are shuffled, and what the
query writes grows with the input, whatever cells meet.

Two cells' points can only be linked near the border of both: for a partner at the threshold on the far side
of the border the two dot products differ by at most sin(angle) * |c1 - c2|. That bound is exact and finds
every link. A ``margin`` follows only so many standard deviations of vectors that spread alike in all
dimensions, and loses links of others. Within a block, points near a head are a group with the largest angle to
that head, and two groups are compared only if their heads are no further apart than both angles and the
threshold's together. What is left is decided by products in double precision; links turn into counts and
spanning links at once, pairs aren't listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.components import components
from folioflow.llm.runtime import cut, ready, table

#: Points for the fit of the centroids, at most.
SAMPLE = 20_000
#: Centroids, at most: with 4,096 of 1,024 dimensions a broadcast of 32 MB.
CELLS = 4096
#: Points that a cell should have on average.
CELL_SIZE = 1000
#: Points that one block holds, about.
BLOCK = 4000
#: Bytes of vectors in a partition of blocks, about; a task of the product holds one such partition.
PART = 1 << 26
#: Rows that a product takes at a time, and numbers in a batch of vectors that are compared pair by pair.
ROWS, NUMBERS = 1024, 1 << 22

Key = tuple[pa.Scalar, ...]


def unit_matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column as unit vectors in double precision, and which rows have one.

    Rows that are null, empty, zero, not finite or with a null component have none, and neither have
    rows of another length than most; callers give rows of one length.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    lengths = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    if not n or not lengths.any():
        return np.zeros((n, 1)), np.zeros(n, bool)
    width = int(np.bincount(lengths[lengths > 0]).argmax())
    good = lengths == width
    flat = column.filter(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = np.zeros((n, width))
    x[good] = np.nan_to_num(flat.reshape(-1, width), nan=np.nan, posinf=np.nan, neginf=np.nan)
    good &= np.isfinite(x).all(axis=1)
    x[~good] = 0
    return scaled(x), good & x.any(axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows of zeros stay."""
    peak = np.abs(x).max(axis=1)
    x = x / np.where(peak > 0, peak, 1)[:, None]
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """k unit centroids; empty cells keep their last centroid."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 4096] @ centers.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(own[order]) > 0))
        sums = np.add.reduceat(x[order], starts, axis=0)
        norm = np.linalg.norm(sums, axis=1)
        cells = own[order][starts][norm > 0]
        centers[cells] = (sums / np.where(norm > 0, norm, 1)[:, None])[norm > 0]
    return centers


class Cells:
    """The cells of the vectors of one length: centroids, and the blocks of each cell, numbered from base to last."""

    def __init__(self, centers: np.ndarray, threshold: float, margin: float | None) -> None:
        self.centers = centers
        self.gaps = np.sqrt(np.maximum(0, 2 - 2 * centers @ centers.T)) * np.sqrt(max(0.0, 1 - threshold * threshold))
        if margin is not None:
            self.gaps *= min(1.0, margin / np.sqrt(centers.shape[1]))

    def home(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centers.T).argmax(axis=1)

    def asks(self, x: np.ndarray, cell: int, other: int) -> np.ndarray:
        """Which rows of a cell can have a link into another one."""
        return x @ (self.centers[cell] - self.centers[other]) <= self.gaps[cell, other] + 1e-12

    def deal(self, sample: np.ndarray, n: int, base: int) -> int:
        """Set how many blocks each cell has, by where the sample of n points is; the next base."""
        own = sum((np.bincount(self.home(sample[a : a + 2048]), minlength=len(self.centers)) for a in range(0, len(sample), 2048)), np.zeros(len(self.centers)))
        self.count = np.maximum(1, np.round(own * n / max(1, len(sample)) / BLOCK)).astype(np.int64)
        self.base = base + np.cumsum(self.count) - self.count
        self.last = base + int(self.count.sum()) - 1
        return self.last + 1


def _assign(cells):
    def assign(batches):
        by_width = cells.value
        for batch in batches:
            width, point = batch.column("width").to_numpy(), batch.column("point").to_numpy()
            # So few points of a length that they are one block.
            block, last, cell = -width.astype(np.int64), -width.astype(np.int64), np.full(len(width), -1, np.int32)
            for w in set(np.unique(width).tolist()) & set(by_width):
                of, own = np.flatnonzero(width == w), by_width[w]
                for a in range(0, len(of), 2048):
                    here = of[a : a + 2048]
                    x, _ = unit_matrix(batch.column("embedding").take(pa.array(here)))
                    cell[here] = own.home(x)
                    block[here] = own.base[cell[here]] + point[here] % own.count[cell[here]]
                last[of] = own.last
            made = [pa.array(block), pa.array(last), pa.array(cell), *(batch.column(c) for c in ("width", "point", "size", "embedding"))]
            yield pa.record_batch(made, ["block", "last", "cell", "width", "point", "size", "embedding"])

    return assign


def groups(x: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, angles): rows dealt into groups of those within an angle of the group's first row, and
    the largest angle to it in each group."""
    head = np.full(len(x), -1)
    for a in range(0, len(x), ROWS):
        near = x[a : a + ROWS] @ x.T >= np.cos(angle)
        for i in range(a, min(a + ROWS, len(x))):
            if head[i] < 0:
                head[near[i - a] & (head < 0)] = i
                head[i] = i
    order = np.argsort(head, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(head[order]) > 0))
    least = np.minimum.reduceat((x[order] * x[head[order]]).sum(axis=1), starts)
    return order, starts, np.arccos(np.clip(least, -1, 1))


def _pack(threshold: float, kind: type):
    def pack(key: Key, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("point")
        # A group reaches 0.7 of the threshold's angle; any reach gives the same links.
        order, starts, angles = groups(unit_matrix(rows["embedding"])[0], 0.7 * np.arccos(min(1.0, max(-1.0, threshold))))
        vectors = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)[order]
        kept = {c: rows[c][:1] for c in ("block", "last", "cell", "width")}
        parts = {"points": rows["point"].to_numpy()[order], "sizes": rows["size"].to_numpy()[order], "vectors": vectors.astype(kind), "starts": starts.astype(np.int64), "angles": angles}
        return pa.table(kept | {c: pa.array([x.tobytes()], pa.binary()) for c, x in parts.items()})

    return pack


class Block:
    """A block's row, opened: unit vectors by groups, whose first rows are their heads."""

    def __init__(self, row: dict, prefix: str, kind: type) -> None:
        self.number, self.cell, self.width = (row[prefix + c] for c in ("block", "cell", "width"))
        self.points, self.sizes, self.starts = (np.frombuffer(row[prefix + c], np.int64) for c in ("points", "sizes", "starts"))
        self.angles = np.frombuffer(row[prefix + "angles"])
        self.x = scaled(np.frombuffer(row[prefix + "vectors"], kind).reshape(-1, self.width).astype(float))
        self.counts = np.diff(np.append(self.starts, len(self.x)))

    def heads(self, own: Cells | None, other: Block) -> np.ndarray:
        """The groups that hold a point which can have a link into the other block."""
        if own is None or self.cell == other.cell:
            return np.arange(len(self.starts))
        return np.flatnonzero(np.logical_or.reduceat(own.asks(self.x, self.cell, other.cell), self.starts))


def linked(a: Block, b: Block, own: Cells | None, threshold: float):
    """(row, rows): for rows of one block the linked rows of the other; within one block, later rows only."""
    g, h, same = a.heads(own, b), b.heads(own, a), a.number == b.number
    # cos(t + u + v) = cos(t + u) cos(v) - sin(t + u) sin(v) is two more components of the heads' product.
    reach = np.arccos(min(1.0, max(-1.0, threshold))) + a.angles[g]
    left = np.column_stack([a.x[a.starts[g]], -np.cos(reach), np.sin(reach)]).astype(np.float32)
    right = np.column_stack([b.x[b.starts[h]], np.cos(b.angles[h]), np.sin(b.angles[h])]).astype(np.float32)
    slack, found, total = (a.width + 16) * 2.0**-21, [], 0
    for k in range(0, len(g) if len(h) else 0, ROWS):
        i, j = np.nonzero(left[k : k + ROWS] @ right.T >= -slack)
        found.append((g[k + i], h[j]))
        total += int((a.counts[found[-1][0]] * b.counts[found[-1][1]]).sum())
        if 16 * total > len(a.x) * len(b.x):
            break
    if 16 * total > len(a.x) * len(b.x):
        for k in range(0, len(a.x), ROWS):
            near = a.x[k : k + ROWS] @ b.x.T >= threshold
            if same:
                near &= np.arange(k, k + len(near))[:, None] < np.arange(len(b.x))
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                yield k + i, np.flatnonzero(near[i])
        return
    if not total:
        return
    g, h = (np.concatenate(x) for x in zip(*found))
    each = a.counts[g] * b.counts[h]
    pair = np.repeat(np.arange(len(g)), each)
    at = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
    i, j = a.starts[g][pair] + at // b.counts[h][pair], b.starts[h][pair] + at % b.counts[h][pair]
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, NUMBERS // a.width)
    near = np.concatenate([np.einsum("ij,ij->i", a.x[i[k : k + step]], b.x[j[k : k + step]]) >= threshold for k in range(0, len(i), step)] or [np.zeros(0, bool)])
    i, j = i[near], j[near]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    cuts = np.flatnonzero(np.append(True, np.diff(i) > 0)) if len(i) else np.zeros(0, int)
    yield from zip(i[cuts].tolist(), np.split(j, cuts[1:]))


def _compare(threshold: float, kind: type, cells):
    def told(a: Block, b: Block):
        shift = 0 if a.number == b.number else len(a.x)
        points = a.points if not shift else np.concatenate([a.points, b.points])
        links, label, others = np.zeros(len(points), np.int64), np.arange(len(points)), {}
        for i, hit in linked(a, b, cells.value.get(a.width) if a.cell >= 0 else None, threshold):
            links[i] += b.sizes[hit].sum()
            links[hit + shift] += a.sizes[i]
            roots, first = np.unique(label[hit + shift], return_index=True)
            new = roots != label[i]
            if new.any():
                others[i] = points[hit[first[new]] + shift].tolist()
                label[np.isin(label, roots)] = label[i]
        some = np.flatnonzero(links)
        made = [pa.array(points[some]), pa.array(links[some]), pa.array([others.get(i, []) for i in some.tolist()], pa.list_(pa.int64()))]
        return pa.record_batch(made, ["point", "links", "others"])

    def compare(batches):
        a = None
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if a is None or a.number != row["a_block"]:
                    a = Block(row, "a_", kind)
                yield told(a, a if a.number == row["b_block"] else Block(row, "b_", kind))

    return compare


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, margin: float | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with cosine >= ``threshold`` are linked; vectors of different lengths have none and aren't.
    Null, empty and zero vectors, and those with null or non-finite components link with nothing: their
    component is their own id. Equal vectors are linked to each other. Rows with equal ids count as so many
    vectors; a null id gives a null component unless it links to others. Other columns, labels too, are
    ignored; an empty table gives none.

    Collected: a sample of at most SAMPLE vectors for each length that more than CELL_SIZE vectors have.
    """
    spark = ready(vectors.sparkSession)
    # Vectors travel in the type they are stored in; products are in double precision.
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    values = F.col("embedding")
    sound = values.isNotNull() & (F.size(values) > 0) & F.forall(values, lambda v: F.coalesce((v == v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(values, lambda v: v != 0)
    # Points are known by two hashes of their components, so that rows find theirs without the vectors.
    rows = rows.withColumn("width", F.size("embedding")).withColumn("print", F.when(sound, F.xxhash64("embedding"))).withColumn("point", F.when(sound, F.xxhash64(F.lit(1), "embedding")))
    some = rows.where("print is not null")
    points = some.groupBy("print", "point").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    widths = some.groupBy("width").agg(F.approx_count_distinct("print").alias("n")).where(F.col("n") > CELL_SIZE).orderBy("width").collect()
    alone = rows.where("print is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    cells, base = {}, 0
    for width, n in widths:
        drawn = some.where((F.col("width") == width) & (F.pmod("point", F.lit(max(1, n // SAMPLE))) == 0)).select("print", "point", "embedding").distinct()
        x, _ = unit_matrix(drawn.orderBy("point", "print").limit(SAMPLE).select("embedding").toArrow()["embedding"])
        cells[width] = Cells(spherical_kmeans(x, min(CELLS, n // CELL_SIZE)), threshold, margin)
        base = cells[width].deal(x, n, base)
    known_cells, number = spark.sparkContext.broadcast(cells), np.float32 if kind == "array<float>" else np.float64
    # The vectors are written twice on their way to the blocks, as distinct ones and by block, and once as these.
    dealt = some.groupBy("print", "point", "width", "embedding").agg(F.count("*").alias("size")).select("point", "size", "width", "embedding").mapInArrow(_assign(known_cells), f"block long, last long, cell int, width int, point long, size long, embedding {kind}")
    parts = max(sum(n * width for width, n in widths) * np.dtype(number).itemsize // PART, int(np.sqrt(8 * spark.sparkContext.defaultParallelism))) + 1
    packed = "block long, last long, cell int, width int, " + ", ".join(f"{c} binary" for c in ("points", "sizes", "vectors", "starts", "angles"))
    # However many partitions wrote the blocks, the product has a task for each two of these.
    blocks = cut(dealt.repartition(parts, "block").groupBy("block").applyInArrow(_pack(threshold, number), packed)).coalesce(parts)
    a, b = (blocks.select([F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")
    pairs = a.hint("shuffle_replicate_nl").join(b, F.expr("a_block <= b_block and b_block <= a_last"))
    found = cut(pairs.mapInArrow(_compare(threshold, number, known_cells), "point long, links long, others array<long>"))
    degree = found.groupBy("point").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("point").alias("src"), F.explode("others").alias("dst")).distinct())
    known = (
        points.select("print", "point", "size", "least").join(degree, "point", "left").join(labels.withColumnRenamed("id", "point"), "point", "left")
        .select("print", "point", "least", F.coalesce("component", "point").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    )
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").drop("component", "least")
    told = some.select("vec_id", "print", "point").join(known, ["print", "point"]).select("vec_id", "n_links", "component_id")
    return told.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
