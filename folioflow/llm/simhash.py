"""SimHash fingerprints and near-duplicate groups through sharded BK-trees.

A fingerprint within ``radius`` bits of another agrees with it in at least ``agree`` of
``radius + agree`` bit blocks, so fingerprints are dealt into a shard for each choice of blocks and
every link falls inside some shard. A shard's key takes as many bits of its blocks as leave some thousand
fingerprints in a shard; more blocks must agree where one has too few bits. Each shard is a BK-tree, whose
children are keyed by their integer Hamming distance to the parent; a fingerprint descends it along the
edges within the radius of its own distance. Shards travel to tasks by key, as their number and total size
grow with the corpus; a broadcast of all trees would have no proven bound and pass through the driver. A
shard that is too large for a task is cut into parts, and each two parts are a task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.components import components
from folioflow.llm.runtime import cut, ready, table
from folioflow.llm.symbols import U64, Texts, Words, mix

#: Fingerprints that a shard should hold on average, at most, and that are asked at once.
SHARD_SIZE, ASKED = 2048, 256
#: Fingerprints of a shard, and shingles of a group of candidates, that one task holds at most; and large
#: shards or groups whose list is broadcast, at most (a megabyte).
LARGE, LARGE_SETS, LISTED = 1 << 14, 1 << 23, 1 << 16
#: Jaccard similarity of the five-word shingle sets of a link in ``similar_groups``, as a fraction.
SIMILAR = 4, 5
#: Words of a wide fingerprint; the share of differing bits of texts at the similarity limit (a Jaccard
#: similarity of 0.8 is a cosine of 8 / 9, an angle of 0.152 pi); and the differing bits of a candidate,
#: four standard deviations above that share.
WIDE, LIMIT_ANGLE, WIDE_RADIUS = 4, 0.152, 62
#: Fingerprints of a shard that are compared all with all at once, at most.
MATRIX = 1024
#: Shard rows that one Python call holds, about.
CALL_ROWS = 1 << 14

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
Key = tuple[pa.Scalar, ...]


def joined_words(texts: Texts, words: Words) -> tuple[memoryview, np.ndarray]:
    """All words with one space after each, and the place of each in that buffer (and its end)."""
    length = words.end - words.start + 1
    place = np.concatenate([[0], np.cumsum(length)])
    buffer = np.full(int(place[-1]), 0x20, np.uint8)
    inside = np.arange(len(buffer)) - np.repeat(place[:-1], length)
    source = np.repeat(words.start, length) + inside
    letter = inside < np.repeat(length - 1, length)
    buffer[letter] = texts.data[source[letter]]
    return memoryview(buffer), place


def shingle_hashes(view: memoryview, place: np.ndarray, size: int, seed: int) -> np.ndarray:
    """XXH64 of each ``size`` consecutive words, or of all of them if there are fewer."""
    n = len(place) - 1
    if n == 0:
        return np.empty(0, U64)
    k = min(size, n)
    starts, ends = place[: n - k + 1].tolist(), (place[k:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(view[s:e], seed) for s, e in zip(starts, ends)), U64, n - k + 1)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """SimHash of 64 * words bits as signed longs. Words after the first count bits of remixed hashes."""
    out = np.zeros(words, np.int64)
    for w in range(words):
        counts = np.zeros(64, np.int64)
        for a in range(0, len(hashes), 1 << 14):
            part = np.ascontiguousarray(hashes[a : a + (1 << 14)])
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0]
        if w + 1 < words:
            hashes = mix(hashes + U64(0x9E3779B97F4A7C15))
    return out


def _shingled(column: pa.Array, sizes: list[int], seed: int):
    """For each text of a column: the shingle hashes of each size, in the order of the words."""
    texts = Texts.of(column)
    texts = Texts(_LOWER[texts.data], texts.start, texts.end)
    for i, j in texts.blocks(1 << 18):
        lo, hi = texts.start[i], texts.end[j - 1]
        part = Texts(texts.data[lo:hi], texts.start[i:j] - lo, texts.end[i:j] - lo)
        words = Words.of(part)
        view, place = joined_words(part, words)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            yield [shingle_hashes(view, place[a : b + 1], size, seed) for size in sizes]


def _fingerprints(sizes: list[tuple[int, int]], seed: int):
    def run(batches):
        for batch in batches:
            out, nodes = [[] for _ in sizes], []
            for hashes in _shingled(batch.column(1), [size for size, _ in sizes], seed):
                for (_, width), into, h in zip(sizes, out, hashes):
                    if width > 1:
                        h = np.unique(h)
                        nodes.append(xxhash.xxh64_intdigest(h.tobytes(), seed))
                    into.append(fingerprint(h, width))
            columns = [pa.array([int(x[0]) for x in out[0]], pa.int64())]
            columns += [pa.array([x.tolist() for x in more], pa.list_(pa.int64())) for more in out[1:]]
            columns += [pa.array(np.array(nodes, U64).view(np.int64))] * (len(sizes) - 1)
            carried = list(range(2, batch.num_columns))
            names = ["doc_id", "fp", "wide", "node"][: 2 * len(sizes)]
            yield pa.record_batch([batch.column(0), *columns, *(batch.column(k) for k in carried)], names + [batch.schema.names[k] for k in carried])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text, as a signed long. Null or blank text: 0."""
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints([(size, 1)], seed), "doc_id long, fp long")


def shard_keys(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """The block choices for n fingerprints: lists of (shift, bits) whose values are a shard's key."""
    bits, agree = max(0, -(-n // SHARD_SIZE) - 1).bit_length(), 1
    if not bits:
        return [[]]
    while agree < 4 and 64 // (radius + agree) * agree < bits:
        agree += 1
    parts = radius + agree
    edges = [64 * i // parts for i in range(parts + 1)]
    taken = min(64 // parts, -(-bits // agree))
    return [[(edges[i], taken) for i in c] for c in combinations(range(parts), agree)]


def _shard(fp: Column, choice: int, blocks: list[tuple[int, int]]) -> Column:
    values = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << n) - 1) for a, n in blocks]
    return F.xxhash64(F.lit(choice), *values)


class BKTree:
    """BK-tree over distinct fingerprints, in arrays: nodes are numbered level by level, so that a node's
    children stand together in the order of their distances to it."""

    def __init__(self, items: np.ndarray) -> None:
        self.items = items
        node, parent, edge = [], [], []
        left, group, count = np.arange(len(items)), np.zeros(len(items), np.int64), 0
        above, distance = np.array([-1]), np.array([0])
        while len(left):
            # The first member of each group is a node; the others hang below it by their distances.
            lead = np.concatenate([[True], group[1:] != group[:-1]])
            which = np.cumsum(lead) - 1
            node.append(left[lead])
            parent.append(above)
            edge.append(distance)
            rest, which = left[~lead], which[~lead]
            d = np.bitwise_count(items[rest] ^ items[node[-1][which]]).astype(np.int64)
            order = np.argsort(which * 65 + d, kind="stable")
            left, own, d = rest[order], which[order] + count, d[order]
            count += len(node[-1])
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (d[1:] != d[:-1])]) if len(left) else np.empty(0, bool)
            group, above, distance = np.cumsum(new), own[new], d[new]
        self.node, self.depth = np.concatenate([np.empty(0, np.int64), *node]), len(node)
        parent, edge = (np.concatenate([np.empty(0, np.int64), *x]) for x in (parent, edge))
        # Column e of a node: its first child at a distance of e or more.
        asked = (np.arange(count)[:, None] * 66 + np.arange(66)[None]).ravel()
        self.child = (np.searchsorted(parent[1:] * 66 + edge[1:], asked) + 1).astype(np.int32).reshape(count, 66)
        self.visited = 0

    def near(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``asked``, place in the tree's items) of all pairs within the radius."""
        q, at = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        if not len(self.node):
            q = at = np.empty(0, np.int64)
        found = [(q[:0], at[:0])]
        while len(q):
            self.visited += len(q)
            d = np.bitwise_count(asked[q] ^ self.items[self.node[at]]).astype(np.int64)
            hit = d <= radius
            found.append((q[hit], self.node[at[hit]]))
            first = self.child[at, np.maximum(0, d - radius)].astype(np.int64)
            n = self.child[at, np.minimum(64, d + radius) + 1] - first
            q = np.repeat(q, n)
            at = np.arange(len(q)) - np.repeat(np.cumsum(n) - n - first, n)
        a, b = (np.concatenate(x) for x in zip(*found))
        return a, b


def spanning(items: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of places that connect the same distinct fingerprints as all links within the radius do. All
    descend the tree, ASKED at a time; of links between the same two groups so far, one is kept."""
    tree, group, n, out = BKTree(items), np.arange(len(items)), len(items), []
    for a in range(0, n, ASKED):
        q, place = tree.near(items[a : a + ASKED], radius)
        x, y = group[q + a], group[place]
        _, first = np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_index=True)
        first = first[x[first] != y[first]]
        if not len(first):
            continue
        out += zip((q[first] + a).tolist(), place[first].tolist())
        above: dict[int, int] = {}
        for u, v in zip(x[first].tolist(), y[first].tolist()):
            while u in above:
                u = above[u]
            while v in above:
                v = above[v]
            if u != v:
                above[max(u, v)] = min(u, v)
        into = np.arange(n)
        for u in sorted(above):
            into[u] = into[above[u]]
        group = into[group]
    return out


def in_tasks(rows: DataFrame, key: str, item: str, most: int, weight: Column | None = None) -> DataFrame:
    """``rows`` with a ``task`` for those of one key. A key whose rows weigh more than ``most`` is cut into
    parts by ``item``, and each two of its parts are a task, so that any two rows of a key meet in one."""
    total = F.sum(weight if weight is not None else F.lit(1))
    large = cut(rows.groupBy(key).agg(total.alias("total")).where(F.col("total") > most).select(key, F.ceil(F.col("total") * 2 / most).cast("int").alias("parts")))
    n = large.count()
    if not n:
        return rows.withColumn("task", F.xxhash64(key))
    dealt = rows.join(F.broadcast(large) if n <= LISTED else large, key, "left").withColumn("part", F.pmod(F.xxhash64(item), F.coalesce("parts", F.lit(1))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: q != F.col("part"))
    pairs = F.when(F.col("parts").isNull(), F.array(F.xxhash64(key))).otherwise(F.transform(others, lambda q: F.xxhash64(F.col(key), F.least(q, "part"), F.greatest(q, "part"))))
    return dealt.withColumn("task", F.explode(pairs)).drop("parts", "part")


def _runs(task: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order by task, and the [start, end) of each task with several rows."""
    order = np.argsort(task, kind="stable")
    task = task[order]
    edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]])).tolist()
    return order, [(s, e) for s, e in zip(edges, edges[1:]) if e - s > 1]


def _link(radius: int):
    def link(key: Key, rows: pa.Table) -> pa.Table:
        order, runs = _runs(rows["task"].to_numpy())
        fp, a, b = rows["fp"].to_numpy()[order].view(U64), [], []
        for s, e in runs:
            items = fp[s:e]
            pairs = np.array(spanning(items, radius), np.int64).reshape(-1, 2)
            a.append(items[pairs[:, 0]])
            b.append(items[pairs[:, 1]])
        src, dst = (np.concatenate([np.empty(0, U64), *x]).view(np.int64) for x in (a, b))
        return pa.table({"src": src, "dst": dst})

    return link


def near_links(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """(src, dst) pairs of fingerprints that connect all of ``distinct`` (fp) within the radius."""
    keys = shard_keys(n, radius)
    shards = distinct.select("fp", F.explode(F.array(*(_shard(F.col("fp"), i, blocks) for i, blocks in enumerate(keys)))).alias("shard"))
    calls = max(1, n * len(keys) // CALL_ROWS)
    return in_tasks(shards, "shard", "fp", LARGE).groupBy(F.pmod("task", F.lit(calls)).alias("call")).applyInArrow(_link(radius), "src long, dst long").distinct()


def near_groups(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for rows of (doc_id, fp): component_id is the smallest doc_id that
    links of at most ``radius`` differing bits reach. Null ids take part but are never smallest."""
    prints = cut(prints)
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(near_links(distinct, distinct.count(), radius))
    labelled = distinct.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(labelled.select("fp", "component").join(least, "component").drop("component"), "fp").select("doc_id", "fp", "component_id")


def bit_choices(n: int) -> np.ndarray:
    """Which bits of a wide fingerprint make up each key: rows of ascending bit numbers.

    Keys have about log2(n) - 8 bits, so that a few hundred unrelated fingerprints share one, and there
    are so many that texts at the similarity limit share nine on average."""
    bits = int(np.clip(np.log2(max(2, n)) - 8, 4, 24))
    rng = np.random.default_rng(5)
    return np.array([np.sort(rng.choice(64 * WIDE, bits, replace=False)) for _ in range(int(np.ceil(9 / (1 - LIMIT_ANGLE) ** bits)))])


def _wide_keys(choices: np.ndarray):
    weights = (1 << np.arange(choices.shape[1])).astype(np.int64)

    def run(batches):
        for batch in batches:
            node, wide = batch.column(0), batch.column(1)
            w = wide.flatten().to_numpy().reshape(-1, WIDE)
            bits = np.unpackbits(w.view(np.uint8), axis=1, bitorder="little")
            for t, at in enumerate(choices):
                key = bits[:, at].astype(np.int64) @ weights + (t << 32)
                yield pa.record_batch([pa.array(key), node, wide], ["shard", "node", "wide"])

    return run


def wide_spanning(items: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """``spanning`` for wide fingerprints, which are too far apart for a tree to rule out any."""
    words, n = np.ascontiguousarray(items.T), len(items)
    group, out = np.arange(n), []

    def join(i: int, others: np.ndarray) -> None:
        others = others[group[others] != group[i]]
        if len(others):
            joined, first = np.unique(group[others], return_index=True)
            out.extend((i, int(x)) for x in others[first])
            group[np.isin(group, joined)] = group[i]

    if n <= MATRIX:
        far = np.zeros((n, n), np.uint16)
        for w in words:
            far += np.bitwise_count(w[:, None] ^ w[None])
        a, b = np.nonzero(np.triu(far <= radius, 1))
        for i, s in zip(*np.unique(a, return_index=True)):
            join(int(i), b[s : np.searchsorted(a, i, "right")])
        return out
    for i in range(n - 1):
        # What is in a fingerprint's group already isn't asked about again.
        rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        far = np.zeros(len(rest), np.uint16)
        for w in words:
            far += np.bitwise_count(w[rest] ^ w[i])
        join(i, rest[far <= radius])
    return out


def _wide_link(radius: int):
    def link(key: Key, rows: pa.Table) -> pa.Table:
        order, runs = _runs(rows["task"].to_numpy())
        node = rows["node"].to_numpy()[order]
        wide = rows["wide"].combine_chunks().flatten().to_numpy().reshape(-1, WIDE).view(U64)[order]
        src, dst = [], []
        for s, e in runs:
            for x, y in wide_spanning(wide[s:e], radius):
                src.append(int(node[s + x]))
                dst.append(int(node[s + y]))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return link


def _sets(seed: int):
    def run(batches):
        seen = set()
        for batch in batches:
            nodes, rows, sets = batch.column(1).to_pylist(), [], []
            for k, (h,) in enumerate(_shingled(batch.column(2), [5], seed)):
                if nodes[k] not in seen:
                    seen.add(nodes[k])
                    rows.append(k)
                    sets.append(np.unique(h))
            offsets = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([np.empty(0, U64), *sets]).view(np.int64)
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.LargeListArray.from_arrays(offsets, flat).cast(pa.list_(pa.int64()))], ["component", "node", "shingles"])

    return run


def similar_sets(sets: list[np.ndarray]) -> np.ndarray:
    """The group of each set of distinct values: the place of its first member. Links are the pairs whose
    Jaccard similarity is SIMILAR or more; each is decided by the sets, all with all."""
    up, down = SIMILAR
    size, n = np.array([len(x) for x in sets], np.int64), len(sets)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(code, np.cumsum(size)[:-1])
    group, here = np.full(n, -1), np.zeros(int(code.max(initial=-1)) + 1, bool)
    # What has no group yet, and its values side by side; both shrink as groups take members.
    left, flat = np.arange(n), code
    for first in range(n):
        if group[first] >= 0:
            continue
        group[first], queue = first, [first]
        while queue:
            i = queue.pop()
            free = group[left] < 0
            if 2 * free.sum() < len(left):
                left = left[free]
                flat, free = np.concatenate([code[:0], *(own[k] for k in left.tolist())]), np.ones(len(left), bool)
            here[own[i]] = True
            total = np.concatenate([[0], np.cumsum(here[flat])])
            here[own[i]] = False
            end = np.cumsum(size[left])
            both = total[end] - total[end - size[left]]
            near = left[free & (both * down >= (size[left] + size[i] - both) * up)]
            group[near] = first
            queue += near.tolist()
    return group


def _verify(key: Key, rows: pa.Table) -> pa.Table:
    node, first = np.unique(rows["node"].to_numpy(), return_index=True)
    column = rows["shingles"].combine_chunks()
    group = similar_sets([column[k].values.to_numpy(zero_copy_only=False) for k in first.tolist()])
    return pa.table({"node": node, "similar": node[group]})


def _similar(docs: DataFrame, id_col: str, text_col: str, radius: int, wide_radius: int) -> DataFrame:
    """(doc_id, row, component) for each row: row is a hash of its text, component names its group."""
    ready(docs.sparkSession)
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    prints = cut(asked.mapInArrow(_fingerprints([(4, 1), (5, WIDE)], 42), "doc_id long, fp long, wide array<long>, node long, row long"))
    distinct = cut(prints.groupBy("node").agg(F.first("wide").alias("wide"), F.min("row").alias("row")))
    n = distinct.count()
    choices = bit_choices(n)
    keyed = in_tasks(distinct.select("node", "wide").mapInArrow(_wide_keys(choices), "shard long, node long, wide array<long>"), "shard", "node", LARGE)
    wide_links = keyed.groupBy(F.pmod(F.xxhash64("task"), F.lit(max(1, n * len(choices) // CALL_ROWS))).alias("call")).applyInArrow(_wide_link(wide_radius), "src long, dst long")
    # A fingerprint of 64 bits stands beside the nodes that its texts have.
    narrow = cut(prints.select("fp").distinct())
    pairs = prints.select(F.col("fp").alias("src"), F.col("node").alias("dst")).distinct()
    found = components(wide_links.unionAll(near_links(narrow, narrow.count(), radius)).unionAll(pairs))
    joined = cut(distinct.select("node", "row").join(found.withColumnRenamed("id", "node"), "node"))
    several = joined.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    texts = asked.select("row", "text").join(joined.join(several, "component"), "row").select("component", "node", "text")
    sets = cut(texts.mapInArrow(_sets(42), "component long, node long, shingles array<long>"))
    verified = cut(in_tasks(sets, "component", "node", LARGE_SETS, F.size("shingles") + 1).groupBy("task").applyInArrow(_verify, "node long, similar long"))
    # Groups of a component that several tasks share are put together again.
    if verified.count() > verified.select("node").distinct().count():
        verified = components(verified.select(F.col("node").alias("src"), F.col("similar").alias("dst"))).select(F.col("id").alias("node"), F.col("component").alias("similar"))
    return prints.select("doc_id", "row", "node").join(verified, "node", "left").select("doc_id", "row", F.coalesce("similar", "node").alias("component"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, wide_radius: int | None = None) -> DataFrame:
    """(doc_id, component_id) by links between texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more. Every link is decided by the two sets themselves.

    Which texts are held against each other follows from candidates of two kinds: those of ``near_groups``,
    and pairs of 256-bit fingerprints of the sets (at the limit 64 bits are too few to tell a pair from
    chance) that differ in at most ``wide_radius`` bits and share a shard, one for each of several choices
    of bits. A pair at exactly 0.8 differs in 39 bits, with a standard deviation of 6, and shares nine
    shards on average. Texts that candidates connect meet with their whole sets, any two of them in one
    task, and are compared there. Texts with one set of shingles are one node. Null, empty and blank texts
    are one set. Null ids take part but are never smallest; an empty table gives none.
    """
    labelled = _similar(docs, id_col, text_col, radius, WIDE_RADIUS if wide_radius is None else wide_radius)
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "component").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased in A-Z and read as words [^\\x20\\x09-\\x0D]+ in 4-word shingles. Null, empty
    and blank texts have fingerprint zero and link like others. Repeated rows give repeated rows.
    Other columns are ignored; an empty table gives none.
    """
    found = near_groups(fingerprints(docs, id_col, text_col), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each of the ``similar_groups`` of ``docs``, with all its columns: that with the smallest
    id, and of rows with that id one text; a row without an id stays where its group has none with one.
    Of rows with equal ids and texts one stays, whatever their other columns."""
    labelled = cut(_similar(docs, id_col, text_col, 4, WIDE_RADIUS).groupBy("component", "doc_id", "row").agg(F.count("*").alias("n")))
    # Rows of one id and text have one set of shingles, so they are in one group.
    first = labelled.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    out = labelled.join(first, "component").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")))).select(F.col("doc_id").alias("id"), "row")
    key = [F.col(f"d.`{id_col}`").cast("long"), F.xxhash64(F.col(f"d.`{text_col}`"))]
    kept = docs.alias("d").join(out.alias("o"), key[0].eqNullSafe(F.col("o.id")) & (key[1] == F.col("o.row")), "left_anti")
    repeated = cut(labelled.where("n > 1").select(F.col("doc_id").alias("id"), "row"))
    if not repeated.limit(1).count():
        return kept
    same = key[0].eqNullSafe(F.col("r.id")) & (key[1] == F.col("r.row"))
    once = kept.alias("d").join(repeated.alias("r"), same, "left_anti")
    rows = kept.alias("d").join(repeated.alias("r"), same).select(F.col("r.id").alias("id"), F.col("r.row").alias("row"), F.struct(*(F.col(f"d.`{c}`") for c in docs.columns)).alias("doc"))
    return once.unionAll(rows.groupBy("id", "row").agg(F.first("doc").alias("doc")).select("doc.*"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
