"""The exchange behind substring dedup (bytes) and passage dedup (words): which runs of ``window``
symbols also start in a document with a smaller id.

A trigger is a gram whose smallest small gram, by hash, is its first or its last one. That is a property
of the gram alone, so triggers cut equal texts in the same way wherever they stand, and each run of
``window`` symbols holds a whole trigger. A run belongs to its first trigger: it is known by that trigger,
the symbols before it (fewer than to the trigger before) and those after it.

1. Documents are dealt into chunks by id (one shuffle of the text, which all rounds reuse). Each
   chunk sends the hashes of its distinct triggers, sorted and delta-coded.
2. Per range of trigger hashes: those found in two documents go back to their chunks.
3. Each chunk sends the distinct surroundings of these triggers: what its runs hold before and after.
4. Per range: ``compare`` says which runs of each row an earlier document holds. One bit for each run
   goes back.
5. Each chunk turns these into covered symbols.

A key that a third of all documents share is sent once by each chunk, never once by each document.
Whole-text copies are found by a 120-bit digest in rounds 1 and 2 and send nothing in round 3. A trigger
that HOT chunks share is told apart by the symbols around it as well, so that its surroundings are dealt
to several ranges. Chunks and ranges are both of bounded size; both grow with the root of the corpus, so
that the rows between them grow in proportion to it. A chunk is read in slices, and what a slice repeats
is kept once, so one long repetitive text needs little more than itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.runtime import ready, text_bytes
from folioflow.llm.symbols import U64, Texts, mix, slide

#: Bytes of text in a chunk and behind a range of triggers, about, for corpora of up to SIZED bytes; and
#: how many times more, at most, for larger ones.
CHUNK_BYTES, RANGE_BYTES, SIZED, GROWTH = 4 << 20, 8 << 20, 30 << 30, 16
#: Chunks that share a trigger for it to be told apart by its surroundings, and into how many parts.
HOT, PARTS = 16, 3
#: Symbols of a slice, rows compared at once, and triggers of a chunk that are remembered for round 5.
SLICE, COMPARED, REMEMBERED = 1 << 17, 1 << 16, 1 << 22

_ROWS = "bucket long, chunk long, kind int, body binary"
Key = tuple[pa.Scalar, ...]
TRIGGERS, TWICE, COPIES, HOT_TWICE, MARKS = range(5)


@dataclass(frozen=True)
class Shape:
    """window: symbols of a run; gram: of a trigger; small: of the grams that decide on triggers."""

    window: int
    small: int

    def __post_init__(self) -> None:
        if not 1 <= self.small <= self.gram <= self.window or self.reach > 60:
            raise ValueError(f"no triggers for windows of {self.window} symbols")

    @property
    def gram(self) -> int:
        return (self.window + 1 + self.small) // 2

    @property
    def reach(self) -> int:
        """Symbols of a run beside its trigger."""
        return self.window - self.gram

    @property
    def most(self) -> int:
        """Symbols of a run before its first trigger, at most."""
        return min(self.reach, max(0, self.gram - self.small - 1))

    @property
    def width(self) -> int:
        """Columns of a row: first and last number of symbols before the trigger, symbols before it
        (nearest first), symbols after it, and zeros up to a multiple of eight."""
        return -(-(2 + self.most + self.reach) // 8) * 8


@dataclass(frozen=True)
class Repeats:
    """symbols(texts, shape): a chunk's symbols, with ``first`` (text i has symbols first[i]:first[i + 1]),
    order(lo, hi), trigger(at) and take(at). compare(key, ids, rows, shape): for rows in order of their
    keys, bit l of each: the run that begins l symbols before the trigger is held by an earlier document."""

    shape: Shape
    dtype: type
    symbols: Callable
    compare: Callable
    pack: Callable
    unpack: Callable


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as zstd-compressed byte planes of their differences."""
    step = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(len(step), -1).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack_sorted(body: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(body[:8], "little"), np.dtype(dtype).itemsize
    raw = pa.decompress(body[8:], n * width, "zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(width, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype)[:, 0], dtype=dtype)


def squeeze(array: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(array).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def expand(body: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True), dtype)


def _rows(rows: list[tuple]) -> pa.Table:
    bucket, chunk, kind, body = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "chunk": pa.array(chunk, pa.int64()), "kind": pa.array(kind, pa.int32()), "body": pa.array(body, pa.binary())})


def row_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of a matrix whose rows are whole 64-bit words."""
    words = np.ascontiguousarray(rows).view(U64)
    coef = np.random.default_rng(7).integers(0, 1 << 63, words.shape[1], dtype=np.uint64) * U64(2) + U64(1)
    out = np.empty(len(words), U64)
    for a in range(0, len(words), 1 << 14):
        out[a : a + (1 << 14)] = (mix(words[a : a + (1 << 14)] + coef) * coef).sum(axis=1, dtype=U64)
    return out


def groups(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


class Chunk:
    """What every round derives anew, in the same way, from a chunk's texts."""

    def __init__(self, table: pa.Table, spec: Repeats, bits: int) -> None:
        table = table.sort_by([("id", "ascending"), ("row", "ascending")])
        self.spec, self.shape, self.bits = spec, spec.shape, bits
        self.ids = table["id"].to_numpy(zero_copy_only=False)
        self.texts = Texts.of(table["text"])
        self.seq = spec.symbols(self.texts, spec.shape)
        self.first = self.seq.first
        self.long = np.diff(self.first) >= self.shape.window
        data = memoryview(self.texts.data)
        self.digests = np.array([int.from_bytes(xxhash.xxh3_128_digest(data[s:e]), "little") & ((1 << 120) - 1) for s, e in zip(self.texts.start.tolist(), self.texts.end.tolist())], object)

    def triggers(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Per slice, the triggers that are the first of some run: place, hash, text number, and how many
        symbols such runs have before the trigger, at least and at most."""
        s, n = self.shape, int(self.first[-1])
        for a in range(0, n, SLICE):
            lo, hi = max(0, a - s.gram), min(n, a + SLICE + s.gram)
            if hi - lo < s.gram:
                continue
            order = self.seq.order(lo, hi)
            least = slide(order, s.gram - s.small + 1, np.minimum)
            at = lo + np.flatnonzero((order[: len(least)] == least) | (order[s.gram - s.small :] == least))
            of = np.searchsorted(self.first, at, "right") - 1
            whole = self.long[of] & (at + s.gram <= self.first[of + 1])
            at, of = at[whole], of[whole]
            before = at - self.first[of]
            if len(at) > 1:
                np.minimum(before[1:], np.where(of[1:] == of[:-1], at[1:] - at[:-1] - 1, before[1:]), out=before[1:])
            most = np.minimum(before, s.most)
            least = np.maximum(0, s.reach - (self.first[of + 1] - at - s.gram))
            here = (at >= a) & (at < a + SLICE) & (least <= most)
            at = at[here]
            yield at, self.seq.trigger(at), of[here], least[here], most[here]

    def short(self, h: np.ndarray) -> np.ndarray:
        """Range number and the next 32 bits."""
        return h >> U64(32 - self.bits)

    def first_of_digest(self) -> dict[int, int]:
        """The smallest id of each digest among the chunk's texts that hold a run."""
        out: dict[int, int] = {}
        for i in np.flatnonzero(self.long).tolist():
            out.setdefault(self.digests[i], int(self.ids[i]))
        return out

    def known(self, back: pa.Table | None) -> None:
        """Take in the shared triggers of this chunk (short hashes), which are hot, and which texts are copies."""
        shared, hot, firsts = [np.empty(0, U64)], [np.empty(0, U64)], self.first_of_digest()
        for bucket, kind, body in zip(*(back[c].to_pylist() for c in ("bucket", "kind", "body"))) if back is not None else ():
            if kind in (TWICE, HOT_TWICE):
                (shared if kind == TWICE else hot).append(unpack_sorted(body, np.uint32).astype(U64) + (U64(bucket) << U64(32)))
            elif kind == COPIES:
                for lo, hi, first in expand(body, U64).reshape(-1, 3).tolist():
                    firsts[lo | hi << 64] = int(np.uint64(first).astype(np.int64))
        self.hot = np.sort(np.concatenate(hot))
        self.shared = np.sort(np.concatenate([*shared, self.hot]))
        self.copies = np.array([firsts.get(d, i) < i for d, i in zip(self.digests.tolist(), self.ids.tolist())], bool)

    def _around(self, at: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        s = self.shape
        out = np.zeros((len(at), s.width), self.spec.dtype)
        out[:, 0], out[:, 1] = least, most
        for a in range(0, len(at), 1 << 14):
            p = slice(a, a + (1 << 14))
            j = np.arange(s.most)
            out[p, 2 : 2 + s.most] = self.seq.take(at[p, None] - 1 - j) * (j < most[p, None])
            j = np.arange(s.reach)
            out[p, 2 + s.most : 2 + s.most + s.reach] = self.seq.take(at[p, None] + s.gram + j) * (j < s.reach - least[p, None])
        return out

    def occurrences(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Per slice, the shared triggers of texts that are no copies: place, text number, key, hash, row."""
        for at, h, of, least, most in self.triggers():
            t = self.short(h)
            place = np.searchsorted(self.shared, t)
            place[place == len(self.shared)] = 0
            ok = ~self.copies[of] & (self.shared[place] == t) if len(self.shared) else np.zeros(len(at), bool)
            at, h, of = at[ok], h[ok], of[ok]
            rows = self._around(at, least[ok], most[ok])
            yield at, of, mix(h ^ row_hash(rows)), h, rows

    def entries(self) -> None:
        """The distinct surroundings (key, hash, smallest id, row), in order of their keys."""
        self.remembered: list | None = []
        parts, pending, seen = [], 0, 0

        def merged(parts):
            key, h, ids, rows = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids, key))
            lead = order[groups(key[order])]
            return key[lead], h[lead], ids[lead], rows[lead]

        empty = (np.empty(0, U64), np.empty(0, U64), np.empty(0, np.int64), np.empty((0, self.shape.width), self.spec.dtype))
        for at, of, key, h, rows in self.occurrences():
            parts.append(merged([(key, h, self.ids[of], rows)]) if len(key) else empty)
            pending += len(parts[-1][0])
            seen += len(key)
            if self.remembered is not None:
                self.remembered = [*self.remembered, (at, of, key)] if seen <= REMEMBERED else None
            if pending > 4 * max(SLICE, len(parts[0][0])):
                parts = [merged(parts)]
                pending = len(parts[0][0])
        self.key, self.h, self.least, self.around = merged(parts) if parts else empty

    def sent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which entry each sent row stands for, its key (the trigger's hash or, where that is hot, one of a
        part of the runs with the symbols that these share), and the row; in order of the keys."""
        s, n = self.shape, len(self.key)
        hot = np.isin(self.short(self.h), self.hot)
        entry, key, rows = [np.flatnonzero(~hot)], [self.h[~hot]], [self.around[~hot]]
        edges = [(s.most + 1) * i // PARTS for i in range(PARTS + 1)]
        for a, b in zip(edges, edges[1:]):
            here = np.flatnonzero(hot & (self.around[:, 0] < b) & (self.around[:, 1] >= a)) if n else np.empty(0, np.int64)
            if b > a and len(here):
                part = self.around[here].copy()
                part[:, 0], part[:, 1] = np.maximum(part[:, 0], a), np.minimum(part[:, 1], b - 1)
                shared = part.copy()
                shared[:, 0], shared[:, 1] = a, b
                shared[:, 2 + a : 2 + s.most] = 0
                shared[:, 2 + s.most + s.reach - (b - 1) :] = 0
                entry.append(here)
                key.append(mix(self.h[here] ^ row_hash(shared)))
                rows.append(part)
        entry, key, rows = (np.concatenate(x) for x in (entry, key, rows))
        order = np.lexsort((entry, key))
        return entry[order], key[order], rows[order]


def _send(spec: Repeats, bits: int):
    def send(key: Key, table: pa.Table) -> pa.Table:
        chunk, c = key[0].as_py(), Chunk(table, spec, bits)
        parts, pending = [], 0

        def merged(parts):
            t, low, high = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(t, kind="stable")
            t, at = t[order], groups(t[order])
            return t[at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)

        for _, h, of, _, _ in c.triggers():
            if len(h):
                parts.append(merged([(c.short(h), c.ids[of], c.ids[of])]))
                pending += len(parts[-1][0])
            if parts and pending > 4 * max(SLICE, len(parts[0][0])):
                parts = [merged(parts)]
                pending = len(parts[0][0])
        t, low, high = merged(parts) if parts else (np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64))
        rows = []
        for kind, part in ((TRIGGERS, t[low == high]), (TWICE, t[low != high])):
            cuts = np.searchsorted(part, np.arange((1 << bits) + 1, dtype=U64) << U64(32))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                rows.append((b, chunk, kind, pack_sorted((part[cuts[b] : cuts[b + 1]] & U64(0xFFFFFFFF)).astype(np.uint32))))
        by_bucket: dict[int, list] = {}
        for d, i in c.first_of_digest().items():
            by_bucket.setdefault(d & ((1 << bits) - 1), []).append((d & (2**64 - 1), d >> 64, i & (2**64 - 1)))
        rows += [(b, chunk, COPIES, squeeze(np.array(x, U64))) for b, x in by_bucket.items()]
        return _rows(rows)

    return send


def _copies(bodies: list[bytes]) -> list[np.ndarray]:
    """Of each body of (digest, id), the entries whose digest another one has too, with the smallest id."""
    parts = [expand(b, U64).reshape(-1, 3) for b in bodies]
    every = np.concatenate(parts)
    ids = np.ascontiguousarray(every[:, 2]).view(np.int64)
    order = np.lexsort((ids, every[:, 0], every[:, 1]))
    lead = np.concatenate([[True], (every[order][1:, :2] != every[order][:-1, :2]).any(axis=1)])
    group = np.cumsum(lead) - 1
    out = every.copy()
    out[order, 2] = every[order[lead], 2][group]
    several = np.empty(len(every), bool)
    several[order] = np.bincount(group)[group] > 1
    cuts = np.cumsum([0, *map(len, parts)])
    return [out[a:b][several[a:b]] for a, b in zip(cuts, cuts[1:])]


def _match(key: Key, table: pa.Table) -> pa.Table:
    """Per range: which triggers occur in two documents, and the first document of each digest."""
    bucket, rows = key[0].as_py(), []
    chunks, kinds, bodies = (table[c].to_pylist() for c in ("chunk", "kind", "body"))
    copies = [(c, b) for c, k, b in zip(chunks, kinds, bodies) if k == COPIES]
    for (chunk, _), found in zip(copies, _copies([b for _, b in copies]) if copies else ()):
        if len(found):
            rows.append((bucket, chunk, COPIES, squeeze(found)))
    values = [(c, k, unpack_sorted(b, np.uint32)) for c, k, b in zip(chunks, kinds, bodies) if k != COPIES]
    every = np.sort(np.concatenate([np.empty(0, np.uint32), *(v for _, _, v in values)]))
    at = groups(every)
    known, n = every[at], np.diff(np.append(at, len(every)))
    twice = np.isin(known, np.concatenate([np.empty(0, np.uint32), *(v for _, k, v in values if k == TWICE)]))
    kind = np.where(n >= HOT, 2, ((n > 1) | twice).astype(int))
    for chunk, _, v in values:
        here = kind[np.searchsorted(known, v)]
        for want, name in ((1, TWICE), (2, HOT_TWICE)):
            if (here == want).any():
                rows.append((bucket, chunk, name, pack_sorted(v[here == want])))
    return _rows(rows)


def _surround(spec: Repeats, bits: int):
    def surround(key: Key, table: pa.Table, back: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        if not table.num_rows:
            return _rows([])
        c = Chunk(table, spec, bits)
        c.known(back)
        c.entries()
        entry, h, around = c.sent()
        ids, rows = c.least[entry], []
        cuts = np.searchsorted(h >> U64(64 - bits) if bits else np.zeros(len(h), U64), np.arange((1 << bits) + 1, dtype=U64))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            p = slice(cuts[b], cuts[b + 1])
            parts = [pack_sorted(h[p]), squeeze(ids[p]), spec.pack(around[p])]
            rows.append((b, chunk, TRIGGERS, np.array([len(parts[0]), len(parts[1])], np.int64).tobytes() + b"".join(parts)))
        return _rows(rows)

    return surround


def _mark(spec: Repeats):
    def mark(key: Key, table: pa.Table) -> pa.Table:
        chunks, hs, ids, around = table["chunk"].to_pylist(), [], [], []
        for body in table["body"].to_pylist():
            a, b = np.frombuffer(body[:16], np.int64).tolist()
            hs.append(unpack_sorted(body[16 : 16 + a], U64))
            ids.append(expand(body[16 + a : 16 + a + b], np.int64))
            around.append(spec.unpack(body[16 + a + b :], spec.shape.width))
        cuts = np.cumsum([0, *map(len, hs)])
        h, ids, around = np.concatenate(hs), np.concatenate(ids), np.concatenate(around)
        order = np.lexsort((ids, h))
        sorted_h = h[order]
        at = groups(sorted_h)
        # A trigger that one document alone has here can't make a repeat.
        size = np.diff(np.append(at, len(h)))
        order = order[np.repeat(size > 1, size)]
        sorted_h = h[order]
        edges = np.append(groups(sorted_h), len(sorted_h))
        marks, a = np.zeros(len(h), U64), 0
        while a < len(sorted_h):
            b = int(edges[max(np.searchsorted(edges, a + COMPARED, "right") - 1, np.searchsorted(edges, a, "right"))])
            part = order[a:b]
            marks[part] = spec.compare(sorted_h[a:b], ids[part], around[part], spec.shape)
            a = b
        return _rows([(key[0].as_py(), c, MARKS, squeeze(marks[cuts[n] : cuts[n + 1]])) for n, c in enumerate(chunks)])

    return mark


def _cover(spec: Repeats, bits: int, finish):
    def cover(key: Key, table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return finish.empty
        c = Chunk(table, spec, bits)
        c.known(back)
        c.entries()
        entry, _, _ = c.sent()
        found = sorted((b, body) for b, kind, body in zip(*(back[x].to_pylist() for x in ("bucket", "kind", "body"))) if kind == MARKS)
        marks = np.zeros(len(c.key), U64)
        np.bitwise_or.at(marks, entry, np.concatenate([np.empty(0, U64), *(expand(body, U64) for _, body in found)]))
        n, window = int(c.first[-1]), spec.shape.window
        begins = np.zeros(n, bool)
        for at, of, k in c.remembered if c.remembered is not None else ((at, of, k) for at, of, k, _, _ in c.occurrences()):
            group = np.searchsorted(c.key, k)
            runs = marks[group]
            # Runs of a row whose surroundings an earlier text of this chunk has, too.
            least, most = (c.around[group, x].astype(U64) for x in (0, 1))
            within = ((U64(2) << most) - U64(1)) & ~((U64(1) << least) - U64(1))
            runs = np.where(c.ids[of] != c.least[group], within, runs)
            for l in range(spec.shape.most + 1):
                begins[at[(runs >> U64(l)) & U64(1) == 1] - l] = True
        covered = np.empty(n, bool)
        for a in range(0, n, SLICE):
            lo, hi = max(0, a - window + 1), min(n, a + SLICE)
            total = np.concatenate([[0], np.cumsum(begins[lo:hi])])
            ends = np.arange(a, hi) - lo + 1
            covered[a:hi] = total[ends] > total[np.maximum(0, ends - window)]
        for i in np.flatnonzero(c.copies & c.long).tolist():
            covered[c.first[i] : c.first[i + 1]] = True
        return finish(c, covered)

    return cover


def find_repeats(docs: DataFrame, id_col: str, text_col: str, spec: Repeats, finish) -> DataFrame:
    """Rows of ``finish(chunk, covered)`` for each chunk of ``docs``; finish.schema and finish.empty give
    the result's form. Rows with a null id are outside of the comparison: the caller handles them.
    """
    spark = ready(docs.sparkSession)
    total = text_bytes(docs, text_col)
    growth = min(GROWTH, max(1.0, (total / SIZED) ** 0.5))
    chunks = max(1, int(-(-total // (CHUNK_BYTES * growth))))
    bits = (max(1, int(-(-total // (RANGE_BYTES * growth)))) - 1).bit_length()
    dealt = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row")
    ).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    by_chunk = dealt.groupBy("chunk")
    sent = by_chunk.applyInArrow(_send(spec, bits), _ROWS)
    matched = sent.groupBy("bucket").applyInArrow(_match, _ROWS)
    around = by_chunk.cogroup(matched.groupBy("chunk")).applyInArrow(_surround(spec, bits), _ROWS)
    marked = around.groupBy("bucket").applyInArrow(_mark(spec), _ROWS)
    back = matched.unionAll(marked)
    return by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(_cover(spec, bits, finish), finish.schema)
