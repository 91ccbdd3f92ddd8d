"""Exact substring dedup over UTF-8 bytes by prefix-free parsing.

Rolling-hash triggers (``repeats``) cut every text into phrases, each from one trigger to the end of the
next. As a trigger is known by its own bytes, no proper phrase suffix that is longer than a trigger is a
prefix of another (the phrases are prefix-free), so suffixes of the corpus compare by their phrase suffix
first and then by what follows in the parse. The dictionary holds the distinct phrases that end in a
trigger which two documents share, the parse what follows each of them. Both are dealt into ranges by the
trigger that ends the phrase, as all suffixes that share 50 bytes do also share their first trigger.

In a range, the suffix array of the dictionary (phrases by their ends, so that the phrase suffixes of each
length are neighbours) and that of the parse (what follows, as deep as 50 bytes reach) are sorted with
their common prefixes. The two combine into corpus order: by phrase suffix, then by rank in the parse.
Repeats are the neighbours in that order that have 50 bytes in common.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.repeats import Repeats, Shape, expand, find_repeats, squeeze
from folioflow.llm.runtime import table
from folioflow.llm.symbols import RADIX, U64, Texts, mix

#: Bytes of the grams that decide on triggers.
SMALL = 8


class Bytes:
    """The bytes of a chunk's texts, read as 64-bit words from any place on."""

    def __init__(self, texts: Texts, shape: Shape) -> None:
        self.shape, self.first = shape, np.append(texts.start, len(texts.data))
        self.data = np.concatenate([texts.data, np.zeros(8, np.uint8)])
        self.words = np.ndarray(len(texts.data) + 1, "<u8", self.data, strides=(1,))

    def order(self, lo: int, hi: int) -> np.ndarray:
        s = self.shape.small
        return (mix((self.words[lo : hi - s + 1] << U64(64 - 8 * s)) * RADIX) >> U64(32)).astype(np.uint32)

    def trigger(self, at: np.ndarray) -> np.ndarray:
        gram, h = self.shape.gram, np.zeros(len(at), U64)
        for j in range(0, gram, 8):
            n = min(8, gram - j)
            h = mix((h ^ (self.words[at + j] << U64(64 - 8 * n))) * RADIX + U64(j + 1))
        return h

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.data[np.clip(at, 0, len(self.data) - 1)]


def _sorted(owner: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by owner and symbols, and what each has in common with the one before it in
    that order (-1: another owner)."""
    n, wide = symbols.shape
    padded = np.zeros((n, -(-wide // 8) * 8), np.uint8)
    padded[:, :wide] = symbols
    words = padded.view(">u8").astype(U64)
    order = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), owner))
    there, own = symbols[order], owner[order]
    differs = np.concatenate([there[1:] != there[:-1], np.ones((max(0, n - 1), 1), bool)], axis=1)
    common = np.full(n, -1, np.int64)
    common[1:] = np.where(own[1:] == own[:-1], differs.argmax(axis=1), -1)
    return order, common


def corpus_order(key: np.ndarray, ids: np.ndarray, rows: np.ndarray, shape: Shape) -> np.ndarray:
    """Bit l of each row: the 50 bytes from l bytes before its trigger are held by an earlier document."""
    n = len(key)
    owner = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    least, most = rows[:, 0], rows[:, 1]
    after, follows = _sorted(owner, rows[:, 2 + shape.most : 2 + shape.most + shape.reach])
    phrases, ends = _sorted(owner, rows[:, 2 : 2 + shape.most])
    rank, out = np.empty(n, np.int64), np.zeros(n, U64)
    rank[after] = np.arange(n)
    for l in range(shape.most + 1):
        # Rows with a phrase suffix of l bytes before the trigger, the suffix's number, and which of the
        # parse's suffixes agree as far as 50 bytes reach.
        here = np.flatnonzero((least <= l) & (l <= most))
        if len(here) < 2:
            continue
        suffix, agree = np.empty(n, np.int64), np.empty(n, np.int64)
        suffix[phrases] = np.cumsum(ends < l)
        agree[after] = np.cumsum(follows < shape.reach - l)
        place = here[np.argsort(suffix[here] * n + rank[here])]
        new = np.concatenate([[True], (suffix[place][1:] != suffix[place][:-1]) | (agree[place][1:] != agree[place][:-1])])
        first = np.minimum.reduceat(ids[place], np.flatnonzero(new))[np.cumsum(new) - 1]
        out[place[first < ids[place]]] |= U64(1) << U64(l)
    return out


def _pack(rows: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(rows.T))


def _unpack(body: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(expand(body, np.uint8).reshape(width, -1).T)


class _Finish:
    def __init__(self, spans: bool) -> None:
        self.fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        self.spans = spans
        if spans:
            self.fields += [("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())]
        self.schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept binary" * spans
        self.empty = pa.schema(self.fields).empty_table()

    def __call__(self, c, covered: np.ndarray) -> pa.Table:
        data, out = c.texts.data, []
        for i, (s, e) in enumerate(zip(c.texts.start.tolist(), c.texts.end.tolist())):
            hit = covered[s:e]
            removed = int(hit.sum())
            kept = data[s:e][~hit].tobytes() if removed else data[s:e].tobytes()
            turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))) if removed else np.empty(0, int)
            row = [int(c.ids[i]), e - s, removed, len(turns) // 2, hashlib.sha256(kept).hexdigest()]
            out.append([*row, turns.reshape(-1, 2).tolist(), kept] if self.spans else row)
        return pa.table(dict(zip([f for f, _ in self.fields], (pa.array(x, t) for x, (_, t) in zip(zip(*out), self.fields))))) if out else self.empty


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, spans: bool = False) -> DataFrame:
    """Remove each byte that a ``window``-byte string covers which also starts in a document with a
    smaller id; strings are judged on the input and don't cross documents.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``spans`` the removed
    [start, end) byte ranges and the kept bytes. Null text is empty; texts shorter than the window
    are kept whole. Rows with equal ids don't remove each other's bytes; a null id has no order, so
    such rows are kept whole and remove nothing. Other columns are ignored. An empty table gives none.
    ``window``: 2 to 100 bytes.
    """
    spec = Repeats(Shape(window, min(SMALL, max(1, window // 4))), np.uint8, Bytes, corpus_order, _pack, _unpack)
    out = find_repeats(docs.where(F.col(id_col).isNotNull()), id_col, text_col, spec, _Finish(spans))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
        *([F.array().cast("array<array<long>>").alias("spans"), text.cast("binary").alias("kept")] if spans else []),
    )
    return out.unionAll(rest)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
