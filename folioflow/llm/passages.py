"""Passage dedup over words by relative Lempel-Ziv parsing.

The reference is every document. It is indexed by content-defined blocks: a block is a trigger of 27 words
(``repeats``) with the words of its runs before and after it. Blocks of one trigger meet in one range.
There each block is factored greedily against all blocks of earlier documents: from the first word on
that has no factor yet, the index gives the earliest document's block with the same 50 words, and the
factor is extended along that block as far as the words agree. A factor holds 50 words at least, so it is
a duplicate span. The parse goes on at the first run of 50 words that crosses the factor's end, so runs
at factor borders are checked as well. Where the index has nothing, the parse moves on by a word. Factors
of neighbouring blocks overlap, and together they cover a document's duplicate words.

A word is compared by a 64-bit hash of its bytes, a factor by the hashes of all of its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.repeats import Repeats, Shape, expand, find_repeats, groups, pack_sorted, squeeze, unpack_sorted
from folioflow.llm.runtime import table
from folioflow.llm.symbols import RADIX, U64, Texts, Words, gram_hash, mix, span_hash

#: Words of the grams that decide on triggers.
SMALL = 3


class WordCodes:
    """The words of a chunk's texts as 64-bit codes."""

    def __init__(self, texts: Texts, shape: Shape) -> None:
        self.shape, self.words = shape, Words.of(texts)
        self.first, self.codes = self.words.first, span_hash(texts.data, self.words.start, self.words.end)

    def order(self, lo: int, hi: int) -> np.ndarray:
        return (mix(gram_hash(self.codes[lo:hi], self.shape.small)) >> U64(32)).astype(np.uint32)

    def trigger(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, U64)
        lo, hi = int(at[0]), int(at[-1]) + self.shape.gram
        return mix(gram_hash(self.codes[lo:hi], self.shape.gram)[at - lo])

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.codes[np.clip(at, 0, len(self.codes) - 1)]


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Column d: the hash of the first d codes of each row."""
    out = np.zeros((codes.shape[1] + 1, len(codes)), U64)
    for d in range(codes.shape[1]):
        out[d + 1] = mix((out[d] ^ codes[:, d]) * RADIX + U64(d + 1))
    return out


def factors(key: np.ndarray, ids: np.ndarray, rows: np.ndarray, shape: Shape) -> np.ndarray:
    """Bit l of each row: a factor holds the 50 words from l words before its trigger. Rows of one key
    come in order of their documents."""
    least, most = (rows[:, k].astype(np.int64) for k in (0, 1))
    before, after = rows[:, 2 : 2 + shape.most], rows[:, 2 + shape.most : 2 + shape.most + shape.reach]
    left, right = _prefixes(before), _prefixes(after)
    edges = groups(key)
    owner = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(key))))
    out, at = np.zeros(len(key), U64), most.copy()
    for l in range(shape.most, -1, -1):
        asking = (at == l) & (least <= l)
        if not asking.any():
            at[at == l] -= 1
            continue
        # The index: all blocks, of the triggers that are asked about, which hold such a run.
        wanted = np.zeros(len(edges), bool)
        wanted[owner[asking]] = True
        block = np.flatnonzero((least <= l) & (l <= most) & wanted[owner])
        run = mix(key[block] ^ left[l][block] * RADIX ^ mix(right[shape.reach - l][block]))
        order = np.lexsort((ids[block], run))
        lead = np.concatenate([[True], run[order][1:] != run[order][:-1]])
        source = np.empty(len(block), np.int64)
        source[order] = block[order[lead]][np.cumsum(lead) - 1]
        here = asking[block] & (ids[source] < ids[block])
        mine, source = block[here], source[here]
        same = np.concatenate([after[mine] == after[source], np.zeros((len(mine), 1), bool)], axis=1).argmin(axis=1)
        last = np.maximum(least[mine], shape.reach - same)
        out[mine] |= ((U64(2) << U64(l)) - U64(1)) & ~((U64(1) << last.astype(U64)) - U64(1))
        at[at == l] -= 1
        at[mine] = last - 1
    return out


def _pack(rows: np.ndarray) -> bytes:
    """The distinct codes, and which one stands in each place."""
    codes, place = np.unique(rows, return_inverse=True)
    kind = np.uint16 if len(codes) <= 1 << 16 else np.uint32
    parts = [pack_sorted(codes), squeeze(place.astype(kind))]
    return np.array([len(parts[0]), kind().itemsize], np.int64).tobytes() + b"".join(parts)


def _unpack(body: bytes, width: int) -> np.ndarray:
    n, size = np.frombuffer(body[:16], np.int64).tolist()
    return unpack_sorted(body[16 : 16 + n], U64)[expand(body[16 + n :], f"u{size}")].reshape(-1, width)


class _Finish:
    def __init__(self, text: bool) -> None:
        self.text = text
        self.fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
        if text:
            self.fields += [("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string())]
        self.schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", spans array<array<long>>, kept string" * text
        self.empty = pa.schema(self.fields).empty_table()

    def __call__(self, c, covered: np.ndarray) -> pa.Table:
        data, out, words = memoryview(c.texts.data), [], c.seq.words
        first, keep = words.first.tolist(), ~covered
        for i in range(len(c.ids)):
            a, b = first[i], first[i + 1]
            stay = keep[a:b]
            n = int(stay.sum())
            kept = b" ".join([bytes(data[s:e]) for s, e in zip(words.start[a:b][stay].tolist(), words.end[a:b][stay].tolist())])
            row = [int(c.ids[i]), b - a, b - a - n, hashlib.sha256(kept).hexdigest()]
            if self.text:
                turns = np.flatnonzero(np.diff(np.concatenate([[False], ~stay, [False]]).astype(np.int8)))
                row += [turns.reshape(-1, 2).tolist(), kept.decode("utf-8", "replace")]
            out.append(row)
        return pa.table(dict(zip([f for f, _ in self.fields], (pa.array(x, t) for x, (_, t) in zip(zip(*out), self.fields))))) if out else self.empty


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, text: bool = False) -> DataFrame:
    """Remove each word that a ``window``-word run covers which also starts in a document with a
    smaller id; words are maximal runs of [^\\x20\\x09-\\x0D], and runs are judged on the input.

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), and with
    ``text`` the removed [start, end) word ranges and the kept text. Null text has no words; texts
    shorter than the window are kept. Rows with equal ids don't remove each other's words; rows with
    a null id are kept and remove nothing. Other columns are ignored. An empty table gives none.
    ``window``: 2 to 100 words.
    """
    spec = Repeats(Shape(window, min(SMALL, max(1, window // 4))), U64, WordCodes, factors, _pack, _unpack)
    out = find_repeats(docs.where(F.col(id_col).isNotNull()), id_col, text_col, spec, _Finish(text))
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))
    kept = F.array_join(found, " ")
    rest = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.size(found).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
        *([F.array().cast("array<array<long>>").alias("spans"), kept.alias("kept")] if text else []),
    )
    return out.unionAll(rest)


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents"))
