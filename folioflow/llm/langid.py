"""Language identification with string kernels, Nystroem landmarks and kernel ridge regression.

A text is the set of byte n-grams (lengths 1 to 3, ASCII folded) found in it; the blended-spectrum
presence kernel of two texts is the number of shared n-grams over the root of the product of their
numbers. Landmarks are training texts; kernels with the landmarks, whitened by the landmarks' own
kernel matrix, are features for one ridge regression per language against the rest. A batch is
scored by two matrix products: presence x landmarks and kernels x weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.runtime import cut, ready, table
from folioflow.llm.symbols import SLICE, Texts

#: Labelled texts for the fit: at most so many a language and SAMPLE_BYTES in all, shared evenly by the
#: languages, but one text of each at least. They are drawn by a hash of their ids from those of at most
#: FIT_BYTES; where those are too few longer ones follow, the shortest first.
PER_LANG, FIT_BYTES, SAMPLE_BYTES = 300, 20_000, 64 << 20
#: Rows of a list of languages or of chosen texts that is broadcast, at most.
LISTED = 1 << 16
#: Landmarks in all; they are spread evenly over the languages.
LANDMARKS = 128
RIDGE = 1e-2
GRAMS = (1, 2, 3)
#: n-grams are known by 18 bits of a hash.
TABLE = 1 << 18
#: Documents scored at once.
BATCH = 256
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(33), *range(48, 58)]] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _keys(folded: np.ndarray, n: int) -> np.ndarray:
    """18-bit hash of each n consecutive bytes."""
    code = folded.copy()
    for j in range(1, n):
        code = code[: len(code) - 1] * np.uint32(256) + folded[j:]
    return (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(14) if n > 1 else code + np.uint32(TABLE)


def presence(texts: Texts, columns: np.ndarray | None = None, width: int = TABLE + 256) -> np.ndarray:
    """texts x n-grams, 1 where a text holds the n-gram. columns: n-gram -> column or ``width`` (none)."""
    out = np.zeros((len(texts), width + 1), np.uint8)
    flat = out.reshape(-1)
    for a in range(0, len(texts.data), SLICE):
        lo, hi = a, min(len(texts.data), a + SLICE + max(GRAMS) - 1)
        folded = _FOLD[texts.data[lo:hi]]
        of = np.searchsorted(texts.end, np.arange(lo, hi), "right")
        for n in GRAMS:
            key = _keys(folded, n)[: max(0, min(SLICE, hi - lo - n + 1))]
            inside = of[: len(key)] == of[n - 1 : n - 1 + len(key)]
            column = key if columns is None else columns[key]
            flat[(of[: len(key)] * (width + 1) + column)[inside]] = 1
    return out[:, :width]


def has_letter(texts: Texts) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[texts.data])])
    out = total[texts.end] > total[texts.start]
    for i in np.flatnonzero(~out & (texts.end > texts.start)).tolist():
        out[i] = any(c.isalpha() for c in bytes(texts.data[texts.start[i] : texts.end[i]]).decode("utf-8", "replace") if c != "�")
    return out


@dataclass
class Model:
    langs: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernels(self, x: np.ndarray) -> np.ndarray:
        """Kernel of each text with each landmark; landmark columns are already over the root of their sizes."""
        return x @ self.landmarks

    def scores(self, texts: Texts) -> np.ndarray:
        """One score for each text and language: about 1 for the language, about 0 for others."""
        x = presence(texts, self.columns, len(self.landmarks)).astype(np.float32)
        size = np.sqrt(np.maximum(1, x.sum(axis=1)))
        return (self.kernels(x) / size[:, None]) @ self.weights


def fit(texts: list[str], labels: list[str]) -> Model:
    """Fit on labelled texts; the result depends on their set and order only."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    column = pa.array(texts, pa.string())
    marks = np.concatenate([np.flatnonzero(y == i)[: max(1, LANDMARKS // len(langs))] for i in range(len(langs))])
    seen = np.zeros(TABLE + 256, bool)
    for m in marks.tolist():
        seen |= presence(Texts.of(column[m : m + 1]))[0] > 0
    used = np.flatnonzero(seen)
    columns = np.full(TABLE + 256, len(used), np.int32)
    columns[used] = np.arange(len(used))

    def unit(part: pa.Array) -> np.ndarray:
        x = presence(Texts.of(part), columns, len(used)).astype(np.float32)
        return x / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]

    # Only the landmarks' presence stays; other texts leave their kernels with them.
    landmarks = np.ascontiguousarray(unit(column.take(pa.array(marks))).T)
    k = np.concatenate([unit(column[a : a + BATCH]) @ landmarks for a in range(0, len(texts), BATCH)]).astype(np.float64)
    value, vector = np.linalg.eigh(k[marks])
    keep = value > 1e-6 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])
    z = k @ white
    # Languages weigh alike whatever their numbers of texts.
    weight = (1 / np.bincount(y)[y])[:, None]
    target = (y[:, None] == np.arange(len(langs))).astype(float)
    ridge = np.linalg.solve(z.T @ (z * weight) + RIDGE * np.eye(z.shape[1]), z.T @ (target * weight))
    return Model(langs, columns, landmarks, (white @ ridge).astype(np.float32))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, langs: int | None = None) -> DataFrame:
    """(lang, n, text): the bounded sample for the fit, of every language or of the ``langs`` most frequent.

    Texts are chosen by their numbers alone and fetched afterwards. A language with many texts of at most
    FIT_BYTES first loses those whose draw is beyond five times the number that is wanted, which are never
    chosen, so that one task ranks a language whatever its share. Equal texts of one id are learned once.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null and id is not null")
    learn = rows.withColumn("size", F.octet_length("text")).where((F.crc32(F.col("id").cast("binary")) % 4 != 2) & (F.col("size") > 0))
    learn = learn.withColumns({"draw": F.xxhash64("id", "text"), "longer": F.when(F.col("size") > FIT_BYTES, F.col("size")).otherwise(0)})
    known = learn.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"), F.count_if(F.col("longer") == 0).alias("short"))
    if langs is not None:
        known = known.orderBy(F.desc("n"), "of").limit(langs)
    known = cut(known.select("of", "short"))
    n = known.count()
    within = F.col("draw") / 2.0**64 + 0.5 < 5.0 * PER_LANG / F.col("short")
    light = learn.select("lang", "longer", "draw", "id", "size").join(F.broadcast(known) if n <= LISTED else known, F.col("lang") == F.col("of"))
    light = light.where((F.col("short") < 5 * PER_LANG) | (F.col("longer") == 0) & within).select("lang", "longer", "draw", "id", "size").distinct()
    by = Window.partitionBy("lang").orderBy("longer", "draw", "id")
    before = F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    ranked = light.withColumn("n", F.row_number().over(by)).where(F.col("n") <= PER_LANG).withColumn("before", before)
    chosen = cut(ranked.where((F.col("n") == 1) | (F.col("before") + F.col("size") <= SAMPLE_BYTES // max(1, n))).select("lang", "id", "draw", "n"))
    few = F.broadcast(chosen) if n * PER_LANG <= LISTED else chosen
    return learn.join(few, ["lang", "id", "draw"]).groupBy("lang", "n").agg(F.first("text").alias("text"))


def _predict(model):
    def run(batches):
        m: Model = model.value
        for batch in batches:
            texts, best, score = Texts.of(batch.column(2)), [], []
            letters = has_letter(texts)
            i = 0
            while i < len(texts):
                # A block has a bounded number of texts and, but for a single long text, of bytes.
                j = min(len(texts), i + BATCH, max(i + 1, int(np.searchsorted(texts.end, texts.start[i] + (1 << 21), "right"))))
                lo, hi = texts.start[i], texts.end[j - 1]
                s = m.scores(Texts(texts.data[lo:hi], texts.start[i:j] - lo, texts.end[i:j] - lo))
                best.append(s.argmax(axis=1))
                score.append(np.clip(s.max(axis=1).astype(float), 0, 1))
                i = j
            best, score = (np.concatenate(x) if x else np.empty(0) for x in (best, score))
            lang = [m.langs[int(b)] if ok else UNKNOWN for b, ok in zip(best, letters)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", langs: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    The fit takes text and non-null language of documents whose crc32 of the id, as text, is not 2
    modulo 4, of every language or of the ``langs`` most frequent; the others (held_out) and rows with a null id are only predicted. A null text and one
    without a letter are ``und`` with score 0, as is everything where nothing can be learned. Scores
    look at the whole text only, so equal texts are predicted alike. Of texts with equal ids some are learned
    or all. An empty table gives none. Collected: the sample, SAMPLE_BYTES and one text a language at most.
    """
    spark = ready(docs.sparkSession)
    id_text = F.col(id_col).cast("string").cast("binary")
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.crc32(id_text) % 4 == 2, F.lit(False))).alias("held_out"), F.col(text_col).alias("text"))
    sample = training_rows(docs, id_col, text_col, lang_col, langs).orderBy("lang", "n").toArrow()
    if not sample.num_rows:
        return asked.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = spark.sparkContext.broadcast(fit(sample["text"].to_pylist(), sample["lang"].to_pylist()))
    return asked.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
