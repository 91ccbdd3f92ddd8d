"""Quality rules whose thresholds follow the corpus.

Per document a few counts are taken; their ratios go into quantile sketches per language and source, from
all documents that pass the base rules. A sketch is a histogram over integer buckets, without a bound as
fences and documents must be on one scale, so sketches merge by adding counts, in any order, to the same
result. A fence stands at a multiple of the distance from a group's median to the quantile of a documented
rank; nothing else goes into it. A group with few documents, or without any distance, tells nothing and
takes the fence of its language, and that in turn the corpus's. A document is rejected where a ratio lies
beyond its fence; fences are joined to the documents by group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.runtime import cut, ready, table
from folioflow.llm.symbols import IS_SPACE, U64, Texts, Words, gram_hash, mix, span_hash

#: Words of a window that counts as repeated when it is found twice.
REPEAT = 8
#: Documents that a group needs for fences of its own: two above the highest rank.
LEAST_GROUP = 200
#: Ratio -> (numerator, factor, denominator, rank of the upper quantile in hundredths, rank of the lower one
#: or none, distances from the median that are still accepted). Symbols, stutters and word lengths mark junk,
#: which may make up some of the upper tenth; single repeats are common in good texts, so only values far
#: beyond the highest hundredth count.
RATIOS = {
    "length": ("word_chars", 10, "n_words", 90, 10, 4),
    "symbols": ("n_symbols", 1000, "word_chars", 90, None, 4),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 99, None, 2),
    "repeats": ("n_repeat_words", 1000, "n_words", 99, None, 2),
    "stutters": ("n_stutters", 1000, "n_words", 90, None, 4),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BEGINS_CHAR = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[end] - total[start]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: is it found twice or more; is it a later one of its equals."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def text_counts(texts: Texts) -> dict[str, np.ndarray]:
    words = Words.of(texts)
    first, n = words.first, len(texts)
    out = {"n_words": np.diff(first)}
    solid = ~IS_SPACE[texts.data]
    out["word_chars"] = _per_text(solid & _BEGINS_CHAR[texts.data], texts.start, texts.end)
    out["n_symbols"] = _per_text(_SYMBOL[texts.data], texts.start, texts.end)

    # Lines: cut at each \n and at each text's end.
    breaks = np.flatnonzero(texts.data == 10)
    of_break = np.searchsorted(texts.end, breaks, "right")
    starts = np.concatenate([texts.start, breaks + 1])
    of = np.concatenate([np.arange(n), of_break])
    order = np.lexsort((starts, of))
    starts, of = starts[order], of[order]
    ends = np.append(starts[1:] - 1, 0) if n else starts
    last = np.append(of[1:] != of[:-1], True) if n else np.empty(0, bool)
    ends[last] = texts.end[of[last]]
    wordy = _per_text(solid, starts, ends) > 0
    out["n_lines"] = np.bincount(of[wordy], minlength=n)
    h = span_hash(texts.data, starts[wordy], ends[wordy])
    _, later = _again(mix(h ^ mix(of[wordy].astype(U64))))
    out["n_dup_lines"] = np.bincount(of[wordy][later], minlength=n)

    # Windows of words.
    out["n_repeat_words"] = np.zeros(n, np.int64)
    codes = span_hash(texts.data, words.start, words.end)
    owner = np.repeat(np.arange(n), out["n_words"])
    stutter = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    out["n_stutters"] = np.bincount(owner[1:][stutter], minlength=n)
    if len(codes) >= REPEAT:
        h = gram_hash(codes, REPEAT)
        of = owner[: len(h)]
        inside = np.arange(len(h)) + REPEAT <= first[of + 1]
        at = np.flatnonzero(inside)
        twice, _ = _again(mix(h[at] ^ mix(of[at].astype(U64))))
        delta = np.zeros(len(codes) + REPEAT + 1, np.int32)
        delta[at[twice]] += 1
        delta[at[twice] + REPEAT] -= 1
        out["n_repeat_words"] = _per_text(np.cumsum(delta)[: len(codes)] > 0, first[:-1], first[1:])
    return out


def _measure(batches):
    for batch in batches:
        texts, parts = Texts.of(batch.column("text")), []
        for i, j in texts.blocks(1 << 18):
            lo, hi = texts.start[i], texts.end[j - 1]
            parts.append(text_counts(Texts(texts.data[lo:hi], texts.start[i:j] - lo, texts.end[i:j] - lo)))
        arrays = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
        keep = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.record_batch([*(batch.column(k) for k in keep), *arrays], [*(batch.schema.names[k] for k in keep), *COUNTS])


def _ratio(name: str) -> Column:
    top, factor, bottom, *_ = RATIOS[name]
    return F.when(F.col(bottom) > 0, F.expr(f"{top} * {factor} div {bottom}"))


def _failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, level, ratio, bucket, n): one mergeable histogram for each group and ratio, for
    each language (level 1) and for all (level 2)."""
    good = measured.where(~_failed())
    long = good.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), _ratio(r).alias("bucket")) for r in RATIOS))).alias("x"))
    base = long.select("lang", "source", "x.ratio", "x.bucket").where("bucket is not null").groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n"))
    levels = [base.withColumn("level", F.lit(0)), base.withColumn("source", F.lit(None).cast("string")).withColumn("level", F.lit(1)), base.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}).withColumn("level", F.lit(2))]
    every = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return every.groupBy("level", "lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, ratio, low, high): the accepted range of each sketch that tells one."""
    by = Window.partitionBy("level", "lang", "source", "ratio")
    seen = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    setting = lambda k: F.element_at(F.create_map(*(F.lit(x) for r, v in RATIOS.items() for x in (r, v[k]))), F.col("ratio"))
    at = lambda rank: F.min(F.when(F.col("upto") * 100 >= F.col("total") * rank, F.col("bucket")))
    found = seen.withColumns({"upper": setting(3), "lower": setting(4), "reach": setting(5)}).groupBy("level", "lang", "source", "ratio", "lower", "reach").agg(
        F.max("total").alias("total"), at(F.lit(50)).alias("mid"), at(F.col("upper")).alias("top"), at(F.col("lower")).alias("bottom")
    )
    # Without a lower rank there is no lower quantile, and no fence there.
    tells = (F.col("level") == 2) | (F.col("total") >= LEAST_GROUP) & (F.col("top") > F.coalesce("bottom", "mid"))
    return found.where(tells).select(
        "level", "lang", "source", "ratio", (F.col("mid") - (F.col("mid") - F.col("bottom")) * F.col("reach")).alias("low"), (F.col("mid") + (F.col("top") - F.col("mid")) * F.col("reach")).alias("high")
    )


def limits(measured: DataFrame) -> DataFrame:
    """(of_lang, of_source, low_<ratio>, high_<ratio>): the fences of each group, of the finest level that tells them."""
    nothing = F.lit(None).cast("string")
    levels = [(F.lit(0), F.col("lang"), F.col("source")), (F.lit(1), F.col("lang"), nothing), (F.lit(2), nothing, nothing)]
    asked = measured.select("lang", "source").distinct().select(
        F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.explode(F.array(*(F.struct(a.alias("at"), b.alias("at_lang"), c.alias("at_source")) for a, b, c in levels))).alias("x")
    ).select("of_lang", "of_source", "x.*")
    found = fences(sketches(measured))
    every = asked.join(found, (F.col("at") == F.col("level")) & F.col("at_lang").eqNullSafe(F.col("lang")) & F.col("at_source").eqNullSafe(F.col("source")))
    pick = lambda r, side: F.min_by(side, F.when(F.col("ratio") == r, F.col("level"))).alias(f"{side}_{r}")
    return every.groupBy("of_lang", "of_source").agg(*(pick(r, side) for r in RATIOS for side in ("low", "high")))


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept."""
    out = measured.join(limits(measured), F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    odd = F.lit(False)
    for r in RATIOS:
        # A single event is the least that a text can have, so it is no evidence against it.
        odd = odd | F.coalesce((_ratio(r) > F.col(f"high_{r}")) & (F.col(RATIOS[r][0]) > 1), F.lit(False)) | F.coalesce(_ratio(r) < F.col(f"low_{r}"), F.lit(False))
    return out.withColumn("base_failed", _failed()).withColumn("kept", ~_failed() & ~odd).select(*measured.columns, "base_failed", "kept")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, lang, source, the counts, base_failed, kept.

    Null text has no words (base_failed). Null languages and sources form groups of their own.
    Repeated rows count as so many documents. Other columns are ignored; an empty table gives none.
    """
    return judge(cut(measure(docs, id_col, text_col, lang_col, source_col))).drop("row")


def measure(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    ready(docs.sparkSession)
    ask = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return ask.mapInArrow(_measure, "doc_id long, lang string, source string, row long, " + ", ".join(f"{c} long" for c in COUNTS))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns.

    The rejected are usually the smaller part, so the join carries their keys; a verdict follows from
    a row's id, language, source and text, so repeated rows go or stay together.
    """
    out = judge(cut(measure(docs, id_col, text_col, lang_col, source_col))).where(~F.col("kept")).select("doc_id", "lang", "source", "row").distinct()
    mine = [F.col(f"d.`{id_col}`").cast("long"), F.col(f"d.`{lang_col}`").cast("string"), F.col(f"d.`{source_col}`").cast("string"), F.xxhash64(F.col(f"d.`{text_col}`"))]
    same = mine[0].eqNullSafe(F.col("o.doc_id")) & mine[1].eqNullSafe(F.col("o.lang")) & mine[2].eqNullSafe(F.col("o.source")) & (mine[3] == F.col("o.row"))
    return docs.alias("d").join(out.alias("o"), same, "left_anti")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
