"""Exact token counts of a byte-level BPE with word ends, by dynamic programming over prefixes.

A segmentation is a word's BPE encoding exactly if each two neighbouring tokens are, by themselves,
the encoding of their concatenation. So the last token of every prefix follows from those of shorter
prefixes: it is the one token that ends there and is compatible with the last token of the prefix
before it. One pass gives the token count of every prefix of a word; running sums over a text's words
give it for every prefix of the text, and counts, truncation and budgets are look-ups (``prefix_counts``,
``truncate_to``, ``within_budget``).

What a word is follows from Unicode tables, which differ between versions. Texts of Latin letters, marks
and general punctuation, where they don't, are composed, lower-cased and matched here; all others by the
tokenizer library's own tables.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.runtime import ready, table
from folioflow.llm.tokenfiles import Memo, token_file

MODEL = "word_bpe_49k.json"
LIMIT = 2048

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the word pattern of the vocabulary file, with white space spelled out.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+"
#: A character outside of the blocks whose tables every version shares.
OTHER = re.compile("[^\x00-\u02ff\u2010-\u2027]")
#: Words of more characters than this are counted where they are found and not remembered.
LONG = 64


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for characters from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = accumulate((b not in own for b in range(256)), initial=0)
    return [chr(b) if b in own else chr(256 + k) for b, k in zip(range(256), rest)]


class PrefixCounter:
    """Token counts of texts under one vocabulary file. Words are strings of byte letters."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.longest = max(map(len, self.vocab))
        self.letters = byte_letters()
        self.word = regex.compile(WORD)
        self.normalizer, self.splitter = _library(path, spec)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.plain, self.final = {}, {}
        for token in self.vocab:
            if self.suffix and token.endswith(self.suffix):
                self.final[token[: -len(self.suffix)]] = token
            else:
                self.plain[token] = token
        for token in self.special:
            self.plain.pop(token, None)
        # Tokens that their own encoding doesn't give never occur.
        self.plain = {k: v for k, v in self.plain.items() if self._merged(list(k)) == [v]}
        self.final = {k: v for k, v in self.final.items() if k and self._merged([*k[:-1], k[-1] + self.suffix]) == [v]}
        #: Rank, left and right part of the merge that makes a token.
        self.made = {a + b: (i, a, b) for (a, b), i in reversed(self.rank.items())}
        self.fits = lru_cache(1 << 18)(self._fits)
        self.counts = Memo(self._count_word, longest=LONG)

    def _merged(self, parts: list[str]) -> list[str]:
        rank = self.rank
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: rank.get(p, 1 << 60))
            if best not in rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _fits(self, left: str, right: str) -> bool:
        """Is [left, right] the encoding of its own concatenation?

        The merges that made both are undone from the last to the first. Meanwhile two parts face
        each other at the border; they merge if their rank comes before the merge that ends either
        (at the same rank, the pair further left goes first), and else the border stands.
        """
        a, b, a_ends, b_ends = left, right, 1 << 60, 1 << 60
        while True:
            r = self.rank.get((a, b), 1 << 60)
            if r < a_ends and r <= b_ends and r < 1 << 60:
                return False
            of_a, of_b = self.made.get(a), self.made.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                a_ends, a = of_a[0], of_a[2]
            else:
                b_ends, b = of_b[0], of_b[1]

    def _table(self, word: str) -> tuple[str, list[int], list[str], list[int]]:
        """Byte letters of a word, where its characters end, and the last token and token count of
        each proper prefix inside the word."""
        letters, ends = [], [0]
        for c in word:
            letters += [self.letters[b] for b in c.encode("utf-8", "surrogatepass")]
            ends.append(len(letters))
        s, n, plain, fits, longest = "".join(letters), len(letters), self.plain, self.fits, self.longest
        last, count = [""] * n, [0] * n
        for i in range(1, n):
            for j in range(max(0, i - longest), i):
                token = plain.get(s[j:i])
                if token is not None and (j == 0 or last[j] and fits(last[j], token)):
                    last[i], count[i] = token, count[j] + 1
                    break
        return s, ends, last, count

    def _closed(self, s: str, i: int, last: list[str], count: list[int]) -> int:
        """Tokens of the first i letters as a word of their own."""
        for j in range(max(0, i - self.longest), i):
            token = self.final.get(s[j:i])
            if token is not None and (j == 0 or last[j] and self.fits(last[j], token)):
                return count[j] + 1
        raise ValueError(f"no encoding of {s[:i]!r}")

    def _count_word(self, word: str) -> int:
        s, _, last, count = self._table(word)
        return self._closed(s, len(s), last, count)

    def prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of a word (a lower-cased match of the pattern), by character; the
        prefix of n characters is counted as a word that ends there, and item 0 is 0."""
        s, ends, last, count = self._table(word)
        return [0, *(self._closed(s, i, last, count) for i in ends[1:])]

    def words(self, text: str):
        """(words, special tokens) of a text: special strings stand for themselves, the rest is
        composed (NFC), lower-cased letter by letter and matched."""
        pieces = self.cut.split(text) if self.cut else [text]
        for piece in pieces:
            if piece.isascii():
                yield self.word.findall(piece.lower())
            elif OTHER.search(piece):
                yield [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece))]
            else:
                yield self.word.findall(unicodedata.normalize("NFC", piece).lower())

    def count(self, text: str | None) -> int:
        total = -1
        for words in self.words(text or ""):
            total += 1 + sum(map(self.counts.__getitem__, words))
        return total

    def running(self, text: str | None) -> list[int]:
        """The token count after each item of a text, 0 first. Items are its words and special strings."""
        out = [0]
        for k, words in enumerate(self.words(text or "")):
            if k:
                out.append(out[-1] + 1)
            for w in words:
                out.append(out[-1] + self.counts[w])
        return out

    def items(self, text: str | None) -> list[str]:
        """The items of ``running``: special strings as they are, words composed and lower-cased."""
        special, out = iter(self.cut.findall(text or "") if self.cut else ()), []
        for k, words in enumerate(self.words(text or "")):
            if k:
                out.append(next(special))
            out += words
        return out

    def longest_fit(self, text: str | None, budget: int) -> int:
        """How many whole items of a text fit into ``budget`` tokens: a search in the running counts."""
        return max(0, bisect_right(self.running(text), budget) - 1)


def _library(path: str, spec: dict):
    """The normalizer and the splitter of a vocabulary file, as the tokenizer library has them."""
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    return Tokenizer.from_file(path).normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)


@lru_cache(4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _mapped(docs: DataFrame, id_col: str, text_col: str, model: str | None, columns: list[tuple[str, str, pa.DataType]], make) -> DataFrame:
    """(doc_id, columns) with what ``make(counter, text)`` gives for each text."""
    ready(docs.sparkSession)
    path = model or token_file(MODEL)

    def run(batches):
        known = counter(path)
        for batch in batches:
            found = list(zip(*(make(known, t) for t in batch.column(1).to_pylist()))) or [()] * len(columns)
            yield pa.record_batch([batch.column(0), *(pa.array(x, kind) for x, (_, _, kind) in zip(found, columns))], ["doc_id", *(name for name, _, _ in columns)])

    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return asked.mapInArrow(run, "doc_id long, " + ", ".join(f"{name} {kind}" for name, kind, _ in columns))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Null text has none; repeated rows are counted each; other columns are ignored; an empty table
    gives none. ``model`` is the path of a vocabulary file, which every executor must have.
    """
    make = lambda known, text: (len((text or "").encode()), known.count(text))
    counted = _mapped(docs, id_col, text_col, model, [("n_bytes", "long", pa.int64()), ("n_tokens", "long", pa.int64())], make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, running): the token count after each item (word or special string) of a text, 0 first, so
    running[k] tokens are the encoding of the first k items. Null and empty text: [0]; repeated rows stay."""
    return _mapped(docs, id_col, text_col, model, [("running", "array<int>", pa.list_(pa.int32()))], lambda known, text: (known.running(text),))


def within_budget(counted: DataFrame, budget: int, running_col: str = "running") -> DataFrame:
    """``counted`` (with the column of ``prefix_counts``) and n_items, n_tokens, fits (all items fit into
    ``budget`` tokens), budget_items and budget_tokens (of the longest prefix that does). Look-ups in the
    stored counts: nothing is encoded. A null column gives nulls."""
    r = F.col(running_col)
    inside = F.size(F.filter(r, lambda n: n <= budget))
    total = F.element_at(r, -1)
    return counted.withColumns({
        "n_items": F.when(r.isNotNull(), F.size(r) - 1), "n_tokens": total, "fits": total <= budget,
        "budget_items": F.when(r.isNotNull(), F.greatest(F.lit(0), inside - 1)), "budget_tokens": F.when(inside > 0, F.element_at(r, inside)).when(r.isNotNull(), 0),
    })


def truncate_to(docs: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, items, n_tokens): the longest prefix of each text, in whole items (words as the vocabulary
    sees them, composed and lower-cased), that has at most ``budget`` tokens, and its tokens. Null text: none."""

    def make(known, text):
        running = known.running(text)
        n = max(0, bisect_right(running, budget) - 1)
        return known.items(text)[:n], running[n]

    return _mapped(docs, id_col, text_col, model, [("items", "array<string>", pa.list_(pa.string())), ("n_tokens", "long", pa.int64())], make)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
