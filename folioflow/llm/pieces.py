"""SentencePiece encoding and decoding over a relational lattice.

Frequent words go through Spark: every substring of bounded length is exploded and equi-joined to
the piece table, the edges are grouped by word, and a higher-order ``aggregate`` folds them into the
word's pieces. The model at hand is a BPE model, for which the best-scoring path (Viterbi) is not the
encoding; the fold therefore takes edges in the order of their merges and keeps an edge if both its
ends are still borders, which gives the library's pieces exactly. ``encode_by_blocks`` sends every word
through it: texts are cut into blocks, and the distinct words of each block are joined with what the lattice
gives for them. In ``encode`` the words it resolves are a table of bounded size that every task gets; rarer
words are folded over the same lattice where they occur, as a join of all word occurrences would move several
times the corpus.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.runtime import cut, ready, table
from folioflow.llm.tokenfiles import Memo, token_file

MODEL = "piece_bpe_32k.model"
#: Words resolved in Spark and given to every task: at most this many, of at most so many characters
#: (a bit of a long for each border), so 20 MB at most.
HEAD, HEAD_LENGTH = 1 << 17, 40
#: Distinct words that a counting task holds, about.
COUNTED = 1 << 17
#: Bytes of text that are Python strings, or a batch of results, at a time, about.
BLOCK = 1 << 20
#: A block of texts ends with so many distinct words, or characters of text, about.
BLOCK_WORDS, BLOCK_TEXT = 1 << 17, 1 << 24
#: Borders that are bits of a long; characters up to which a part of a word goes through Spark's lattice.
BITS, LONGEST_PART = 61, 1 << 10
SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: A word: spaces with what follows up to the next space or line end. No piece crosses such a border.
WORD = f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"


@dataclass
class Pieces:
    """ids: piece -> id. rank: pieces of several characters that merges can make -> order of the
    merge. bytes_id: the id of byte 0 (fallback). out: what each id decodes to."""

    ids: dict[str, int]
    rank: dict[str, int]
    bytes_id: int
    out: list[bytes]
    longest: int

    def __post_init__(self) -> None:
        self.memo, self.seeded = Memo(self.encode_word), None
        self.bytes_of = pa.array(self.out, pa.large_binary())
        #: Rank of each mergeable piece, and -1 for what only begins one: the walk stops where nothing goes on.
        self.walk = {p[:n]: -1 for p in self.rank for n in range(2, len(p))} | self.rank
        self.word = re.compile(WORD)

    def fold(self, word: str) -> list[int]:
        """The pieces' ends, 0 first: lattice edges in merge order, kept while both ends are borders."""
        n, walk, edges = len(word), self.walk.get, []
        for i in range(n - 1):
            for k in range(i + 2, n + 1):
                r = walk(word[i:k])
                if r is None:
                    break
                if r >= 0:
                    edges.append((r, i, k))
        edges.sort()
        border = bytearray(b"\1") * (n + 1)
        for _, i, k in edges:
            if border[i] and border[k]:
                if k == i + 2:
                    border[i + 1] = 0
                else:
                    border[i + 1 : k] = bytes(k - i - 1)
        return [i for i, b in enumerate(border) if b]

    def encode_word(self, word: str) -> bytes:
        ids: list[int] = []
        find, at = self.ids.get, self.fold(word)
        for i, k in zip(at, at[1:]):
            found = find(word[i:k])
            if found is not None:
                ids.append(found)
            else:
                ids += [self.bytes_id + b for b in word[i:k].encode("utf-8", "surrogatepass")]
        return array("i", ids).tobytes()

    def parts(self, word: str) -> list[str]:
        """A word or, of one with more than BITS characters, what lies between places that no lattice edge crosses."""
        n, walk = len(word), self.walk.get
        if n <= BITS:
            return [word]
        cuts, reach = [0], 1
        for i in range(n):
            if i >= reach:
                cuts.append(i)
            reach = max(reach, i + 1)
            for k in range(i + 2, n + 1):
                r = walk(word[i:k])
                if r is None:
                    break
                if r >= 0:
                    reach = max(reach, k)
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], n])]

    def gives(self, ids, word: str) -> bool:
        """Do ids stand for a word's own bytes?"""
        return b"".join(map(self.out.__getitem__, ids)) == word.encode("utf-8", "surrogatepass")

    def bytes_of_all(self, ids: pa.Array, ends: np.ndarray) -> tuple[memoryview | bytes, list[int]]:
        """The bytes of all ids in a row, looked up at once, and where those of the first ``ends`` ids end."""
        found = self.bytes_of.take(ids)
        at = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[ends].tolist()
        data = found.buffers()[2]
        return memoryview(data) if data is not None else b"", at

    def round_trips(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Is decoding each text's ids the text again? The ids of all texts are looked up at once."""
        raw, at = self.bytes_of_all(pa.array(np.concatenate([np.empty(0, np.int32), *ids])), np.cumsum([0, *map(len, ids)]))

        def same(got: bytes, text: str) -> bool:
            plain = got.replace(SPACE_BYTES, b" ")
            # Equal bytes are equal texts; others can still be, where broken bytes became U+FFFD.
            return plain[plain.startswith(b" ") :] == text.encode() or self.text(got) == text

        return [same(bytes(raw[i:k]), text) for i, k, text in zip(at, at[1:], texts)]

    def texts(self, lists: pa.ListArray) -> pa.Array:
        """What lists of ids decode to, null for a null list, without Python numbers for the ids."""
        ids, known = lists.flatten(), lists.is_valid().to_pylist()
        if ids.null_count:
            raise ValueError("a list of token ids holds a null")
        raw, at = self.bytes_of_all(ids, np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()]))
        return pa.array([self.text(bytes(raw[i:k])) if is_known else None for i, k, is_known in zip(at, at[1:], known)], pa.string())

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        words = self.word.findall(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.int32)

    def decode(self, ids) -> str:
        return self.text(b"".join(map(self.out.__getitem__, ids)))

    def text(self, raw: bytes) -> str:
        """The text of pieces' bytes."""
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def merge_order(pieces: dict[str, int]) -> dict[str, int]:
    """For each piece of several characters that merging neighbours can make at all, when it is made:
    its own rank or, if later, that of a part. ``pieces`` gives ranks, smaller first."""

    def made(piece: str) -> int | None:
        parts, latest = list(piece), -1
        while len(parts) > 1:
            found = [(pieces[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in pieces]
            if not found:
                return None
            r, i = min(found)
            latest = max(latest, r)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return latest

    return {p: r for p in pieces if len(p) > 1 and (r := made(p)) is not None}


@lru_cache(4)
def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, score, out, bytes_id = {}, {}, [], None
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_id = i if bytes_id is None else bytes_id
            out.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            out.append(" ⁇ ".encode() if model.is_unknown(i) else b"")
        else:
            ids[piece] = i
            score[piece] = model.get_score(i)
            out.append(piece.encode())
    order = {p: r for r, p in enumerate(sorted(score, key=lambda p: (-score[p], ids[p])))}
    return Pieces(ids, merge_order(order), bytes_id, out, max(map(len, ids)))


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """(piece, id, rank): the model's vocabulary, a bounded table; rank is null for single characters."""
    p = load(model)
    return spark.createDataFrame(pa.table({"piece": list(p.ids), "id": pa.array(p.ids.values(), pa.int32()), "rank": pa.array([p.rank.get(x) for x in p.ids], pa.int32())}))


def lattice(words: DataFrame, model: str) -> DataFrame:
    """(word, ids) for distinct words, in DataFrame operations alone. Words of at most BITS characters have their
    borders in a long, longer ones in a string of bytes."""
    return _lattice(words.where(F.length("word") <= BITS), model, False).unionAll(_lattice(words.where(F.length("word") > BITS), model, True))


def _lattice(words: DataFrame, model: str, long: bool) -> DataFrame:
    p = load(model)
    spans = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i")).select(
        "word", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(p.longest), F.length("word") - F.col("i")))).alias("n")
    )
    # Single characters stay without a piece, too, and with them every word.
    edges = spans.withColumn("piece", F.substring("word", F.col("i") + 1, F.col("n"))).join(F.broadcast(piece_table(words.sparkSession, model)), "piece", "left").where("n = 1 or rank is not null")
    # Edges in merge order; single characters, which need no merge, come last.
    edge = F.when(F.col("id").isNotNull(), F.struct(F.coalesce("rank", F.lit(1 << 30)).alias("rank"), "i", "n", "id"))
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    if long:
        all_of = lambda digit, n: F.encode(F.repeat(F.lit(digit), n), "utf-8")
        every = all_of("1", F.length("word") + 1)
        is_on = lambda mask, at: F.substring(mask, at + 1, F.lit(1)) == F.lit(b"1")
        without = lambda mask, e: F.overlay(mask, all_of("0", e["n"] - 1), e["i"] + 2, e["n"] - 1)
        is_off = lambda mask, e: F.substring(mask, e["i"] + 2, e["n"] - 1) == all_of("0", e["n"] - 1)
    else:
        ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1
        inside = lambda e: F.call_function("shiftleft", ones(e["n"] - 1), e["i"] + 1)
        every = ones(F.length("word") + 1)
        is_on = lambda mask, at: F.call_function("getbit", mask, at) == 1
        without = lambda mask, e: mask.bitwiseAND(F.bitwise_not(inside(e)))
        is_off = lambda mask, e: mask.bitwiseAND(inside(e)) == 0
    both = lambda mask, e: is_on(mask, e["i"]) & is_on(mask, e["i"] + e["n"])
    folded = grouped.withColumn("border", F.aggregate("edges", every, lambda m, e: F.when(both(m, e), without(m, e)).otherwise(m)))
    starts = F.filter(F.sequence(F.lit(0), F.length("word") - 1), lambda i: is_on(F.col("border"), i))
    whole = lambda e: both(F.col("border"), e) & is_off(F.col("border"), e)
    kept = folded.withColumn("starts", starts).withColumn("known", F.map_from_entries(F.transform(F.filter("edges", whole), lambda e: F.struct(e["i"], e["id"]))))
    raw = lambda i: F.hex(F.encode(F.substring("word", i + 1, F.lit(1)), "utf-8"))
    fallback = lambda i: F.transform(F.sequence(F.lit(0), F.floor(F.length(raw(i)) / 2).cast("int") - 1), lambda b: F.conv(F.substring(raw(i), b * 2 + 1, F.lit(2)), 16, 10).cast("int") + p.bytes_id)
    ids = F.flatten(F.transform("starts", lambda i: F.when(F.element_at("known", i).isNotNull(), F.array(F.element_at("known", i))).otherwise(fallback(i))))
    return kept.select("word", ids.alias("ids"))


def _word_counts(batches):
    """(word, n) of each batch's words, partly summed: what a task has met is passed on when it grows large."""
    word, counts = re.compile(WORD), Counter()

    def told():
        kept = [(w, n) for w, n in counts.items() if len(w) <= HEAD_LENGTH]
        for a in range(0, len(kept), 1 << 16):
            words, n = zip(*kept[a : a + (1 << 16)])
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])
        counts.clear()

    for batch in batches:
        for a, b in blocks(batch.column(0)):
            for text in batch.column(0)[a:b].to_pylist():
                if text:
                    counts.update(word.findall(SPACE + text.replace(" ", SPACE)))
                    if len(counts) > COUNTED:
                        yield from told()
    yield from told()


def blocks(column: pa.Array):
    """[start, end) of runs of a column's texts or lists of ids, each of about BLOCK bytes or one longer row."""
    size = pc.binary_length(column) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.multiply(pc.list_value_length(column).cast(pa.int64()), 4)
    total = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    edges = [0, *(np.flatnonzero(np.diff(total // BLOCK)) + 1).tolist(), len(column)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def frequent_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The words of a corpus that occur most (counted over all documents), at most HEAD of them."""
    words = docs.select(F.col(text_col).alias("text")).mapInArrow(_word_counts, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("count")).where("count > 1").orderBy(F.desc("count"), "word").limit(HEAD).select("word")


def _encode(model: str, seed, digest: bool, memo: int, trips: bool = True):
    def run(batches):
        pieces = load(model)
        if pieces.seeded != seed.value[0]:  # else a task before has filled this worker's memo
            token, words, ids, ends = seed.value
            known = dict(zip(words, (x.tobytes() for x in np.split(ids, ends))))
            pieces.memo, pieces.seeded = Memo(pieces.encode_word, memo, known), token
        for batch in batches:
            yield from _coded(pieces, batch.column(0), batch.column(1), digest, trips)

    return run


def _coded(pieces: Pieces, doc_ids: pa.Array, column: pa.Array, digest: bool, trips: bool = True):
    """Rows of ``encode``; round_trip is null without ``trips``, for who decodes the ids anyway."""
    for a, b in blocks(column):
        texts = [text or "" for text in column[a:b].to_pylist()]
        coded = [pieces.encode(text) for text in texts]
        n, trip = [len(ids) for ids in coded], pieces.round_trips(texts, coded) if trips else [None] * len(coded)
        if digest:
            tail = pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in coded], pa.string())
        else:
            tail = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(coded), pa.int32()))
        yield pa.record_batch([doc_ids[a:b], pa.array(n, pa.int64()), pa.array(trip, pa.bool_()), tail], ["doc_id", "n_tokens", "round_trip", "ids_sha256" if digest else "token_ids"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, digest: bool = False, memo: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, n_tokens, round_trip, and token_ids, or with ``digest`` the
    SHA-256 of the ids as little-endian 32-bit integers.

    Ids are those of the library without begin and end tokens. round_trip: decoding the ids gives
    the text again, which fails only for texts that hold U+2581 themselves. Null and empty texts have
    no tokens; repeated rows are encoded each; other columns are ignored; an empty table gives none.
    ``memo``: words that a worker remembers at a time, at about 250 bytes each.
    """
    path = model or token_file(MODEL)
    return _asked(docs, id_col, text_col).mapInArrow(_encode(path, _seed(docs, text_col, path), digest, memo), _columns(digest))


def _asked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _seed(docs: DataFrame, text_col: str, path: str):
    """The most frequent words and their ids from Spark's lattice, for every task."""
    spark = ready(docs.sparkSession)
    rows = lattice(cut(frequent_words(docs, text_col)).repartition(8), path).toArrow()
    ids, known = rows["ids"].combine_chunks(), load(path)
    if not all(known.gives(i, w) for w, i in zip(rows["word"].to_pylist(), ids.to_pylist())):
        raise ValueError("the lattice lost a word's bytes")
    return spark.sparkContext.broadcast((uuid.uuid4().hex, rows["word"].to_pylist(), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.asarray(ids.offsets)[1:-1] if len(ids) else np.empty(0, int)))


def _columns(digest: bool) -> str:
    return "doc_id long, n_tokens long, round_trip boolean, " + ("ids_sha256 string" if digest else "token_ids array<int>")


class Known(dict):
    """Words of a block -> ids, as the lattice gave them."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        parts = self.pieces.parts(word)
        if len(parts) > 1:
            return b"".join(map(self.__getitem__, parts))
        if len(word) > LONGEST_PART:
            return self.pieces.encode_word(word)
        raise ValueError(f"a word of the texts didn't come through the lattice: {word!r}")


#: A block's texts (word is null) and its distinct words.
SPREAD = "block long, doc_id long, text string, word string"


def _spread(model: str):
    """Texts with the number of a block, and the distinct words of each block, of long words their parts."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("word", pa.string())])

    def run(batches):
        pieces, block, words, size = load(model), TaskContext.get().partitionId() << 32, set(), 0

        def rows(n, doc_ids=None, texts=None, words=None):
            given = [pa.array(np.full(n, block)), doc_ids, texts, words]
            return pa.record_batch([pa.nulls(n, f.type) if x is None else x.cast(f.type) for x, f in zip(given, schema)], schema=schema)

        def told():
            long = [w for w in words if len(w) > BITS]
            words.difference_update(long)
            words.update(x for w in long for x in pieces.parts(w) if len(x) <= LONGEST_PART)
            found = list(words)
            words.clear()
            for a in range(0, len(found), 1 << 15):
                some = pa.array(found[a : a + (1 << 15)], pa.string())
                yield rows(len(some), words=some)

        for batch in batches:
            for a, b in blocks(batch.column(1)):
                texts = batch.column(1)[a:b]
                yield rows(b - a, batch.column(0)[a:b], texts)
                for text in texts.to_pylist():
                    if text:
                        words.update(pieces.word.findall(SPACE + text.replace(" ", SPACE)))
                        size += len(text)
                if len(words) >= BLOCK_WORDS or size >= BLOCK_TEXT:
                    yield from told()
                    block, size = block + 1, 0
        yield from told()

    return run


def _encode_blocks(model: str, digest: bool):
    def run(batches):
        pieces, at = load(model), None
        for batch in batches:
            block, is_word = batch.column(0).to_numpy(), batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (is_word[1:] != is_word[:-1])) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:]):
                if a < b and block[a] != at:
                    at, pieces.memo, pieces.seeded = block[a], Known(pieces), None
                if a < b and is_word[a]:
                    ids = batch.column(3)[a:b]
                    raw, ends = ids.flatten().to_numpy().astype(np.int32).tobytes(), (4 * np.cumsum([0, *pc.list_value_length(ids).to_pylist()])).tolist()
                    pieces.memo.update(zip(batch.column(2)[a:b].to_pylist(), (raw[i:k] for i, k in zip(ends, ends[1:]))))
                elif a < b:
                    yield from _coded(pieces, batch.column(1)[a:b], batch.column(2)[a:b], digest)

    return run


def encode_by_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, digest: bool = False) -> DataFrame:
    """The rows of ``encode``, with the ids of every word from Spark's lattice.

    Texts with the numbers of their blocks and each block's distinct words are written into the shared folder,
    where they stay, as rows are computed when they are asked for. A word of more than BITS characters goes
    through the lattice in the parts between places that no edge crosses. A part without such a place that has
    more than LONGEST_PART characters, a run of one sign say, is folded over the same lattice in its task: the
    rows of its edges would grow with the square of its length.
    """
    spark, path = ready(docs.sparkSession), model or token_file(MODEL)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pieces-{uuid.uuid4().hex}"
    _asked(docs, id_col, text_col).mapInArrow(_spread(path), SPREAD).write.parquet(folder)
    spread = spark.read.schema(SPREAD).parquet(folder)
    words = spread.where("word is not null").groupBy("word").agg(F.collect_list("block").alias("blocks"))
    known = words.join(lattice(words.select("word"), path), "word").select(F.explode("blocks").alias("block"), F.lit(None).cast("long").alias("doc_id"), F.col("word").alias("text"), "ids")
    texts = spread.where("word is null").select("block", "doc_id", "text", F.lit(None).cast("array<int>").alias("ids"))
    dealt = known.unionAll(texts).repartition("block").sortWithinPartitions("block", F.col("ids").isNull())
    return dealt.mapInArrow(_encode_blocks(path, digest), _columns(digest))


def _decode(model: str):
    """Texts of ids, of as many lists at a time as hold about BLOCK bytes, however many rows a batch has."""

    def run(batches):
        pieces = load(model)
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                yield pa.record_batch([batch.column(0)[a:b], pieces.texts(batch.column(1)[a:b])], ["doc_id", "text"])

    return run


DECODED_COLUMNS = "doc_id long, text string"


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", model: str | None = None) -> DataFrame:
    """(doc_id, text) of token id lists; a null list gives a null text."""
    ready(tokens.sparkSession)
    asked = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return asked.mapInArrow(_decode(model or token_file(MODEL)), DECODED_COLUMNS)


def _there_and_back(model: str, seed, memo: int):
    encoded, decoded = _encode(model, seed, False, memo, trips=False), _decode(model)
    return lambda batches: decoded(batch.select(["doc_id", "token_ids"]) for batch in encoded(batches))


def there_and_back(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, memo: int = 1 << 17) -> DataFrame:
    """The rows of ``decode(encode(docs))``, encoded and decoded by one worker, about a megabyte of ids at a time:
    as two steps, each core would have two workers, and ids would be rows between them."""
    path = model or token_file(MODEL)
    return _asked(docs, id_col, text_col).mapInArrow(_there_and_back(path, _seed(docs, text_col, path), memo), DECODED_COLUMNS)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)


def sentencepiece_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: doc_id, n_chars and the SHA-256 of the decoded text."""
    text = there_and_back(table(spark, sf_dir, "documents")).withColumn("text", F.coalesce("text", F.lit("")))
    return text.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


#: Decoding gives the text back.
DECODED = "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
