"""Token, language, quality and mixing operators against libraries, brute force and held-out labels."""

import collections
import hashlib
import heapq
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import langid, mixture, oracles, pieces, quality, tokencounts
from folioflow.llm.tokenfiles import token_file

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(5000, None, None, None), (5001, "", "en", None), (5002, " \t\n", "en", "src1"), (5003, "a\na\n a\n\n", None, "src1"), (5004, "é b\n" * 30, "fr", "src0"), (5005, "12 !? 34", "de", ""), (5006, "word " * 30000, "en", "src2")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    return d.unionAll(spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")).withColumn("taken", F.lit(0)).cache()


def odd_texts():
    rng = random.Random(4)
    some = ["Hello  World's it's é世 don't I'LL", "a<|endoftext|>b <|STARTOFTEXT|><|endoftext|>", "ſtop İstanbul ΑΣ Σ", "x\xa0y\x85z 12 ½", "a\x1cb\x00c 'S", "a" * 400, "##$$%%^^" * 30, "= = ==  ==", "http://a.b/c?d=1&e=2//--->", "\n\n x\n ", "<s> </s> <0x0A>", "ab　c\r\n"]
    return [*some, *("".join(rng.choice("abcdeéß世'. \n!0Ω/-<>") for _ in range(150)) for _ in range(100))]


def test_counts_equal_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(token_file(tokencounts.MODEL))
    extra = spark.createDataFrame([(9000 + i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionAll(extra)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencounts.token_counts(both).collect()}
    for r in both.collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 2048), r.doc_id
    model = tokencounts.PrefixCounter(token_file(tokencounts.MODEL))
    for word in ("internationalization", "été", "thonwhre"):
        assert model.prefixes(word) == [0, *(len(lib.encode(word[:i], add_special_tokens=False).ids) for i in range(1, len(word) + 1))]
    text = "the quick brown internationalization of everything"
    fits = model.longest_fit(text, 5)
    assert len(lib.encode(" ".join(text.split()[:fits]), add_special_tokens=False).ids) <= 5 < len(lib.encode(" ".join(text.split()[: fits + 1]), add_special_tokens=False).ids)
    assert tokencounts.token_counts(docs.limit(0)).count() == 0


def test_every_code_point_is_counted_as_the_library_does():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(token_file(tokencounts.MODEL))
    model = tokencounts.PrefixCounter(token_file(tokencounts.MODEL))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"x{c}y {c}" for c in every[a : a + 50]) for a in range(0, len(every), 50)]
    rng = random.Random(5)
    odd = [c for a, b in ((0, 0x3000), (0xA700, 0xAC20), (0xF900, 0x10000), (0x1D400, 0x1F000)) for c in map(chr, range(a, b)) if not 0xD800 <= ord(c) < 0xE000]
    texts += ["".join(rng.choice(odd) for _ in range(40)) for _ in range(4000)]
    texts += ["a\ua7cb b", "\ua7dc", "\u058c\uac00", "\xa8\u058b", "e\u0301 E\u0301", "\u212b", "a\x85b\x1cc\u3000d"]
    for text, n in zip(texts, lib.encode_batch_fast(texts, add_special_tokens=False)):
        assert model.count(text) == len(n.ids), text


def test_prefix_counts_answer_budgets(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(token_file(tokencounts.MODEL))
    text = "The quick <|endoftext|> brown INTERNATIONALIZATION of été"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n"), (1, text)], "doc_id long, text string").withColumn("running", F.lit("x"))
    found = tokencounts.prefix_counts(rows)
    got = sorted(map(tuple, tokencounts.within_budget(found, 6).select("doc_id", "n_items", "n_tokens", "fits", "budget_items", "budget_tokens").collect()))
    total = len(lib.encode(text, add_special_tokens=False).ids)
    assert got == [(1, 7, total, False, 5, 6)] * 2 + [(i, 0, 0, True, 0, 0) for i in (2, 3, 4)]
    cut = {r.doc_id: r for r in tokencounts.truncate_to(rows, 6).collect()}
    assert cut[1]["items"] == ["the", "quick", "<|endoftext|>", "brown", "internationalization"] and cut[1].n_tokens == 6 and cut[2]["items"] == []
    whole = tokencounts.within_budget(tokencounts.prefix_counts(docs), 2048).join(tokencounts.token_counts(docs).withColumnRenamed("n_tokens", "n"), "doc_id")
    assert whole.where("n <> n_tokens or fits = over_limit or budget_tokens > 2048").count() == 0
    assert tokencounts.within_budget(found, -1).where("budget_items <> 0 or budget_tokens <> 0").count() == 0
    assert tokencounts.truncate_to(rows.limit(0), 5).count() == 0 == tokencounts.prefix_counts(rows.limit(0)).count()


def test_memo_keeps_no_long_words():
    memo = tokencounts.Memo(len, most=2, longest=5)
    assert [memo[k] for k in ("a", "bb", "long word", "a")] == [1, 2, 9, 1] and set(memo) == {"a", "bb"}
    assert memo["ccc"] == 3 and set(memo) == {"ccc"}


def test_decoded_tokens_are_the_texts(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, pieces.sentencepiece_decode(spark, SF).select("doc_id", "n_chars", "text_sha256").collect()))
    assert got == sorted(con.execute(oracles.ORACLES["sentencepiece_decode"]).fetchall())


def test_pieces_equal_the_library_and_round_trip(spark, docs):
    spm = pytest.importorskip("sentencepiece")
    lib = spm.SentencePieceProcessor(model_file=token_file(pieces.MODEL))
    extra = spark.createDataFrame([(9000 + i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionAll(extra)
    coded = pieces.encode(both)
    got = {r.doc_id: r for r in coded.collect()}
    for r in both.collect():
        assert got[r.doc_id].token_ids == lib.encode(r.text or ""), r.doc_id
        assert got[r.doc_id].round_trip
    back = {r.doc_id: r.text for r in pieces.decode(coded).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in both.collect())
    digests = {r.doc_id: r.ids_sha256 for r in pieces.encode(both, digest=True).collect()}
    assert all(digests[i] == hashlib.sha256(np.array(r.token_ids, "<u4").tobytes()).hexdigest() for i, r in got.items())
    assert pieces.encode(docs.limit(0)).count() == 0


def test_round_trip_decodes_the_ids():
    model = pieces.load(token_file(pieces.MODEL))
    texts = ["", "hello world", " two  spaces\n", "世界é\x00", "a▁b", "", "x" * 50]
    ids = [model.encode(t) for t in texts]
    assert model.round_trips(texts, ids) == [t != "a▁b" for t in texts] == [model.decode(i.tolist()) == t for t, i in zip(texts, ids)]
    # Ids that stand for something else are found, wherever they come from.
    assert model.round_trips(["hello", "world", ""], [ids[1], ids[1][:0], ids[0]]) == [False, False, True]
    model.memo["▁wrong"] = model.encode_word("▁right")
    try:
        assert model.round_trips(["wrong"], [model.encode("wrong")]) == [False]
    finally:
        del model.memo["▁wrong"]
    assert model.round_trips([], []) == [] and model.round_trips([""], ids[:1]) == [True]


def test_blocks_hold_every_text_once_and_few_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 10)
    texts = [None, "", "abc", "é" * 4, None, "x" * 35, "", "yz", *"abcdefghijkl", None]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()).slice(2), pa.array([], pa.string()), pa.array([None], pa.string())):
        found = pieces.blocks(column)
        assert [k for a, b in found for k in range(a, b)] == list(range(len(column)))
        sizes = [[len((t or "").encode()) for t in column[a:b].to_pylist()] for a, b in found]
        assert all(sum(s) - max(s) <= 10 for s in sizes)
    assert len(pieces.blocks(pa.array(texts))) > 3


def test_lattice_in_spark_equals_the_fold(spark):
    words = ["▁hello", "▁thonwhre", "\n", "▁▁▁▁▁x", "世界é", "a" * 40, "▁internationalization", "."]
    path = token_file(pieces.MODEL)
    model = pieces.load(path)
    got = {r.word: r.ids for r in pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), path).collect()}
    assert got == {w: np.frombuffer(model.encode_word(w), np.int32).tolist() for w in words}


def test_pipeline_takes_every_word_from_the_lattice(spark, monkeypatch):
    """A word that occurs once, and the parts of a long one, get the ids that the lattice says, whatever these are."""
    import corpus_pipeline as p

    real, long = pieces.lattice, "世" * 70 + "zyxq" + "界" * 30
    other = lambda words, model: real(words, model).withColumn("ids", F.when(F.col("word").isin("▁zyxqvw", "世"), F.array(F.lit(300), F.lit(301))).otherwise(F.col("ids")))
    rows = spark.createDataFrame([(1, "one two one"), (2, "two zyxqvw"), (3, long), (4, None)], "doc_id long, text string")
    plain = {r.doc_id: r for r in p.encoding_stage(spark, rows, "").collect()}
    monkeypatch.setattr(pieces, "lattice", other)
    got = {r.doc_id: r for r in p.encoding_stage(spark, rows, "").collect()}
    assert all(plain[i].round_trip for i in plain) and {i: got[i].round_trip for i in got} == {1: True, 2: False, 3: False, 4: True}
    assert got[1] == plain[1] and got[2].token_ids[-2:] == [300, 301] and got[3].token_ids.count(300) == 70


def test_blocks_of_texts_equal_the_library(spark, docs, monkeypatch):
    spm = pytest.importorskip("sentencepiece")
    lib = spm.SentencePieceProcessor(model_file=token_file(pieces.MODEL))
    odd = [*odd_texts(), "=" * 100 + " " * 200 + "x", "-" * 1500, "https://" + "a1b2/" * 40, "hello" * 60 + "é" * 70, "\n\n", "a\r\nb"]
    extra = spark.createDataFrame([*((9000 + i, t) for i, t in enumerate(odd)), (None, "again"), (None, "again")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionAll(extra)
    got = pieces.encode_by_blocks(both).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.token_ids) for r in got) == sorted((r.doc_id or 0, len(ids), ids) for r in both.collect() for ids in [lib.encode(r.text or "")])
    digests = sorted((r.doc_id or 0, r.ids_sha256) for r in pieces.encode_by_blocks(both, digest=True).collect())
    assert digests == sorted((r.doc_id or 0, hashlib.sha256(np.array(r.token_ids, "<u4").tobytes()).hexdigest()) for r in got)
    assert pieces.encode_by_blocks(docs.limit(0)).count() == 0


def test_a_task_holds_the_words_of_one_block(monkeypatch):
    path = token_file(pieces.MODEL)
    model = pieces.load(path)
    monkeypatch.setattr(pieces, "BLOCK", 40)
    monkeypatch.setattr(pieces, "BLOCK_WORDS", 20)
    monkeypatch.setattr(pieces.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    texts = [" ".join(f"w{i}x{k}" for k in range(5)) for i in range(40)]
    rows = [r for b in pieces._spread(path)([pa.record_batch([pa.array(range(40), pa.int64()), pa.array(texts)], ["doc_id", "text"])]) for r in b.to_pylist()]
    found = {k: [r for r in rows if r["block"] == k] for k in sorted({r["block"] for r in rows})}
    assert len(found) > 5 and all(sum(r["word"] is not None for r in x) < 40 for x in found.values())
    ids = pa.list_(pa.int32())
    batches = []
    for x in found.values():
        words = [r["word"] for r in x if r["word"] is not None]
        kept = [r for r in x if r["word"] is None]
        values = [np.frombuffer(model.encode_word(w), np.int32).tolist() for w in words] + [None] * len(kept)
        batches.append(pa.record_batch([pa.array([r["block"] for r in x]), pa.array([None] * len(words) + [r["doc_id"] for r in kept], pa.int64()), pa.array(words + [r["text"] for r in kept]), pa.array(values, ids)], ["block", "doc_id", "text", "ids"]))
    memo, got = model.memo, []
    try:
        for b in pieces._encode_blocks(path, False)(batches):
            got += b.to_pylist()
            assert len(model.memo) < 40
        with pytest.raises(ValueError, match="lattice"):
            model.encode("unheard")
    finally:
        model.memo = memo
    assert [r["token_ids"] for r in sorted(got, key=lambda r: r["doc_id"])] == [model.encode(t).tolist() for t in texts]


def test_parts_of_long_words(spark):
    path = token_file(pieces.MODEL)
    model = pieces.load(path)
    words = ["▁" + "thonwhre" * 20, "世界" * 50, "=" * 500, "▁" * 63, "x1" * 40 + "é" * 3, "▁short"]
    for w in words:
        found = model.parts(w)
        assert "".join(found) == w and b"".join(map(model.encode_word, found)) == model.encode_word(w)
    assert model.parts("世界" * 50) == list("世界" * 50)
    got = {r.word: r.ids for r in pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), path).collect()}
    assert got == {w: np.frombuffer(model.encode_word(w), np.int32).tolist() for w in words}


def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for r in docs.collect():
        t, w = r.text or "", WORD.findall(r.text or "")
        count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        flag = [False] * len(w)
        for i in range(len(w) - 7):
            if count[tuple(w[i : i + 8])] > 1:
                flag[i : i + 8] = [True] * 8
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, sum(flag))
        assert g.base_failed == (len(w) < 20 or 100 * sum(flag) > 30 * len(w)) and not (g.base_failed and g.kept)
    assert quality.quality(docs.limit(0)).count() == 0


def test_quality_keeps_good_and_drops_bad(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.quality(d).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in judged.collect()}
    assert kept[1] > 0.98 and kept[0] < 0.4
    stay = quality.keep_good(d.withColumn("kept", F.lit("x")).withColumn("row", F.lit(1)))
    assert stay.count() == quality.quality(d).where("kept").count() and stay.columns == [*d.columns, "kept", "row"]


def test_fences_by_hand(spark):
    rows = [(1, "en", "dup_lines", b, n) for b, n in ((0, 180), (10, 18), (400, 2))]  # the 198th of 200 is the 99th hundredth
    rows += [(1, "en", "length", b, n) for b, n in ((40, 19), (44, 1), (50, 160), (53, 20))]  # the 20th and the 180th
    rows += [(1, "fr", "length", 50, 1000), (1, "de", "length", 50, 100), (1, "de", "length", 60, 99), (2, None, "length", 50, 9)]
    df = spark.createDataFrame([(a, b, None, *c) for a, b, *c in rows], "level int, lang string, source string, ratio string, bucket long, n long")
    assert sorted((r.lang or "", r.ratio, r.low, r.high) for r in quality.fences(df).collect()) == [("", "length", 50, 50), ("en", "dup_lines", None, 20), ("en", "length", 26, 50)]


def test_fences_follow_their_groups(spark):
    rng = random.Random(3)
    word = lambda size: "".join(rng.choice("abcdefgh") for _ in range(size))
    text = lambda low, high, marks: " ".join("#" * (i < marks) + word(rng.randrange(low, high) - (i < marks)) for i in range(60))
    rows = [(i, text(3, 6, 0), "en", "prose") for i in range(250)] + [(1000 + i, text(8, 14, i % 9), "en", "code") for i in range(250)]
    rows += [(2000, text(3, 6, 8), "en", "prose"), (2001, text(8, 14, 8), "en", "code"), (2002, text(8, 14, 0), "en", "prose"), (2003, text(3, 6, 0), "en", "code"), (2004, text(3, 6, 0), "en", "few")]
    kept = against_sql(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert [kept[i] for i in range(2000, 2005)] == [True, True, False, False, True]
    assert sum(kept.values()) >= 495
    found = {(r.of_source): r for r in quality.limits(quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id", "text", "lang", "source")).collect()}
    assert found["prose"].high_length < found["code"].low_length and found["few"].low_length < found["prose"].low_length


def against_sql(rows):
    docs = rows.toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", docs)
    want = sorted(con.execute(oracles.ORACLES["op9_quality_rules"]).fetchall())
    got = sorted(map(tuple, quality.quality(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()))
    assert got == want
    return {r[0]: r[-1] for r in got}


def test_texts_without_words_stay_out_of_the_fences(spark):
    rng = random.Random(9)
    text = lambda size: " ".join("".join(rng.choice("abcdefgh") for _ in range(size)) for _ in range(60))
    rows = [(i, text(5), "en", "hot") for i in range(200)] + [(i, (None, "", " \n")[i % 3], "en", "hot") for i in range(200, 300)] + [(300 + i, text(40), "en", "hot") for i in range(5)]
    kept = against_sql(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(i for i in kept if kept[i]) == list(range(200))


def test_long_words_are_judged_on_the_scale_of_their_fences(spark):
    rng = random.Random(10)
    text = lambda size: " ".join("".join(rng.choice("abcdefgh") for _ in range(size + rng.randrange(20))) for _ in range(30))
    rows = [(i, text(110 + i % 40), "zh", "books") for i in range(200)] + [(200 + i, text(900), "zh", "books") for i in range(5)]
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sorted(i for i in kept if kept[i]) == list(range(200))


def test_apportionment():
    assert mixture.targets([100, 100, 100], [5, 2, 1]) == [Fraction(1500, 8), 75, Fraction(75, 2)]
    assert mixture.targets([10, 100, 0, 190], [5, 2, 1, 5]) == [30, Fraction(270 * 2, 7), 0, Fraction(270 * 5, 7)]
    rng = random.Random(1)
    for _ in range(200):
        shares, seats = [rng.randrange(0, 500) for _ in range(rng.randrange(1, 9))], rng.randrange(0, 200)
        plain = [0] * len(shares)
        for _ in range(seats if sum(shares) else 0):
            i = max(range(len(shares)), key=lambda i: (Fraction(shares[i], 2 * plain[i] + 1), -i))
            plain[i] += 1
        assert mixture.sainte_lague(shares, seats, [10**9] * len(shares)) == plain


def test_mix(docs):
    got = mixture.mix(docs).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in got) and len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rows in by.values():
        assert sum(r.size for r in rows) == rows[0].source_size and abs(sum(r.taken for r in rows) - rows[0].target) <= max(2, 0.01 * rows[0].target)
    assert sorted(map(str, got)) == sorted(map(str, mixture.mix(docs.repartition(7)).collect()))
    out = mixture.mixed_documents(docs)
    assert out.columns == docs.columns
    words = collections.Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == {r.doc_id: r.taken for r in got if r.taken}
    twice = mixture.mixed_documents(docs.unionAll(docs)).collect()
    assert abs(sum(len(WORD.findall(r.text)) for r in twice) - 2 * sum(size.values())) < 2 * len(size)
    assert mixture.mix(docs.limit(0)).count() == 0 == mixture.mixed_documents(docs.limit(0)).count()


def highest(shares, seats, limits):
    """Seats one by one to the highest quotient."""
    given, heap = [0] * len(shares), [(-Fraction(s), i) for i, (s, limit) in enumerate(zip(shares, limits)) if s and limit]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < limits[i]:
            heapq.heappush(heap, (-Fraction(shares[i]) / (2 * given[i] + 1), i))
    return given


def brute_mix(rows):
    """(doc_id, text, size, words taken) of each row, and all words that are taken. Equal rows stand side by side."""
    data = rows.select("doc_id", "source", F.xxhash64("text").alias("row"), F.xxhash64(F.lit(mixture.SEED), "doc_id", F.xxhash64("text")).alias("draw"), "text").collect()
    by = collections.defaultdict(list)
    for r in data:
        by[r.source].append((r.draw, r.doc_id, r.row, len(WORD.findall(r.text or "")), r.text))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(x[3] for x in by[s]) for s in names]
    goal = mixture.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    parts = [max(1, len(by[s]) // mixture.SHARD_DOCS) for s in names]
    block = max(1, min([sum(sizes) // mixture.MIX_BLOCKS, *(s // (100 * n) for s, n in zip(sizes, parts) if s)]))
    quota, out = highest(goal, int(sum(goal)) // block, [3 * s // block for s in sizes]), []
    for name, n, blocks in zip(names, parts, quota):
        shards = [sorted((x for x in by[name] if x[0] % n == k), key=lambda x: (x[0], x[1] is not None, x[1], x[2])) for k in range(n)]
        shards = [x for x in shards if x]
        words = [sum(x[3] for x in shard) for shard in shards]
        for shard, b in zip(shards, highest(words, blocks, [3 * w // block for w in words])):
            line = [i for i, d in enumerate(shard) for _ in range(d[3])]
            taken = collections.Counter((line * 3)[: b * block])
            out += [(d[1], d[4], d[3], taken[i]) for i, d in enumerate(shard)]
    return out, sum(quota) * block


def test_taken_words_by_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(mixture, "SHARD_DOCS", 4)
    rows = docs.unionAll(docs.limit(9)).unionAll(spark.createDataFrame([(None, "a b c", "en", None), (7000, None, None, None)], "doc_id long, text string, lang string, source string").withColumn("taken", F.lit(1)))
    want, total = brute_mix(rows)
    got = [(r.doc_id, r.size, r.taken) for r in mixture.mix(rows).collect()]
    assert sorted(got, key=str) == sorted(((i, size, taken) for i, _, size, taken in want), key=str) and sum(x[2] for x in got) == total


def test_language_id(spark, docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.identify(d).join(d, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.97 and r.lo >= 0 and r.hi <= 1
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert [got[i] for i in (5000, 5001, 5002, 5005)] == ["und"] * 4 and len(got) == docs.count()
    hidden = docs.withColumns({"lang": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang"))})
    assert {r.doc_id: r.lang_pred for r in langid.identify(hidden).collect()} == got
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_scores_against_plain_kernels():
    # The kernel, the whitened landmarks and the ridge regression, written out with sets and solve.
    rng = random.Random(21)
    some = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(25))
    texts = [some(letters) for letters in ("abcd", "bcde", "xyza") for _ in range(10)]
    labels = [x for x in ("p", "q", "r") for _ in range(10)]
    model = langid.fit(texts, labels)

    def grams(t):
        b = re.sub(rb"[\x00-\x20\x30-\x39]", b" ", t.encode().lower())
        return {(n, b[i : i + n]) for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    marks = [i for x in ("p", "q", "r") for i in range(30) if labels[i] == x][: 3 * (langid.LANDMARKS // 3)]
    seen = set().union(*(grams(texts[i]) for i in marks))
    sets = [grams(t) & seen for t in [*texts, some("abcd"), some("xyza")]]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(a, sets[m]) for m in marks] for a in sets])
    value, vector = np.linalg.eigh(k[marks])
    keep = value > 1e-6 * value.max()
    z = k @ (vector[:, keep] / np.sqrt(value[keep]))
    y = np.array([[x == w for w in ("p", "q", "r")] for x in labels], float)
    fitted = z[:30]
    want = z @ np.linalg.solve(fitted.T @ fitted / 10 + langid.RIDGE * np.eye(z.shape[1]), fitted.T @ y / 10)
    got = model.scores(langid.Texts.of(pa.array([*texts, ""])))
    assert np.abs(got[:30] - want[:30]).max() < 2e-3 and got[30].tolist() == [0, 0, 0]


def test_the_fit_of_many_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 40_000)
    rows = [(i, f"text {i} " * 100, f"l{i % 40}") for i in range(4000)]
    sample = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()
    assert len({r.lang for r in sample}) == 40 and sum(len(r.text) for r in sample) <= 40_000 + 40 * 1000


def test_language_id_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "some words here", "en"), (1, "some words here", "en"), (1, "andere worte", "de"), (None, "some words", None), (None, "some words", None), (3, None, "en"), (8, "andere worte da", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"held_out": F.lit(1), "score": F.lit("x"), "lang_pred": F.lit("y")})
    got = langid.identify(df).collect()
    assert len(got) == 7 and len({(r.lang_pred, r.score) for r in got if r.doc_id is None}) == 1 and all(r.held_out is not None for r in got)


def test_languages_of_long_texts_only_and_of_more_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 30_000)
    rng = random.Random(11)
    some = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))
    rows = [(i, some("abcde", 40), "aa") for i in range(40)] + [(100 + i, some("fghij", 40), "bb") for i in range(40)] + [(200 + i, some("klmno", 4000), "cc") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(df).collect()} == {r[0]: r[2] for r in rows}
    assert {r.lang_pred for r in langid.identify(df, langs=2).collect()} == {"aa", "bb"}


def test_pipeline_by_brute_force(spark):
    """Every stage written out plainly, each on what the one before it left, down to the token ids."""
    sentencepiece = pytest.importorskip("sentencepiece")
    import corpus_pipeline as p

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    good = {r[0] for r in con.execute(oracles.ORACLES["op9_quality_rules"]).fetchall() if r[-1]}
    docs = sorted((r for r in documents.collect() if r.doc_id in good), key=lambda r: r.doc_id)
    seen, texts = set(), {}
    for r in docs:
        lines = r.text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if WORD.search("".join(w)):
                gone.update(range(i, i + 3) if w in seen else ())
                seen.add(w)
        texts[r.doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    shingles = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles[i] = {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    group = {}
    for i in texts:
        if i not in group:
            group[i], queue = i, [i]
            while queue:
                a = queue.pop()
                for b in texts:
                    both = len(shingles[a] & shingles[b])
                    if b not in group and (5 * both >= 4 * (len(shingles[a]) + len(shingles[b]) - both)):
                        group[b] = i
                        queue.append(b)
    left = spark.createDataFrame([(r.doc_id, texts[r.doc_id], r.lang, r.source, len(texts[r.doc_id])) for r in docs if group[r.doc_id] == r.doc_id], documents.schema)
    library, want = sentencepiece.SentencePieceProcessor(model_file=token_file(pieces.MODEL)), []
    for i, text, size, taken in brute_mix(left)[0]:
        want += [(i, text)] * (taken // size if size else 0)
        if size and taken % size:
            want.append((i, text[: list(WORD.finditer(text))[taken % size - 1].end()]))
    want = sorted((i, len(ids), ids) for i, ids in ((i, library.encode(t)) for i, t in want))
    assert sorted((r.doc_id, r.n_tokens, r.token_ids) for r in p.run(spark, SF).collect()) == want and len(want) > 100


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(5000, None, None, None, None), (5001, "", None, None, 0), (None, "a b c " * 30, "en", None, 180)], docs.schema)
    now = docs.unionAll(odd)
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns, name
        now = after.checkpoint()
    last = p.STAGES[-1][1](spark, now, SF)
    assert last.count() == now.count() > 100
    assert p.run(spark, SF).count() > 100
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_decoding_holds_few_ids_at_a_time(monkeypatch):
    path = token_file(pieces.MODEL)
    model = pieces.load(path)
    texts = [*odd_texts(), None, "", " x", "word " * 3000, "a▁b"]
    lists = pa.array([None if t is None else model.encode(t) for t in texts], pa.list_(pa.int32()))
    batch = pa.record_batch([pa.array(range(len(texts))), lists], ["doc_id", "ids"])
    monkeypatch.setattr(pieces, "BLOCK", 4000)
    got = list(pieces._decode(path)([batch, batch.slice(3, 2), batch.slice(0, 0)]))
    # Beside one longer text, a block holds few ids, however many rows a batch has.
    held = [[len(lists[i].as_py() or []) for i in b["doc_id"].to_pylist()] for b in got]
    assert len(got) > 10 and all(sum(n) - max(n) <= 1000 for n in held)
    want = [None if t is None else model.decode(model.encode(t).tolist()) for t in texts]
    assert [x for b in got for x in b["text"].to_pylist()] == want + want[3:5]
    # A byte that is no text of its own, and ids that aren't any.
    assert model.texts(pa.array([[model.bytes_id + 0xE9], []], pa.list_(pa.int32()))).to_pylist() == ["�", ""]
    for wrong in ([None], [len(model.out)]):
        with pytest.raises((ValueError, IndexError)):
            model.texts(pa.array([wrong], pa.list_(pa.int32())))


def test_there_and_back_is_one_python_step(spark, docs):
    extra = spark.createDataFrame([(9000 + i, t) for i, t in enumerate([*odd_texts(), "a▁b", "same", "same"])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionAll(extra)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert rows(pieces.there_and_back(both, memo=50)) == rows(pieces.decode(pieces.encode(both)))
    assert pieces.there_and_back(docs.limit(0)).count() == 0
    assert pieces.sentencepiece_decode(spark, SF)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
