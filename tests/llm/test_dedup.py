"""Dedup operators against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import urllib.parse
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import components, embeddings, lines, passages, repeats, simhash, substrings

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (5000, "a" * 200), (5001, "a" * 60), (5002, None), (5003, ""), (5004, "b" * 49), (5005, "b" * 50), (5006, "xx" + "b" * 50 + "yy" + "a" * 49),
    (5007, "a b\n" * 60), (5008, "a  b " * 60), (5009, "é" * 25), (5010, "z" + "é" * 25), (-7, "c" * 55), (5011, "c" * 52), (5012, " \t\n"), (5013, "long " * 20000),
    (5014, "q\n\n\n\nq"), (5015, "one\ntwo\nthree\nfour"), (5016, "zero\none\ntwo\nthree\nfour"),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120)
    return d.unionAll(spark.createDataFrame(EDGE, "doc_id long, text string")).withColumn("chunk", F.lit(1)).withColumn("row", F.lit("x")).cache()


def covered(sequences, window):
    """ids ascending -> flags of covered symbols, by a dictionary of all windows of earlier ids."""
    seen, out = set(), {}
    for i, seq in sequences:
        keys = [tuple(seq[j : j + window]) if isinstance(seq, list) else seq[j : j + window] for j in range(len(seq) - window + 1)]
        flags = [False] * len(seq)
        for j, k in enumerate(keys):
            if k in seen:
                flags[j : j + window] = [True] * window
        seen.update(keys)
        out[i] = flags
    return out


@pytest.mark.parametrize("chunk", [20_000, 6 << 20])
def test_substrings(docs, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    texts = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    flags = covered(texts, 50)
    got = {r.doc_id: r for r in substrings.dedup_substrings(docs, spans=True).collect()}
    assert len(got) == len(texts)
    for i, b in texts:
        kept = bytes(x for x, f in zip(b, flags[i]) if not f)
        runs = sum(f and (j == 0 or not flags[i][j - 1]) for j, f in enumerate(flags[i]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(b), sum(flags[i]), runs, hashlib.sha256(kept).hexdigest(), kept)
        assert sum(e - s for s, e in r.spans) == r.n_removed


@pytest.mark.parametrize("chunk", [20_000, 6 << 20])
def test_passages(docs, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    words = sorted((r.doc_id, WORD.findall(r.text or "")) for r in docs.collect())
    flags = covered(words, 50)
    got = {r.doc_id: r for r in passages.dedup_passages(docs, text=True).collect()}
    for i, w in words:
        kept = " ".join(x for x, f in zip(w, flags[i]) if not f)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].kept) == (len(w), sum(flags[i]), hashlib.sha256(kept.encode()).hexdigest(), kept)


@pytest.mark.parametrize("window", [2, 9, 50, 100])
def test_repeats_of_few_symbols_with_hot_triggers_and_short_slices(spark, monkeypatch, window):
    # Two letters alone: nearly every trigger has many surroundings, and many chunks share it.
    for name, value in {"CHUNK_BYTES": 700, "RANGE_BYTES": 3000, "HOT": 2, "SLICE": 64, "COMPARED": 50, "REMEMBERED": 100}.items():
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([0, 20, 90, 300])))) for i in range(40)]
    rows += [(50 + i, rows[i][1][7:] + " a a" * 40) for i in range(0, 20, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for got, sequences in (
        (substrings.dedup_substrings(df, window=window), [(i, t.encode()) for i, t in rows]),
        (passages.dedup_passages(df, window=window), [(i, t.split()) for i, t in rows]),
    ):
        flags = covered(sequences, window)
        assert {r.doc_id: r.n_removed for r in got.collect()} == {i: sum(f) for i, f in flags.items()}


def test_triggers_depend_on_the_gram_alone():
    shape = repeats.Shape(50, 8)
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 5000, dtype=np.uint8).tobytes()
    spec = repeats.Repeats(shape, np.uint8, substrings.Bytes, None, None, None)

    def grams(text):
        table = pa.table({"id": [1], "text": [text.decode()], "row": [0]})
        return {int(a) for at, *_ in repeats.Chunk(table, spec, 0).triggers() for a in at}

    whole, tail = grams(data), grams(data[1000:])
    assert {a - 1000 for a in whole if a >= 1000 + shape.most} == {a for a in tail if a >= shape.most}
    assert all(any(a in whole for a in range(p, p + shape.most + 1)) for p in range(5000 - 50))


def test_corpus_order_against_all_pairs():
    shape = repeats.Shape(50, 8)
    rng = np.random.default_rng(9)
    n = 400
    rows = np.zeros((n, shape.width), np.uint8)
    rows[:, 2:] = rng.integers(0, 2, (n, shape.width - 2)) * (rng.random((n, shape.width - 2)) < 0.02)
    rows[:, 1] = rng.integers(0, shape.most + 1, n)
    key, ids = np.sort(rng.integers(0, 5, n)).astype(np.uint64), rng.integers(0, 50, n)
    marks = substrings.corpus_order(key, ids, rows, shape)
    for l in range(shape.most + 1):
        run = [(int(k), r[2 : 2 + l].tobytes(), r[2 + shape.most : 2 + shape.most + shape.reach - l].tobytes()) if r[0] <= l <= r[1] else None for k, r in zip(key, rows)]
        first = {}
        for r, i in zip(run, ids.tolist()):
            first[r] = min(first.get(r, i), i)
        assert [bool(m >> l & 1) for m in marks.tolist()] == [r is not None and first[r] < i for r, i in zip(run, ids.tolist())]


def test_a_long_text_of_one_letter(spark):
    # Each place is a trigger here, so what a place costs in memory counts.
    text = "a" * 5_000_000
    got = substrings.dedup_substrings(spark.createDataFrame([(1, text), (2, "b" + text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == [(1, 5_000_000, 0), (2, 5_000_001, 5_000_000)]


def test_repeats_of_nothing_and_null_ids(spark, docs):
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0
    assert passages.dedup_passages(docs.limit(0)).count() == 0
    two = spark.createDataFrame([(None, "a" * 60), (1, "a" * 60), (1, "a" * 60), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substrings.dedup_substrings(two).collect()) == [(0, 0, 0), (0, 60, 0), (1, 60, 0), (1, 60, 0)]
    assert {r.n_removed for r in passages.dedup_passages(two).collect()} == {0}


def test_lines_equal_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.where("text is not null").toPandas())
    expected = sorted(con.sql(lines.ORACLE).fetchall())
    got = lines.dedup_lines(docs.where("text is not null"))
    assert got.columns[:4] == docs.columns
    mine = got.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, mine)) == expected
    by = {r.doc_id: r for r in got.collect()}
    assert by[5016].kept_text == "zero" and by[5014].kept_text == "q\n\n\n\nq"
    nulls = lines.dedup_lines(spark.createDataFrame([(None, "a\nb\nc"), (3, None), (2, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.kept_text or "-", r.n_removed) for r in nulls) == [(0, "a\nb\nc", 0), (2, "a\nb\nc", 0), (2, "a\nb\nc", 0), (3, "-", 0)]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 180)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame([*chain, *star, (200, 200), (None, 3)], "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)}


def test_simhash_groups(spark, docs):
    more = [(6000, "Ab  c"), (6001, "ab C"), (6001, "ab C"), (None, "ab c")]
    rows = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted(map(tuple, simhash.near_duplicates(rows).collect()), key=str)
    data, prints = rows.collect(), []
    for r in data:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    a = np.array(prints, np.uint64)
    root = roots(len(a), [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4)])
    least = {}
    for i, r in enumerate(data):
        if r.doc_id is not None:
            least[root[i]] = min(least.get(root[i], 1 << 60), r.doc_id)
    assert got == sorted(((r.doc_id, f"{prints[i]:016x}", least[root[i]]) for i, r in enumerate(data)), key=str)
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_similar_groups(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, family = [], {}
    for g in range(40):
        base = [word() for _ in range(rng.choice([110, 200, 900]))]
        for k in range(4):
            copy = list(base)
            for _ in range(0 if k < 2 else max(1, len(base) // 200)):
                copy[rng.randrange(len(base))] = word()
            rows.append((g * 10 + k, " ".join(copy)))
            family[g * 10 + k] = g * 10
    rows += [(1000 + i, " ".join(word() for _ in range(80))) for i in range(40)] + [(2000, None), (2001, ""), (2002, "be " * 90), (2003, "of " * 90)]
    family |= {i: i for i, _ in rows[160:]} | {2001: 2000}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(0))
    assert dict(map(tuple, simhash.similar_groups(df).collect())) == family
    left = simhash.keep_first(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == set(family.values())
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_similar_groups_link_at_the_limit_and_never_below(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
    rows, family = [], {}
    for g in range(300):
        # 160 shingles of 200 are shared, or 159 of 199.
        both = words(164 - g % 2)
        for k in range(2):
            rows.append((10 * g + k, " ".join(both + words(20))))
            family[10 * g + k] = 10 * g + k * (g % 2)
    got = dict(map(tuple, simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == family


def test_similar_sets_by_brute_force():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, (20, 60), dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k % 20][: 60 - k % 7], rng.integers(0, 1 << 60, k % 9, dtype=np.uint64)])) for k in range(300)]
    links = [(i, j) for i in range(300) for j in range(i) if 5 * len(both := np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - len(both))]
    assert simhash.similar_sets(sets).tolist() == roots(300, links)


@pytest.mark.parametrize("size", [50, 1500])
def test_wide_spanning_connects_what_all_pairs_do(size):
    rng = np.random.default_rng(size)
    items = rng.integers(0, 1 << 63, (size, 4), dtype=np.uint64)
    items[size // 2 :, 1:] = items[0, 1:]
    near = np.bitwise_count(items[:, None] ^ items[None]).sum(axis=2) <= 30
    assert roots(size, simhash.wide_spanning(items, 30)) == roots(size, np.argwhere(near).tolist())


@pytest.mark.parametrize("n", [10, 600_000, 30_000_000, 3_000_000_000])
def test_every_link_shares_a_shard(n):
    rng = random.Random(n)
    assert n >> sum(w for _, w in simhash.shard_keys(n, 4)[0]) <= simhash.SHARD_SIZE
    for _ in range(300):
        fp = rng.getrandbits(64)
        other = fp
        for b in rng.sample(range(64), 4):
            other ^= 1 << b
        assert any(all(fp >> s & (1 << w) - 1 == other >> s & (1 << w) - 1 for s, w in blocks) for blocks in simhash.shard_keys(n, 4))


def clustered():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    return np.unique(np.concatenate([base, *(base[:40] ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)), base[0] ^ np.arange(700, dtype=np.uint64)]))


def test_bk_tree_finds_all_links_without_visiting_all_nodes():
    items = clustered()
    tree = simhash.BKTree(items)
    found = list(zip(*(x.tolist() for x in tree.near(items, 4))))
    assert len(found) == len(set(found)) and set(found) == {(i, int(j)) for i in range(len(items)) for j in np.flatnonzero(np.bitwise_count(items ^ items[i]) <= 4)}
    assert tree.depth > 3 and tree.visited < 0.6 * len(items) ** 2
    assert simhash.BKTree(items[:0]).near(items, 4)[0].tolist() == [] and simhash.BKTree(items[:1]).near(items[:2], 0)[1].tolist() == [0]


@pytest.mark.parametrize("asked", [3, 256])
def test_spanning_connects_what_all_links_do(monkeypatch, asked):
    monkeypatch.setattr(simhash, "ASKED", asked)
    items = np.random.default_rng(1).permutation(clustered())
    pairs = [(i, int(j)) for i in range(len(items)) for j in np.flatnonzero(np.bitwise_count(items ^ items[i]) <= 4)]
    got = simhash.spanning(items, 4)
    assert roots(len(items), got) == roots(len(items), pairs) and set(got) <= set(pairs)


@pytest.mark.parametrize("asked", [1, 40, 256])
def test_spanning_joins_groups_that_grow_side_by_side(monkeypatch, asked):
    # Chains: each fingerprint is linked to the next alone, so a lost link tears a group apart.
    monkeypatch.setattr(simhash, "ASKED", asked)
    rng = np.random.default_rng(asked)
    chain = [rng.integers(0, 1 << 63, 4, dtype=np.uint64)]
    for _ in range(300):
        bits = rng.integers(0, 64, (3, 4)).astype(np.uint64)
        chain.append(chain[-1] ^ np.bitwise_or.reduce(np.uint64(1) << bits, axis=0))
    items = rng.permutation(np.unique(np.concatenate(chain)))
    pairs = [(i, int(j)) for i in range(len(items)) for j in np.flatnonzero(np.bitwise_count(items ^ items[i]) <= 4)]
    got = simhash.spanning(items, 4)
    assert roots(len(items), got) == roots(len(items), pairs) and set(got) <= set(pairs) and len(got) < 2 * len(items)


def test_trees_hold_the_shards_of_a_corpus(spark):
    prints = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    fp = np.unique(np.array([r.fp for r in prints.collect()]).view(np.uint64))
    shards = {}
    for c, blocks in enumerate(simhash.shard_keys(len(fp), 4)):
        for f in fp.tolist():
            shards.setdefault((c, *(f >> s & (1 << w) - 1 for s, w in blocks)), []).append(f)
    assert np.mean([len(x) for x in shards.values()]) > 500
    trees = [simhash.BKTree(np.array(x, np.uint64)) for x in shards.values()]
    for tree in trees:
        tree.near(tree.items, 4)
    assert min(t.depth for t in trees) > 2 and sum(t.visited for t in trees) < 0.7 * sum(len(t.items) ** 2 for t in trees)


def test_large_shards_and_groups_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 40)
    monkeypatch.setattr(simhash, "LARGE_SETS", 1500)
    items = [(int(x),) for x in clustered().view(np.int64)]
    df = spark.createDataFrame(items, "fp long")
    pairs = [(r.src, r.dst) for r in simhash.near_links(df, len(items), 4).collect()]
    place = {f: i for i, (f,) in enumerate(items)}
    a = np.array([f for f, in items]).view(np.uint64)
    every = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4)]
    assert roots(len(a), [(place[x], place[y]) for x, y in pairs]) == roots(len(a), every)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:90] + [f"x{rng.random()}"] + base[91:])) for i in range(60)] + [(100 + i, f"other text {i} " * 3) for i in range(5)]
    got = dict(map(tuple, simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {i: 0 if i < 60 else i for i, _ in rows}


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (2, long, "b"), (1, "short", "c"), (None, "short", "d"), (None, "alone", "e"), (None, "alone", "e"), (3, None, "f"), (4, "", "g")]
    left = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, row string"))
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, long, "a"), (1, "short", "c"), (None, "alone", "e"), (3, None, "f")], key=str)
    # Rows of one id with near texts are one group as well.
    near = spark.createDataFrame([(1, long + " x"), (1, long + " y"), (2, long)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_first(near).collect()] == [1]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + rng.normal(size=(30, 16)) * 0.25, np.repeat(base[:1], 40, axis=0)]).astype(np.float32)
    v = x[0].tolist()
    odd = [None, [], [0.0] * 16, [float("nan"), *v[1:]], [None, *v[1:]], [float("inf"), *v[1:]], [2 * t for t in v]]
    rows = [(i, e) for i, e in enumerate([*x.tolist(), *odd])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit("clash"))
    got = sorted(map(tuple, embeddings.near_duplicate_vectors(df, margin=None).collect()))
    unit = np.zeros((len(rows), 16))
    for i, e in rows:
        if e and None not in e and np.isfinite(e).all() and any(e):
            unit[i] = np.array(e) / np.linalg.norm(e)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = roots(len(rows), np.argwhere(near).tolist())
    assert got == [(i, int(near[i].sum()), root[i], root[i] == i) for i in range(len(rows))]
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vector_recall_with_the_default_margin(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicate_vectors(df).collect()}
    rows = sorted(df.select("vec_id", "embedding").collect())
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert all(got[r.vec_id] <= t for r, t in zip(rows, true))
    assert sum(got.values()) >= 0.99 * true.sum()


def test_vectors_of_few_effective_dimensions_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_SIZE", 100)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(2000, 8)) @ rng.normal(size=(8, 256))).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = roots(len(x), np.argwhere(near).tolist())
    got = sorted(map(tuple, embeddings.near_duplicate_vectors(df).collect()))
    found, links = sum(r[1] for r in got), int(near.sum())
    assert got == [(i, int(near[i].sum()), root[i], root[i] == i) for i in range(len(x))], f"{found} of {links} links"


def files_of(spark):
    """Bytes of shuffle files and checkpoints."""
    local = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    at = urllib.parse.urlparse(spark.sparkContext.getCheckpointDir()).path
    return {p: p.stat().st_size for d in (*local, at) for p in Path(d).rglob("*") if p.is_file()}


def test_vectors_are_written_a_few_times_however_many_cells_meet(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_SIZE", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x[3000:] = x[:1000] + rng.normal(size=(1000, 64)) * 0.2
    df = spark.createDataFrame(list(enumerate(x.astype(np.float32).tolist())), "vec_id long, embedding array<float>")
    before = files_of(spark)
    got = embeddings.near_duplicate_vectors(df).collect()
    written = sum(n for p, n in files_of(spark).items() if p not in before)
    assert sum(r.n_links > 0 for r in got) == 2000
    assert written < 10 * x.size * 4, written / (x.size * 4)


def test_groups_leave_no_link_out():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(30, 6)), rng.integers(1, 12, 30), axis=0)
    x = embeddings.scaled(x + rng.normal(size=x.shape) * rng.choice([0.02, 0.2, 0.5], (len(x), 1)))
    for threshold in (0.5, 0.9, 0.99, 1 - 1e-9):
        blocks = []
        for number, own in enumerate((x[::2], x[1::2])):
            rows = pa.table({"block": [number] * len(own), "last": [1] * len(own), "cell": pa.array([-1] * len(own), pa.int32()), "width": pa.array([6] * len(own), pa.int32()), "point": np.arange(len(own)), "size": np.ones(len(own), np.int64), "embedding": pa.array(own.tolist())})
            blocks.append(embeddings.Block(embeddings._pack(threshold, np.float64)((pa.scalar(number),), rows).to_pylist()[0], "", np.float64))
        for a, b in ((0, 1), (0, 0)):
            got = {(blocks[a].points[i], blocks[b].points[j]) for i, hit in embeddings.linked(blocks[a], blocks[b], None, threshold) for j in hit}
            want = {(i, j) for i, j in np.argwhere(blocks[a].x[np.argsort(blocks[a].points)] @ blocks[b].x[np.argsort(blocks[b].points)].T >= threshold).tolist()}
            assert (got if a != b else {tuple(sorted(p)) for p in got}) == (want if a != b else {(i, j) for i, j in want if i < j})


def brute_vectors(rows):
    """(vec_id, n_links, component_id, kept) of each row, by the vectors of each length."""
    near = np.zeros((len(rows), len(rows)), bool)
    for w in {len(e) for _, e in rows if e}:
        at = [i for i, (_, e) in enumerate(rows) if e and len(e) == w and None not in e and np.isfinite(e).all() and any(e)]
        x = np.array([rows[i][1] for i in at], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near[np.ix_(at, at)] = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = roots(len(rows), np.argwhere(near).tolist())
    least = {}
    for r, (i, _) in zip(root, rows):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, int(near[k].sum()), least[root[k]], i == least[root[k]]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [7, 4000])
def test_vectors_of_several_lengths_with_null_and_repeated_ids(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "CELL_SIZE", 30)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(7)
    rows = []
    for k, (width, n) in enumerate(((16, 100), (8, 90), (3, 12), (1, 3))):
        x = rng.normal(size=(n, width))
        x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, width)) * 0.15
        rows += [(1000 * k + i, e) for i, e in enumerate(x.astype(np.float32).tolist())]
    rows += [(None, rows[0][1]), (None, [0.0] * 16), (1, rows[1][1]), (1, rows[2][1]), (5000, []), (5001, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(16)
    assert sorted(map(tuple, embeddings.near_duplicate_vectors(df).collect()), key=str) == brute_vectors(rows)
