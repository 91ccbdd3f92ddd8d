"""Single operators against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import columns as C
from folioflow.operators import bands
from folioflow.operators.backends import fold_stream
from folioflow.options import Options
from folioflow.sources.bundles import page_ids
from folioflow.streaming.loop import Loop, open_now


def model_bands(rows, threshold, least):
    out, start = [], None
    for y, b in enumerate(rows):
        if b > threshold:
            start = y if start is None else start
        elif start is not None:
            if y - start >= least:
                out.append((start + (y - start) // 2, y - start))
            start = None
    return out


def model_cuts(gaps, target):
    cuts, last = [], 0
    for y, gap in gaps:
        if y - last < 0.7 * target:
            continue
        later = [f for f in gaps if f[0] > y and f[0] - last <= 1.3 * target and f[1] > 1.3 * gap]
        last = later[0][0] if later else y
        cuts.append(last)
    return cuts


def test_bands_and_cuts_equal_a_plain_model(spark):
    rng = random.Random(5)
    pages = [(i, [float(rng.random() < rng.choice([0.3, 0.7, 0.95])) for _ in range(rng.choice([1, 5, 60, 200]))]) for i in range(60)]
    pages += [(100, [1.0] * 50), (101, [0.0] * 50), (102, [1.0] * 10 + [0.0]), (103, [0.0] + [1.0] * 10)]
    df = spark.createDataFrame(pages, "page int, profile array<double>")
    found = bands.white_bands(bands.rows_of(df, "page", "profile"), "page", 0.5, 2)
    mine = {}
    for r in found.orderBy("y").collect():
        mine.setdefault(r.page, []).append((r.y, r.height))
    expected = {i: b for i, p in pages if (b := model_bands(p, 0.5, 2))}
    assert mine == expected
    assert {r.page: r.cuts for r in bands.cuts(found, "page", 12).collect()} == {i: model_cuts(b, 12) for i, b in expected.items()}


@pytest.mark.parametrize("raw, safe", [("a/b:c", "a_b_c"), ("///", "___"), ("   ", "untitled"), ("Été", "Été"), ("日本 1", "日本 1"), ("", "untitled")])
def test_safe_title(spark, raw, safe):
    assert spark.createDataFrame([(raw,)], "t string").select(C.safe_title(F.col("t"))).first()[0] == safe


def test_windows():
    at = lambda h, m: (h * 60 + m) * 60.0
    assert open_now("", 0) and open_now("sometimes", 0) and open_now("01:00-07:00", at(7, 0)) and not open_now("01:00-07:00", at(7, 1))
    assert open_now("23:00-06:00", at(23, 0)) and open_now("23:00-06:00", at(5, 0)) and not open_now("23:00-06:00", at(12, 0))


def test_stream_fold():
    assert fold_stream([b'{"response": " a"}', b"", b'{"response": "b "}', b'{"done": true}', b'{"response": "c"}']) == "ab"
    assert fold_stream([b'{"response": "x"}']) == "x"
    with pytest.raises(RuntimeError):
        fold_stream([b'{"error": "gone"}'])


def test_page_ids():
    assert page_ids('{"cPages": {"pages": [{"id": "b"}, {"id": "a"}]}}') == ["b", "a"] == page_ids('{"pages": ["b", "a"]}')
    assert page_ids("[]") == page_ids("nope") == page_ids('{"pages": 3}') == []


def test_options_from_env():
    o = Options.from_env({"VAULT_DIR": "/v", "HASH_CHECK": " No ", "OUT_ALONGSIDE": "YES", "FORBIDDEN_PATHS": "/a, ,/b", "MAX_AGE_HOURS": "2.5", "OLLAMA_HOST": "http://m"})
    assert (o.vault_dir, o.hash_check, o.out_alongside, o.forbidden_paths, o.max_age_hours, o.model_host) == ("/v", False, True, ("/a", "/b"), 2.5, "http://m")


def test_loop_survives_and_sees_rewritten_files(spark, tmp_path):
    from test_pass import NOW, RENDERER, StubTranscriber, Vault

    vault = Vault(spark, tmp_path)
    vault.put("a.pdf", b"one")
    loop = Loop(spark, vault.o, RENDERER, StubTranscriber(), clock=lambda: NOW)
    query = loop.start("1 second")
    try:
        for content, passes in ((b"two", 1), (b"three", 2)):
            for _ in range(240):
                if sum(getattr(r, "done", 0) for r in loop.results) >= passes:
                    break
                query.awaitTermination(0.5)
            vault.put("a.pdf", content, NOW - 50 + passes)
    finally:
        query.stop()
    assert sum(getattr(r, "done", 0) for r in loop.results) >= 2
    closed = Loop(spark, vault.o.with_(run_window="00:00-00:01"), RENDERER, StubTranscriber(), clock=lambda: NOW)
    assert closed.tick() is None
