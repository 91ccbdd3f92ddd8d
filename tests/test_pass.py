"""A pass over real files: what is due, what is written, what state says. Ids follow the conformance list."""

import io
import os
import zipfile

import pytest

from pyspark.sql import functions as F

from folioflow.operators import state
from folioflow.operators.backends import BundleRenderer, Rendering
from folioflow.operators.cache import SCHEMA as CACHE_SCHEMA
from folioflow.operators.cache import RenderCache
from folioflow.options import Options, check_paths
from folioflow.plans.incremental import run_pass

NOW = 1_700_000_000.0


class StubTranscriber:
    def transcribe(self, page: bytes) -> str:
        if page.startswith(b"broken"):
            raise RuntimeError("can't read this")
        return page.decode("latin-1")


def documents(content: bytes) -> Rendering:
    """A stand-in for a PDF reader: two pages; a first word 'tall' or 'marked' sets what a splitter would."""
    if content.startswith(b"broken"):
        return Rendering([content])
    tall, marked = content.startswith((b"tall", b"marked")), content.startswith(b"marked")
    return Rendering([b"Hello world\nline two", b"page two text"], None, "processed" if marked else None, 7.8 if tall else 1.3)


RENDERER = BundleRenderer(documents)


def bundle(name=None, pages=("b", "a"), content='{"cPages": {"pages": [{"id": "b"}, {"id": "a"}]}}', metadata=None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if metadata is not None or name is not None:
            z.writestr("x.metadata", metadata if metadata is not None else f'{{"visibleName": "{name}"}}')
        if content is not None:
            z.writestr("x.content", content)
        for p in pages:
            z.writestr(f"x/{p}.rm", f"drawing {p}")
    return out.getvalue()


class Vault:
    def __init__(self, spark, root, **options):
        self.spark, self.root = spark, root
        self.o = Options(vault_dir=str(root / "vault"), out_dir=str(root / "out"), state_dir=str(root / "state"), **options)
        os.makedirs(self.o.source_dir)

    def put(self, rel, content, at=NOW - 60):
        path = os.path.join(self.o.source_dir, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)
        os.utime(path, (at, at))

    def scan(self, now=NOW, **changes):
        return run_pass(self.spark, self.o.with_(**changes), RENDERER, StubTranscriber(), now)

    def records(self):
        return {r.rel: r for r in state.StateStore(self.spark, f"{self.o.state_dir}/manifest").read().collect()}

    def outputs(self):
        return sorted(os.path.relpath(os.path.join(d, f), self.root) for d, _, fs in os.walk(self.root) for f in fs if f.endswith(".md"))


@pytest.fixture
def vault(spark, tmp_path):
    return Vault(spark, tmp_path)


def test_c1_to_c8_changes_and_errors(vault):
    vault.put("Work/Sample.pdf", b"pdf-bytes-v1")
    vault.put("Work/Bad.pdf", b"broken")
    got = vault.scan()
    assert got.done == 1 and got.gates == {"queued": 2}
    r = vault.records()
    assert r["notes/Work/Sample.pdf"].status == "ok" and r["notes/Work/Bad.pdf"].status == "error" and r["notes/Work/Bad.pdf"].retries == 1
    assert r["notes/Work/Sample.pdf"].chars_per_page == [20, 13]
    got = vault.scan()
    assert got.done == 0 and got.gates == {"prefilter-skip": 1, "queued": 1}
    vault.put("Work/Sample.pdf", b"pdf-bytes-v1", NOW - 30)
    assert vault.scan().gates == {"hash-unchanged": 1, "queued": 1}
    # The new time is kept, so the next pass doesn't read the file; the bad file has used its tries.
    assert vault.scan().gates == {"prefilter-skip": 1, "retry-capped": 1}
    vault.put("Work/Sample.pdf", b"pdf-bytes-v2", NOW - 20)
    assert vault.scan().done == 1
    assert vault.records()["notes/Work/Bad.pdf"].retries == 3


def test_c9_to_c13_age_cooldown_and_own_output(vault):
    vault.put("Old.pdf", b"old-bytes", NOW - 48 * 3600)
    got = vault.scan()
    assert got.done == 0 and got.gates == {"skipped-old": 1} and vault.outputs() == []
    assert vault.scan(max_age_hours=0.0).done == 1
    vault.put("Old.pdf", b"v2-bytes", NOW - 10)
    assert vault.scan(now=NOW + 5, min_reprocess_interval=3600.0).gates == {"cooldown": 1}
    inside = vault.o.with_(out_dir="", out_subdir="notes/_transcripts")
    vault.put("_transcripts/x.pdf", b"x")
    assert "notes/_transcripts/x.pdf" not in {r for r in run_pass(vault.spark, inside, RENDERER, StubTranscriber(), NOW).failed}
    assert "notes/_transcripts/x.pdf" not in vault.records()


def test_c14_to_c23_transcript(vault, tmp_path):
    vault.put("Work/Sample.pdf", b"pdf-bytes-v1")
    vault.put("Work/Bad.pdf", b"broken")
    vault.scan()
    assert vault.outputs() == ["out/Work/Sample-handwriting_converted.md"]
    text = (tmp_path / "out/Work/Sample-handwriting_converted.md").read_text()
    assert text.splitlines()[:3] == ["---", "source: notes/Work/Sample.pdf", "model: vision"]
    assert "source_modified: 2023-11-14T22:12:20" in text and vault.records()["notes/Work/Sample.pdf"].source_modified == "2023-11-14T22:12:20"
    assert "Source: [[notes/Work/Sample.pdf]]" in text and "## Page 1\n\nHello world\nline two\n" in text and "chars_per_page: [20, 13]" in text
    vault.put("Work/Beside.pdf", b"y")
    vault.scan(out_alongside=True)
    assert "vault/notes/Work/Beside-handwriting_converted.md" in vault.outputs()
    with pytest.raises(ValueError):
        vault.scan(out_alongside=True, out_suffix="")


def test_c24_to_c29_split_gate(vault):
    for name in ("tall", "short", "marked"):
        vault.put(f"{name}.pdf", name.encode())
    got = vault.scan(require_split=True)
    assert got.done == 2 and got.entered == ["notes/tall.pdf"] and vault.records()["notes/tall.pdf"].status == "pending_split"
    assert vault.scan(require_split=True).gates == {"prefilter-skip": 2, "still-pending-split": 1}
    vault.put("tall.pdf", b"marked tall", NOW - 5)
    assert vault.scan(require_split=True).done == 1


def test_c30_to_c49_bundles(vault, tmp_path):
    vault.put("Bundle.zip", bundle("Bundle Notes"))
    vault.put("Modern.rmdoc", bundle("Modern Doc", content='{"pages": ["a", "b"]}'))
    vault.put("Stray.rm", b"rm-bytes")
    vault.put("9c4f1234-5678.rmdoc", bundle("Real Name"))
    vault.put("Fallback.rmdoc", bundle(metadata='{"visibleName": "   "}'))
    vault.put("Plain.rmdoc", bundle())
    vault.put("Broken.rmdoc", b"no zip at all")
    got = vault.scan()
    assert got.done == 6 and got.failed["notes/Broken.rmdoc"].startswith("render: ")
    names = [os.path.basename(p) for p in vault.outputs()]
    assert names == sorted(f"{n}-handwriting_converted.md" for n in ("Bundle Notes", "Modern Doc", "Stray", "Real Name", "Fallback", "Plain"))
    assert "## Page 1\n\ndrawing b\n\n## Page 2\n\ndrawing a" in (tmp_path / "out/Bundle Notes-handwriting_converted.md").read_text()
    assert "## Page 1\n\ndrawing a\n\n## Page 2\n\ndrawing b" in (tmp_path / "out/Modern Doc-handwriting_converted.md").read_text()
    r = vault.records()
    assert r["notes/Bundle.zip"].render_sha256 and r["notes/Broken.rmdoc"].retries == 1
    assert vault.scan().done == 0
    vault.put("Bundle.zip", bundle("Bundle Notes", pages=("a", "c"), content="not json"), NOW - 5)
    assert vault.scan().done == 1
    assert "## Page 1\n\ndrawing a\n\n## Page 2\n\ndrawing c" in (tmp_path / "out/Bundle Notes-handwriting_converted.md").read_text()


def test_renamed_bundle_comes_from_the_cache(vault):
    same = bundle("Same")
    vault.put("One.zip", same)
    vault.scan()

    class NoRenderer:
        def render(self, suffix, content):
            raise AssertionError("rendered again")

    vault.put("Two.zip", same)
    got = run_pass(vault.spark, vault.o, NoRenderer(), StubTranscriber(), NOW)
    assert got.done == 1 and not got.failed
    paths = {r.out_path for r in vault.records().values()}
    assert len(paths) == 2 and any(p.endswith("/Same-handwriting_converted.md") for p in paths)


def test_c50_guards_and_repeat(vault):
    with pytest.raises(ValueError):
        check_paths(vault.o.with_(forbidden_paths=(os.path.dirname(vault.o.vault_dir),)))
    with pytest.raises(ValueError):
        check_paths(vault.o.with_(source_subdir="/elsewhere"))
    vault.put("A.pdf", b"a")
    vault.scan()
    before = vault.records()
    assert vault.scan().done == 0 and vault.records() == before
    assert vault.scan(hash_check=False).gates == {"prefilter-skip": 1}


def test_a_commit_that_dies_leaves_a_state(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path / "manifest"))
    one = spark.createDataFrame([{"rel": "b", "status": "ok"}, {"rel": "a", "status": "ok"}], state.SCHEMA)
    assert store.commit(one) == 1 and [r.rel for r in store.read().collect()] == ["a", "b"]
    # Dead after the snapshot, before its pointer: the last state stays, and the number is written again.
    store.write(one.limit(0), 2)
    assert store.version() == 1 and store.read().count() == 2
    assert store.commit(one.limit(1)) == 2 and store.read().count() == 1
    # Dead while a snapshot is written.
    (tmp_path / "manifest" / "v=3").mkdir()
    assert store.version() == 2 and store.commit(one) == 3
    # Without a pointer the last complete snapshot counts.
    (tmp_path / "manifest" / "CURRENT").unlink()
    (tmp_path / "manifest" / "v=7").mkdir()
    assert store.version() == 3 and store.read().count() == 2 and store.commit(one) == 4
    assert not list((tmp_path / "manifest").glob("CURRENT.*"))


def test_the_cache_opens_the_shards_that_are_asked_for(spark, tmp_path):
    cache = RenderCache(spark, str(tmp_path / "rendered"))
    pages = spark.createDataFrame([(f"{i:02x}" + "0" * 62, "t", 1, b"page", None, 1.0, True) for i in range(40)], CACHE_SCHEMA)
    cache.put(pages)
    cache.put(pages)
    asked = pages.where(F.col("sha256") < "03")
    found = cache.read(asked)
    assert found.count() == 3 and cache.read().count() == 40 and cache.read(pages.limit(0)).count() == 0
    assert {f.split("shard=")[1][:2] for f in found.inputFiles()} >= {"00", "01", "02"}
    assert "PartitionFilters: [shard" in found._jdf.queryExecution().toString()
