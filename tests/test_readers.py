"""Page images, readers that call programs, file events, the command line's options and guards with links."""

import json
import logging
import os
import stat
import struct
import sys
import threading
import time
import zlib

import numpy as np
import pytest
from test_pass import NOW, StubTranscriber, Vault, bundle

from folioflow import cli
from folioflow.functions import images
from folioflow.operators import readers, state
from folioflow.operators.backends import Rendering
from folioflow.options import Options, check_paths
from folioflow.plans.incremental import run_pass
from folioflow.streaming import loop, watch

RNG = np.random.default_rng(4)


def filtered(pixels, how):
    """A PNG whose lines all use one filter."""
    height, width, samples = pixels.shape
    flat = pixels.reshape(height, -1).astype(int)
    lines = []
    for y in range(height):
        x, up = flat[y], flat[y - 1] if y else np.zeros(flat.shape[1], int)
        left = np.concatenate([np.zeros(samples, int), x[:-samples]])
        corner = np.concatenate([np.zeros(samples, int), up[:-samples]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        lines.append(bytes([how]) + ((x - [0 * x, left, up, (left + up) // 2, paeth][how]) % 256).astype(np.uint8).tobytes())
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[samples], 0, 0, 0)), (b"IDAT", zlib.compress(b"".join(lines))), (b"IEND", b"")]
    return images.HEADER + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
def test_png(samples):
    pixels = RNG.integers(0, 256, (7, 5, samples), dtype=np.uint8)
    for how in range(5):
        assert (images.decode(filtered(pixels, how))[0] == pixels).all()
    back, dpi = images.decode(images.encode(pixels, 150))
    assert (back == pixels).all() and round(dpi) == 150 and images.decode(images.encode(pixels))[1] is None


def test_fit_profile_and_crop():
    page = images.encode(np.repeat(np.array([0, 255, 100], np.uint8), [60, 30, 210])[:, None, None].repeat(90, axis=1), 144)
    assert images.size(images.fit(page, 100)) == (30, 100) == images.fitted_size(90, 300, 100)
    assert images.fit(page, 300) == page == images.fit(page, 0) and images.fit(b"no image", 5) == b"no image"
    width, height, rows = images.profile(page, 72)
    assert (round(width), round(height), len(rows)) == (45, 150, 150) and rows[:30] == [0] * 30 and rows[30:45] == [255] * 15
    part, dpi = images.decode(images.crop(page, 120, 105, 72))
    assert part.shape == (30, 90, 1) and (part == 255).all() and round(dpi) == 144
    for bad in (b"x", images.HEADER):
        with pytest.raises(ValueError):
            images.decode(bad)
    with pytest.raises(ValueError):
        images.crop(page, 10, 10, 72)


def program(path, body):
    path.write_text(f"#!{sys.executable}\nimport sys\nsys.path.insert(0, {os.getcwd()!r})\n{body}")
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(path)


@pytest.fixture
def programs(tmp_path):
    """Stand-ins: a document is JSON with the rows of its pages, a drawing makes such a document."""
    raster = """
import json, numpy as np
from folioflow.functions import images
assert sys.argv[1:3] == ["-png", "-r"]
told = json.load(open(sys.argv[4]))
for n, rows in enumerate(told["pages"], 1):
    images_ = np.array(rows, np.uint8)[:, None, None].repeat(40, axis=1)
    open(f"{sys.argv[5]}-{n:02d}.png", "wb").write(images.encode(images_, int(sys.argv[3])))
"""
    info = """
import json
told = json.load(open(sys.argv[-1]))
if "-custom" in sys.argv:
    print("Splitter:   ", told.get("marker", "")) if "marker" in told else None
else:
    print("Pages: 2")
    for n, rows in enumerate(told["pages"], 1):
        print(f"Page    {n} size:   40 x {len(rows)} pts")
"""
    draw = """
import json
if open(sys.argv[2], "rb").read() == b"torn":
    sys.exit("can't draw")
assert sys.argv[1] == "--no-chrome"
json.dump({"pages": [[9] * 30]}, open(sys.argv[4], "w"))
"""
    home = tmp_path / "bin"
    home.mkdir()
    return {k: program(home / k, body) for k, body in (("pdftoppm", raster), ("pdfinfo", info), ("rmc", draw))}


def test_readers(programs, monkeypatch):
    read = readers.PdfReader(72, "/Splitter", programs["pdftoppm"], programs["pdfinfo"])
    got = read(json.dumps({"pages": [[1] * 20] * 11 + [[2] * 120], "marker": "processed"}).encode())
    assert len(got.pages) == 12 and images.size(got.pages[11]) == (40, 120) and (got.marker, got.max_aspect) == ("processed", 3.0)
    assert readers.PdfReader(72, "/Splitter", programs["pdftoppm"], "/no/such").told.__name__ and readers.PdfReader(72, "/S", programs["pdftoppm"], "/no/such")(b'{"pages": [[1]]}').max_aspect is None
    assert len(readers.DrawingReader(read, programs["rmc"])(b"lines")) == 1
    with pytest.raises(RuntimeError, match="can't draw"):
        readers.DrawingReader(read, programs["rmc"])(b"torn")
    with pytest.raises(RuntimeError, match="not installed"):
        readers.PdfReader(72, "/S", "/no/such")(b"{}")
    assert readers.renderer(Options(), which=lambda _: None).documents is None
    assert readers.renderer(Options(pdf_backend="pdftoppm"), which=lambda _: None).documents.rasterise == "pdftoppm"
    assert readers.renderer(Options(dpi=99, drawing_backend="auto", pdf_backend="none"), which=lambda _: "x").drawing.pages.dpi == 99
    with pytest.raises(ValueError):
        readers.renderer(Options(pdf_backend="magic"))


class Sizes(StubTranscriber):
    def transcribe(self, page):
        return "x".join(map(str, images.size(page)))


def test_a_pass_reads_cuts_and_shrinks_documents_and_drawings(spark, tmp_path, programs):
    vault = Vault(spark, tmp_path, pdf_backend=programs["pdftoppm"], drawing_backend=programs["rmc"], dpi=72, max_px=400, auto_split=True)
    made = readers.renderer(vault.o)
    info = readers.PdfReader(72, "/Splitter", programs["pdftoppm"], programs["pdfinfo"])
    made.documents, made.drawing = info, readers.DrawingReader(info, programs["rmc"])
    tall = [0] * 600 + [255] * 40 + [0] * 700 + [255] * 30 + [0] * 500
    vault.put("Tall.pdf", json.dumps({"pages": [tall, [5] * 50]}).encode())
    vault.put("One.rm", b"lines")
    vault.put("Torn.rm", b"torn")
    vault.put("Two.zip", bundle("Two"))
    got = run_pass(spark, vault.o, made, Sizes(), NOW)
    assert got.done == 3 and list(got.failed) == ["notes/Torn.rm"] and "can't draw" in got.failed["notes/Torn.rm"]
    r = vault.records()
    assert r["notes/Tall.pdf"].pages == 4 and r["notes/Two.zip"].pages == 2
    text = (tmp_path / "out/Tall-handwriting_converted.md").read_text()
    assert [w for w in text.split() if w.replace("x", "").isdigit() and "x" in w] == ["25x400", "21x400", "31x400", "40x50"]


def test_file_events(tmp_path):
    woken = threading.Event()
    (tmp_path / "old").mkdir()
    found = watch.watcher(str(tmp_path), woken.set)
    if found is None:
        pytest.skip("no file events here")

    def wakes(act, expected=True):
        woken.clear()
        act()
        assert woken.wait(5 if expected else 1) == expected

    try:
        wakes(lambda: (tmp_path / "old" / "a.PDF").write_bytes(b"x"))
        wakes(lambda: (tmp_path / "b.txt").write_bytes(b"x"), False)
        wakes(lambda: (tmp_path / "b.txt").rename(tmp_path / "old" / "b.zip"))
        wakes(lambda: (tmp_path / "new").mkdir(), False)
        wakes(lambda: (tmp_path / "new" / "c.rm").write_bytes(b"x"))
        (tmp_path / "new" / "c.rm").unlink()
        n = len(found.folders)
        wakes(lambda: (tmp_path / "new").rmdir(), False)
        assert len(found.folders) == n - 1
        # Events of a folder that isn't known, and the flag that events were lost.
        assert not found.take(struct.pack("iIII", 999, watch.CLOSE_WRITE, 0, 16) + b"d.pdf".ljust(16, b"\0"))
        assert found.take(struct.pack("iIII", -1, watch.OVERFLOW, 0, 0))
    finally:
        found.stop()
    assert watch.watcher(str(tmp_path / "none"), woken.set) is None


def test_events_bring_passes_forward(spark, tmp_path):
    vault = Vault(spark, tmp_path, wake_delay=0.2)
    made = loop.Loop(spark, vault.o, readers.PageRenderer(lambda c: Rendering([c])), StubTranscriber(), clock=lambda: NOW)
    stop = made.watch()
    if stop is None:
        pytest.skip("no file events here")
    try:
        for k in range(5):
            vault.put(f"{k}.pdf", b"page")
        end = time.time() + 60
        while time.time() < end and sum(r.done for r in made.results) < 5:
            time.sleep(0.2)
    finally:
        stop()
    assert sum(r.done for r in made.results) == 5 and len(made.results) <= 3


def test_command_line(spark, tmp_path, capsys):
    args = cli.arguments().parse_args(["--scan", "--dpi", "99", "--max-px", "500", "--cpu", "--threads", "3", "--think", "--model", "m"])
    o = cli.given_options(args, {"DPI": "7", "TIMEOUT": "5", "SPLIT_MARKER_KEY": "/K", "MODEL": "env"})
    assert (o.dpi, o.max_px, o.cpu, o.threads, o.no_think, o.model, o.timeout, o.split_marker_key) == (99, 500, True, 3, False, "m", 5, "/K")
    rows = [{"rel": f"{i:04d}", "status": "error", "retries": 1, "error": "e"} for i in range(1500)] + [{"rel": "p", "status": "pending_split"}, {"rel": "k", "status": "ok", "pages": 4}]
    lines = list(cli.status_lines(spark.createDataFrame(rows, state.SCHEMA)))
    assert lines[0] == "ok=1  error=1500  pending_split=1  total_pages=4" and len(lines) == 1502 and lines[1501].startswith("PENDING  p")
    cli.set_up_logging(str(tmp_path / "state"), "debug")
    logging.getLogger("folioflow").debug("a line")
    cli.set_up_logging("/proc/none", "no level")
    assert "DEBUG a line" in (tmp_path / "state" / "folioflow.log").read_text() and "DEBUG a line" in capsys.readouterr().out


def test_guards_see_through_links(spark, tmp_path):
    secret = tmp_path / "secret"
    secret.mkdir()
    vault = Vault(spark, tmp_path, forbidden_paths=(str(secret),))
    (tmp_path / "link").symlink_to(secret)
    with pytest.raises(ValueError):
        check_paths(vault.o.with_(out_dir=str(tmp_path / "link" / "out")))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "Work").symlink_to(secret)
    vault.put("Work/A.pdf", b"page")
    vault.put("B.pdf", b"page")
    got = run_pass(spark, vault.o, readers.PageRenderer(lambda c: Rendering([c])), StubTranscriber(), NOW)
    assert got.done == 1 and got.failed["notes/Work/A.pdf"].startswith("output: ") and not list(secret.iterdir())
