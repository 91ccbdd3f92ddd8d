"""The model client against a local server, cutting tall pages in a pass, and plain transcripts."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from test_pass import NOW, StubTranscriber, Vault, bundle

from folioflow import cli
from folioflow.operators.backends import BundleRenderer, ModelClient, Rendering
from folioflow.plans.incremental import run_pass


class Server(BaseHTTPRequestHandler):
    shows, bodies = [404, 200], []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Server.bodies.append((self.path, body))
        if self.path == "/api/show":
            code = Server.shows.pop(0) if len(Server.shows) > 1 else Server.shows[0]
            self.send_response(code)
            self.end_headers()
            return
        self.send_response(200)
        self.end_headers()
        lines = [{"response": "  Dear"}, {"response": " all\n"}, {"done": True}] if body.get("stream") else [{"response": "x"}]
        self.wfile.write(b"\n\n".join(json.dumps(x).encode() for x in lines))

    def log_message(self, *args):
        pass


@pytest.fixture
def host():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_model_client(host):
    client, waits = ModelClient(host, "m", timeout=10, threads=3), []
    client.wait_ready(60, sleep=waits.append)
    assert waits == [2.0]
    assert client.transcribe(b"page") == "Dear all"
    path, body = Server.bodies[-1]
    assert path == "/api/generate" and body["images"] == ["cGFnZQ=="] and body["options"] == {"temperature": 0, "num_thread": 3} and body["think"] is False


def test_readiness_ends():
    clock = iter(range(0, 1000, 5))
    waits = []
    with pytest.raises(TimeoutError):
        ModelClient("http://127.0.0.1:9", "m").wait_ready(40, sleep=waits.append, clock=lambda: next(clock))
    assert waits[:3] == [2.0, 3.0, 4.5] and max(waits) <= 30


class TallRenderer(BundleRenderer):
    """Pages whose rows are letters: w is white, the rest is ink; 4 pixels to a point."""

    def profile(self, page):
        rows = page.decode()
        return 100.0, len(rows) / 4, [255.0 if c == "w" else 0.0 for c in rows]

    def crop(self, page, top, bottom):
        rows = page.decode()
        return rows[round(len(rows) - top * 4) : round(len(rows) - bottom * 4)].encode()


def test_tall_pages_are_cut_at_white_bands(spark, tmp_path):
    page = "a" * 600 + "w" * 40 + "b" * 700 + "w" * 30 + "c" * 500
    renderer = TallRenderer(lambda content: Rendering([content, b"z" * 40], max_aspect=4.0))
    vault = Vault(spark, tmp_path, auto_split=True, require_split=True)
    vault.put("Tall.pdf", page.encode())
    got = run_pass(spark, vault.o, renderer, StubTranscriber(), NOW)
    assert got.done == 1
    record = vault.records()["notes/Tall.pdf"]
    assert record.pages == 4 and record.chars_per_page == [620, 735, 515, 40]


def test_pages_that_cannot_be_cut_are_errors(spark, tmp_path):
    class Breaks(TallRenderer):
        def profile(self, page):
            if page.startswith(b"n"):
                raise ValueError("no image")
            return super().profile(page)

        def crop(self, page, top, bottom):
            raise ValueError("torn")

    tall = "a" * 600 + "w" * 40 + "b" * 700 + "w" * 30 + "c" * 500
    vault = Vault(spark, tmp_path, auto_split=True)
    for name, page in (("No.pdf", "no picture"), ("Torn.pdf", tall), ("Fine.pdf", "b" * 40)):
        vault.put(name, page.encode())
    got = run_pass(spark, vault.o, Breaks(lambda content: Rendering([content])), StubTranscriber(), NOW)
    assert got.failed == {"notes/No.pdf": "split: no image", "notes/Torn.pdf": "split: torn"} and got.done == 1
    assert {k: (r.status, r.retries) for k, r in vault.records().items()} == {"notes/No.pdf": ("error", 1), "notes/Torn.pdf": ("error", 1), "notes/Fine.pdf": ("ok", 0)}


def test_plain_transcripts(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "plain"
    (source / "sub").mkdir(parents=True)
    (source / "one.zip").write_bytes(bundle("My Notes"))
    (source / "sub" / "two.rm").write_bytes(b"loose page")
    (source / "bad.zip").write_bytes(b"no zip")
    (source / "skip.txt").write_bytes(b"text")
    assert {e for _, e in cli.transcribe_tree(spark, str(source), str(out), BundleRenderer(), StubTranscriber())} == {None}
    assert sorted(p.name for p in out.iterdir()) == ["My Notes.md", "two.md"]
    assert (out / "My Notes.md").read_text() == "# My Notes\n\n\n## Page 1\n\ndrawing b\n\n\n## Page 2\n\ndrawing a\n"
    cli.transcribe_tree(spark, str(source / "sub" / "two.rm"), str(tmp_path / "single"), BundleRenderer(), StubTranscriber())
    assert [p.name for p in (tmp_path / "single").iterdir()] == ["two.md"]
