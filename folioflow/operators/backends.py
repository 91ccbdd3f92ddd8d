"""What turns bytes into pages and pages into text. Backends are pickled to executors.

A renderer has ``render(suffix, content) -> Rendering`` and raises for what it can't read; with
``profile(page)`` and ``crop(page, top, bottom)`` it also supports cutting tall pages. A transcriber
has ``transcribe(page) -> str``.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Protocol

from folioflow.options import BUNDLE_SUFFIXES, PDF_SUFFIXES
from folioflow.sources.bundles import read_bundle


@dataclass(frozen=True)
class Rendering:
    pages: list[bytes]
    title: str | None = None
    marker: str | None = None
    max_aspect: float | None = 0.0


class Renderer(Protocol):
    def render(self, suffix: str, content: bytes) -> Rendering: ...


class Transcriber(Protocol):
    def transcribe(self, page: bytes) -> str: ...


class BundleRenderer:
    """Reads bundles itself; ``documents(content) -> Rendering`` and ``drawing(content) -> pages`` turn PDF
    files and single drawings into page images (``readers``)."""

    def __init__(self, documents=None, drawing=None) -> None:
        self.documents, self.drawing = documents, drawing

    def render(self, suffix: str, content: bytes) -> Rendering:
        if suffix in PDF_SUFFIXES:
            if self.documents is None:
                raise RuntimeError("no PDF reader is set")
            return self.documents(content)
        draw = self.drawing or (lambda page: [page])
        if suffix in BUNDLE_SUFFIXES:
            bundle = read_bundle(content)
            if not bundle.pages:
                raise ValueError("the bundle has no pages")
            return Rendering([p for _, page in bundle.pages for p in draw(page)], bundle.title)
        return Rendering(draw(content))


PROMPT = "Write out the handwriting on this page as Markdown, line for line. Give the text alone, and [illegible] for words that can't be read."


def fold_stream(lines: Iterable[bytes]) -> str:
    """Text of a stream of JSON lines: blank lines are skipped, an error raises, done ends it."""
    parts = []
    for line in lines:
        if not (line := line.strip()):
            continue
        told = json.loads(line)
        if told.get("error"):
            raise RuntimeError(told["error"])
        parts.append(told.get("response") or "")
        if told.get("done"):
            break
    return "".join(parts).strip()


@dataclass
class ModelClient:
    """A vision model behind an HTTP API that streams JSON lines."""

    host: str
    model: str
    timeout: int = 1800
    threads: int | None = None
    no_think: bool = True
    cpu: bool = False
    keep_alive: str = "30m"
    settings: dict = field(default_factory=dict)

    def _post(self, path: str, body: dict, timeout: float):
        request = urllib.request.Request(self.host.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json"}, method="POST")
        return urllib.request.urlopen(request, timeout=timeout)

    def transcribe(self, page: bytes) -> str:
        settings = {"temperature": 0} | ({"num_gpu": 0} if self.cpu else {}) | ({"num_thread": self.threads} if self.threads else {}) | self.settings
        body = {"model": self.model, "prompt": PROMPT, "images": [base64.b64encode(page).decode()], "stream": True, "keep_alive": self.keep_alive, "options": settings}
        with self._post("/api/generate", body | ({"think": False} if self.no_think else {}), self.timeout) as lines:
            return fold_stream(lines)

    def wait_ready(self, limit: float, sleep=time.sleep, clock=time.monotonic) -> None:
        """Return once the model is present and answers; raise TimeoutError after ``limit`` seconds."""
        end, attempt = clock() + limit, 0
        while not self._present():
            if clock() > end:
                raise TimeoutError(f"{self.model} is not ready on {self.host} after {limit:g} s")
            sleep(min(2 * 1.5**attempt, 30))
            attempt += 1
        with self._post("/api/generate", {"model": self.model, "prompt": "ping", "stream": False, "options": {"num_predict": 1}}, max(limit, 300)) as answer:
            json.loads(answer.read())

    def _present(self) -> bool:
        try:
            with self._post("/api/show", {"name": self.model}, 10) as answer:
                return answer.status == 200
        except (urllib.error.URLError, OSError):
            return False
