"""Renderers that need programs which are not part of this package. They are looked for when they are
asked for, by name or by what is installed; without them PDF files and drawings are error rows."""

from __future__ import annotations

import importlib.util
import os
import re
import shutil
import subprocess
import tempfile
from dataclasses import dataclass

from folioflow.functions import images
from folioflow.operators.backends import BundleRenderer, Rendering
from folioflow.options import Options


def _run(command: list[str], what: str) -> str:
    """Standard output of a program; a missing or failing one raises RuntimeError with what it said."""
    try:
        done = subprocess.run(command, check=True, capture_output=True)
    except FileNotFoundError as e:
        raise RuntimeError(f"{command[0]} is not installed") from e
    except subprocess.CalledProcessError as e:
        said = (e.stderr or b"").decode("utf-8", "replace").strip()
        raise RuntimeError(f"{command[0]} failed on {what}: {said or e}") from e
    return done.stdout.decode("utf-8", "replace")


_SIZE = re.compile(r"^Page\s+\d+\s+size:\s*([\d.]+) x ([\d.]+)", re.M)


@dataclass(frozen=True)
class PdfReader:
    """Page images of a PDF by ``rasterise``, and its marker and page sizes by pypdf or by ``info``."""

    dpi: int = 150
    marker_key: str = "/Splitter"
    rasterise: str = "pdftoppm"
    info: str = "pdfinfo"

    def __call__(self, content: bytes) -> Rendering:
        with tempfile.TemporaryDirectory() as scratch:
            path = os.path.join(scratch, "in.pdf")
            with open(path, "wb") as f:
                f.write(content)
            _run([self.rasterise, "-png", "-r", str(self.dpi), path, os.path.join(scratch, "page")], "a document")
            found = {int(m[1]): name for name in os.listdir(scratch) if (m := re.fullmatch(r"page-(\d+)\.png", name))}
            pages = []
            for _, name in sorted(found.items()):
                with open(os.path.join(scratch, name), "rb") as f:
                    pages.append(f.read())
            try:
                marker, aspect = self.told(path)
            except Exception:  # a page that can't be measured isn't ready, but it can be read
                marker, aspect = None, None
        return Rendering(pages, None, marker, aspect)

    def told(self, path: str) -> tuple[str | None, float]:
        """The marker in the document's information, and the largest height / width of its pages."""
        if importlib.util.find_spec("pypdf"):
            import pypdf

            document = pypdf.PdfReader(path)
            sizes = [(float(p.mediabox.width), float(p.mediabox.height)) for p in document.pages]
            marker = (document.metadata or {}).get(self.marker_key)
        else:
            text = _run([self.info, "-f", "1", "-l", "-1", path], "a document")
            sizes = [(float(w), float(h)) for w, h in _SIZE.findall(text)]
            custom = re.search(rf"^{re.escape(self.marker_key.lstrip('/'))}:\s*(.*?)\s*$", _run([self.info, "-custom", path], "a document"), re.M)
            marker = custom[1] if custom else None
        return marker, max((h / w for w, h in sizes if w), default=0.0)


@dataclass(frozen=True)
class DrawingReader:
    """Page images of one drawing: ``command`` makes a PDF of it, which ``pages`` reads."""

    pages: PdfReader
    command: str = "rmc"
    chrome: bool = False

    def __call__(self, content: bytes) -> list[bytes]:
        with tempfile.TemporaryDirectory() as scratch:
            source, target = os.path.join(scratch, "in.rm"), os.path.join(scratch, "out.pdf")
            with open(source, "wb") as f:
                f.write(content)
            _run([self.command, *([] if self.chrome else ["--no-chrome"]), source, "-o", target], "a drawing")
            with open(target, "rb") as f:
                return self.pages(f.read()).pages


class PageRenderer(BundleRenderer):
    """Bundles, and what the given readers read; its PNG pages can be measured and cut."""

    def __init__(self, documents=None, drawing=None, dpi: int = 150) -> None:
        super().__init__(documents, drawing)
        self.dpi = dpi

    def profile(self, page: bytes) -> tuple[float, float, list[float]]:
        return images.profile(page, self.dpi)

    def crop(self, page: bytes, top: float, bottom: float) -> bytes:
        return images.crop(page, top, bottom, self.dpi)


#: Backends by option value. auto: the command if it is installed, else none.
PDF_BACKENDS = ("auto", "none", "pdftoppm")
DRAWING_BACKENDS = ("auto", "none", "rmc")


def renderer(o: Options, which=shutil.which) -> PageRenderer:
    """The renderer that the options ask for. A named backend is used whether it is found here or not, as
    executors may have what the driver lacks."""
    for value, known in ((o.pdf_backend, PDF_BACKENDS), (o.drawing_backend, DRAWING_BACKENDS)):
        if value not in known and not value.startswith("/"):
            raise ValueError(f"{value} is none of {', '.join(known)} and no path of a program")
    wanted = lambda value, auto: None if value == "none" or value == "auto" and not which(auto) else auto if value == "auto" else value
    raster, draw = wanted(o.pdf_backend, "pdftoppm"), wanted(o.drawing_backend, "rmc")
    documents = PdfReader(o.dpi, o.split_marker_key, raster) if raster else None
    drawing = DrawingReader(documents or PdfReader(o.dpi, o.split_marker_key), draw, o.chrome) if draw else None
    return PageRenderer(documents, drawing, o.dpi)
