"""Page bundles: zip archives with a page order and a visible name, read from their bytes."""

from __future__ import annotations

import io
import json
import zipfile
from dataclasses import dataclass
from pathlib import PurePosixPath


@dataclass(frozen=True)
class Bundle:
    title: str | None
    pages: list[tuple[str, bytes]]


def visible_name(archive: zipfile.ZipFile) -> str | None:
    """The name in the first metadata member, or None if there is none that can be used."""
    member = next((n for n in archive.namelist() if n.endswith(".metadata")), None)
    if member is None:
        return None
    try:
        told = json.loads(archive.read(member).decode("utf-8", "replace"))
        name = told.get("visibleName")
        return (name.strip() or None) if isinstance(name, str) else None
    except (ValueError, AttributeError, KeyError):
        return None


def page_ids(content: str | bytes) -> list[str]:
    """Page ids of a content document in either of its two shapes; none if it can't be read."""
    try:
        told = json.loads(content)
    except ValueError:
        return []
    if not isinstance(told, dict):
        return []
    nested = told.get("cPages")
    listed = [p.get("id") for p in nested.get("pages") or [] if isinstance(p, dict)] if isinstance(nested, dict) else told.get("pages")
    return [i for i in listed if isinstance(i, str)] if isinstance(listed, list) else []


def read_bundle(content: bytes) -> Bundle:
    """Title and page bytes in order. Pages lie in the folder named like the content document, or else in
    the first folder, or at the top; pages that the document doesn't list are left out unless it lists
    none that exist, in which case all are taken by name."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [PurePosixPath(n) for n in archive.namelist() if not n.endswith("/")]
        index = next((n for n in names if n.suffix == ".content" and len(n.parts) == 1), None)
        folders = [n.parts[0] for n in names if len(n.parts) > 1]
        home = index.stem if index and index.stem in folders else folders[0] if folders else ""
        pages = {n.stem: n for n in names if n.suffix == ".rm" and str(n.parent) == (home or ".")}
        order = [i for i in page_ids(archive.read(str(index))) if i in pages] if index else []
        return Bundle(visible_name(archive), [(i, archive.read(str(pages[i]))) for i in order or sorted(pages)])
