"""Engine options: one frozen record instead of process-wide settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

#: File types that can be processed, and those that are page bundles.
PDF_SUFFIXES = (".pdf",)
BUNDLE_SUFFIXES = (".zip", ".rmdoc")
PAGE_SUFFIXES = (".rm",)
INPUT_SUFFIXES = PDF_SUFFIXES + BUNDLE_SUFFIXES + PAGE_SUFFIXES
#: Spellings of true.
TRUE_WORDS = ("1", "true", "yes", "on")


def as_bool(text: str) -> bool:
    return text.strip().lower() in TRUE_WORDS


def as_list(text: str) -> tuple[str, ...]:
    return tuple(part for part in (raw.strip() for raw in text.split(",")) if part)


@dataclass(frozen=True)
class Options:
    """What a pass depends on besides its inputs. Times are seconds unless the name says otherwise.

    Fixed values: the numbers and the output suffix below are what users' set-ups rely on.
    """

    vault_dir: str = "/vault"
    source_subdir: str = "notes"
    out_dir: str = ""
    out_subdir: str = "notes/_transcripts"
    out_suffix: str = "-handwriting_converted"
    out_alongside: bool = False
    state_dir: str = "/state"
    model: str = "vision"
    model_host: str = "http://localhost:11434"
    model_wait_timeout: int = 1800
    threads: int = 14
    no_think: bool = True
    cpu: bool = False
    chrome: bool = False
    #: none, auto, the program's name, or the path of one that takes the same arguments.
    pdf_backend: str = "auto"
    drawing_backend: str = "auto"
    #: Wake up by file events (1) or by the timer alone, and seconds over which events are one wake-up.
    inotify: bool = True
    wake_delay: float = 2.0
    dpi: int = 150
    max_px: int = 1568
    timeout: int = 1800
    interval: int = 600
    hash_check: bool = True
    max_retries: int = 3
    max_age_hours: float = 24.0
    min_reprocess_interval: float = 0.0
    run_window: str = ""
    require_split: bool = False
    auto_split: bool = False
    split_marker_key: str = "/Splitter"
    split_marker_value: str = "processed"
    split_max_aspect: float = 2.0
    split_target_page_height: int = 700
    split_min_gap_height: int = 25
    split_whitespace_threshold: int = 248
    forbidden_paths: tuple[str, ...] = ()
    #: A file whose bytes changed starts with no retries used, whatever came before.
    fresh_retries: bool = True

    @property
    def source_dir(self) -> str:
        sub = self.source_subdir
        return sub.rstrip("/") if sub.startswith("/") else f"{self.vault_dir.rstrip('/')}/{sub.strip('/')}".rstrip("/")

    @property
    def output_dir(self) -> str:
        return (self.out_dir or f"{self.vault_dir.rstrip('/')}/{self.out_subdir.strip('/')}").rstrip("/")

    def with_(self, **changes) -> Options:
        return replace(self, **changes)

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> Options:
        """Options from variables named as the fields in upper case; OLLAMA_HOST names the model host."""
        names = {f.name: f.name.upper() for f in fields(cls)} | {"model_host": "OLLAMA_HOST"}
        given: dict[str, object] = {}
        for f in fields(cls):
            raw = env.get(names[f.name])
            if raw is None:
                continue
            default = getattr(cls, f.name)
            given[f.name] = as_bool(raw) if isinstance(default, bool) else as_list(raw) if isinstance(default, tuple) else type(default)(raw.strip() if not isinstance(default, str) else raw)
        return cls(**given)


def lies_under(path: str, prefix: str) -> bool:
    """Is path the prefix itself or below it, by whole path components."""
    prefix = prefix.rstrip("/")
    return path == prefix or path.startswith(prefix + "/")


def check_paths(o: Options) -> None:
    """Refuse settings under which a pass could write where it must not, with links resolved. Raises
    ValueError."""
    used = [o.vault_dir, o.source_dir, o.state_dir, *([] if o.out_alongside else [o.output_dir])]
    for path in used:
        for prefix in o.forbidden_paths:
            if lies_under(path, prefix) or lies_under(os.path.realpath(path), os.path.realpath(prefix)):
                raise ValueError(f"{path} is under the forbidden path {prefix}")
    if not lies_under(o.source_dir, o.vault_dir):
        raise ValueError(f"source {o.source_dir} is outside of the vault {o.vault_dir}")
    if not o.out_suffix and (o.out_alongside or os.path.realpath(o.output_dir) == os.path.realpath(o.source_dir)):
        raise ValueError("an output suffix is needed where transcripts share a folder with sources")
