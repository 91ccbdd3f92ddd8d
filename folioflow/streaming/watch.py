"""Wake-ups by file events, so that a pass needn't wait for the timer. Linux inotify through the C library;
where there is none, or the source isn't a local folder, the timer alone sets the pace."""

from __future__ import annotations

import ctypes
import ctypes.util
import logging
import os
import select
import struct
import threading
from collections.abc import Callable

from folioflow.options import INPUT_SUFFIXES

log = logging.getLogger("folioflow")

#: Fixed values of the system's interface.
CLOSE_WRITE, MOVED_FROM, MOVED_TO, CREATE, DELETE_SELF, MOVE_SELF = 0x8, 0x40, 0x80, 0x100, 0x400, 0x800
IGNORED, IS_DIR, OVERFLOW = 0x8000, 0x40000000, 0x4000
_EVENT = struct.Struct("iIII")


class Watcher:
    """Calls ``wake`` for each input file that is written or moved in below ``root``. Folders that appear
    are watched as well, with what they already hold; those that go are dropped."""

    def __init__(self, root: str, wake: Callable[[], None], suffixes: tuple[str, ...] = INPUT_SUFFIXES) -> None:
        self.root, self.wake, self.suffixes = root, wake, suffixes
        self.folders: dict[int, str] = {}
        self._end = threading.Event()
        self._libc = ctypes.CDLL(ctypes.util.find_library("c"), use_errno=True)
        self._fd = self._libc.inotify_init1(os.O_NONBLOCK | os.O_CLOEXEC)
        if self._fd < 0:
            raise OSError(ctypes.get_errno(), "inotify")
        self._add(root)
        self._thread = threading.Thread(target=self._run, name="folioflow-watch", daemon=True)

    def _add(self, folder: str) -> bool:
        """Watch a folder and those below it; is there an input among their files?"""
        mask = CLOSE_WRITE | MOVED_TO | CREATE | MOVED_FROM | MOVE_SELF | DELETE_SELF
        number = self._libc.inotify_add_watch(self._fd, os.fsencode(folder), mask)
        if number < 0:
            log.warning("%s can't be watched: %s", folder, os.strerror(ctypes.get_errno()))
            return False
        self.folders[number] = folder
        found = False
        try:
            for entry in os.scandir(folder):
                found |= self._add(entry.path) if entry.is_dir(follow_symlinks=False) else self._mine(entry.name)
        except OSError:
            pass
        return found

    def _mine(self, name: str) -> bool:
        return name.lower().endswith(self.suffixes)

    def take(self, data: bytes) -> bool:
        """Whether a block of events has one that wakes. Events of folders that aren't watched don't count."""
        at, woken = 0, False
        while at + _EVENT.size <= len(data):
            number, mask, _, n = _EVENT.unpack_from(data, at)
            name = os.fsdecode(data[at + _EVENT.size : at + _EVENT.size + n].rstrip(b"\0"))
            at += _EVENT.size + n
            if mask & OVERFLOW:
                woken = True
            folder = self.folders.get(number)
            if folder is None:
                continue
            if mask & IGNORED:
                del self.folders[number]
            elif mask & IS_DIR:
                if mask & (CREATE | MOVED_TO):
                    woken |= self._add(os.path.join(folder, name))
            elif mask & (CLOSE_WRITE | MOVED_TO):
                woken |= self._mine(name)
        return woken

    def _run(self) -> None:
        while not self._end.is_set():
            ready, _, _ = select.select([self._fd], [], [], 0.5)
            try:
                if ready and self.take(os.read(self._fd, 1 << 16)):
                    self.wake()
            except OSError as e:
                log.warning("watching ends: %s", e)
                return

    def start(self) -> Watcher:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._end.set()
        if self._thread.is_alive():
            self._thread.join()
        os.close(self._fd)


def watcher(root: str, wake: Callable[[], None]) -> Watcher | None:
    """A started watcher, or None where there can't be one."""
    if not os.path.isdir(root):
        log.warning("%s is no local folder; the timer alone sets the pace", root)
        return None
    try:
        return Watcher(root, wake).start()
    except (OSError, AttributeError, TypeError) as e:
        log.warning("no file events (%s); the timer alone sets the pace", e)
        return None
