"""Locks of files between processes: shared or exclusive, tried, timed or waited for.

A lock is held on the file that has the path's name at that moment: where a file is
replaced while a process waits for it, the wait starts again on the new one."""

from __future__ import annotations

import contextlib
import fcntl
import os
import time
from collections.abc import Iterator

#: Seconds between two tries, at first and at most.
FIRST_PAUSE, LONGEST_PAUSE = 0.001, 0.025


class Busy(TimeoutError):
    """Another process holds the lock."""


class Lock:
    def __init__(self, path: str):
        self.path = path

    def _open(self) -> int:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        return os.open(self.path, os.O_RDWR | os.O_CREAT, 0o644)

    def _is_current(self, handle: int) -> bool:
        try:
            named = os.stat(self.path)
        except FileNotFoundError:
            return False
        own = os.fstat(handle)
        return (own.st_dev, own.st_ino) == (named.st_dev, named.st_ino)

    def _try(self, kind: int) -> int | None:
        handle = self._open()
        try:
            fcntl.flock(handle, kind | fcntl.LOCK_NB)
        except BlockingIOError:
            os.close(handle)
            return None
        if self._is_current(handle):
            return handle
        os.close(handle)
        return None

    @contextlib.contextmanager
    def _held(self, kind: int, seconds: float | None) -> Iterator[None]:
        until = None if seconds is None else time.monotonic() + seconds
        pause = FIRST_PAUSE
        while (handle := self._try(kind)) is None:
            if until is not None and time.monotonic() >= until:
                raise Busy(f"{self.path} is locked")
            time.sleep(pause)
            pause = min(2 * pause, LONGEST_PAUSE)
        try:
            yield
        finally:
            os.close(handle)  # which gives the lock up

    def write(self, seconds: float | None = None) -> contextlib.AbstractContextManager[None]:
        """The lock for one writer; waits for so long, without end by default."""
        return self._held(fcntl.LOCK_EX, seconds)

    def read(self, seconds: float | None = None) -> contextlib.AbstractContextManager[None]:
        """The lock for any number of readers."""
        return self._held(fcntl.LOCK_SH, seconds)

    def try_write(self) -> contextlib.AbstractContextManager[None]:
        return self._held(fcntl.LOCK_EX, 0)

    def try_read(self) -> contextlib.AbstractContextManager[None]:
        return self._held(fcntl.LOCK_SH, 0)


def ticket_lock(folder: str, name: str, seconds: float = 2.0) -> contextlib.AbstractContextManager[None]:
    """The lock of one ticket file of a folder."""
    return Lock(os.path.join(folder, ".locks", f"{name}.lock")).write(seconds)
