"""Calls that can be stopped: after a stop neither a further job nor a commit of the call begins."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from contextvars import ContextVar


class Stopped(Exception):
    """The call was cancelled or ran out of time; nothing more of it takes effect."""


class Call:
    """One call; ``stop`` waits for a publication that is under way and bars later ones."""

    def __init__(self):
        self._stopped, self._lock = threading.Event(), threading.Lock()

    def stop(self) -> None:
        with self._lock:
            self._stopped.set()

    def go_on(self) -> None:
        if self._stopped.is_set():
            raise Stopped("the call was stopped")


#: The calls that the running code belongs to, outermost first.
_calls: ContextVar[tuple[Call, ...]] = ContextVar("calls", default=())


@contextmanager
def running(call: Call):
    token = _calls.set((*_calls.get(), call))
    try:
        yield call
    finally:
        _calls.reset(token)


def go_on() -> None:
    """Raise ``Stopped`` if a call that the code belongs to was stopped."""
    for c in _calls.get():
        c.go_on()


@contextmanager
def publishing():
    """No call that the block belongs to is stopped while it runs."""
    calls = _calls.get()
    for c in calls:
        c._lock.acquire()
    try:
        for c in calls:
            c.go_on()
        yield
    finally:
        for c in reversed(calls):
            c._lock.release()
