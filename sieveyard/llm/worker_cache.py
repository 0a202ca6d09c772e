"""One large object for each Python worker.  Workers outlive their tasks, so what one step holds must not stay for the next."""

from __future__ import annotations

from collections.abc import Callable

_held: dict = {}


def held(key, make: Callable):
    """The object of that key; any other goes first."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    _held.clear()
