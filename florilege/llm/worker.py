"""Memory of Python workers, which serve one task after another, of any operator."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_trim: Callable[[int], int] | None = getattr(ctypes.CDLL(None), "malloc_trim", None)
_tables: dict[str, Callable[[], None]] = {}
_now = ""


def keeps(operator: str, forget: Callable[[], None]) -> None:
    """Say how to drop what ``operator`` keeps in a worker from one task to the next."""
    _tables[operator] = forget


def begin(operator: str) -> None:
    """Called first by a task: drops what other operators kept, and gives freed memory back to the system."""
    global _now
    if operator != _now:
        for name, forget in _tables.items():
            if name != operator:
                forget()
        _now = operator
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
