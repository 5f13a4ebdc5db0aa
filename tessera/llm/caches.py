"""What a Python worker keeps between tasks: the caches of one operator at a time.

Spark uses a worker again for later tasks, so a cache that outlives a task saves work there. When another operator's
tasks come to the worker, what the last one kept is dropped and given back to the system, so that caches never add up.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Return freed memory to the system, as far as the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hold(owner: str, drop: Callable[[], None] = lambda: None) -> None:
    """Tell that ``owner`` runs in this worker now; ``drop`` empties what it keeps."""
    others = [k for k in _held if k != owner]
    for other in others:
        _held.pop(other)()
    if others:
        _give_back()
    _held[owner] = drop
