"""What a Python worker keeps from one task to the next.

Workers serve tasks of many stages. Each keeps one large object at most (an opened tokenizer with its table of pieces, a
model with its table of words): asking for another one lets go of the one before, so that memory does not add up over stages.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa

_held: dict[Hashable, object] = {}


def resident(key: Hashable, make: Callable[[], object]):
    """The object kept under ``key``; made, in place of any other, if it is not there."""
    if key not in _held:
        release()
        made = make()
        _held.clear()
        _held[key] = made
        give_back()  # what was only needed to make it
    return _held[key]


def release() -> None:
    """Let go of what is kept, and give free memory back to the system."""
    if _held:
        _held.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Arrow's free memory and, where the C library can, that of Python."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return
