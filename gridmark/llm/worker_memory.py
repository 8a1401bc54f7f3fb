"""What Python workers keep from one operator to the next.

Spark hands a worker to task after task. Memories that pay within an operator (ids of words, tables of powers) only take
room once another one has begun, so each operator that keeps some, or needs much itself, claims the worker first.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

_FORGET: list[Callable[[], None]] = []
_owner: list[str] = [""]


def forgets(clear: Callable[[], None]) -> None:
    """Register what empties a memory."""
    _FORGET.append(clear)


def claim(owner: str) -> None:
    """Empty all memories if another operator used the worker last."""
    if _owner[0] == owner:
        return
    _owner[0] = owner
    for clear in _FORGET:
        clear()
    gc.collect()
    _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def trimmed(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step; what it has freed goes back to the system at the end of each task, not when the idle worker is next used."""

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        _give_back()

    return run
