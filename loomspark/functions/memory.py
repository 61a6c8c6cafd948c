"""Memory of the worker processes that run Python in tasks."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def trim() -> None:
    """Hands freed memory back to the system: the allocators keep it for this worker otherwise, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        give_back(0)
