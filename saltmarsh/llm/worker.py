"""What tasks share: process-wide caches and slices of Arrow batches bounded by text size."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 4 << 20


def give_back() -> None:
    """Return what was freed to the system, so that a worker that has held much does not stay large."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def process_cache(owner: str, key: object, make):
    """``make()`` once per Python worker process, as long as one owner's tasks follow each other.

    Task functions travel by value, so a module variable would start anew with
    every task; a worker process serves many tasks, of many stages. What another
    owner has kept is dropped first, so a worker holds the caches of one stage only.
    """
    holder = sys.modules.setdefault("_saltmarsh_worker_cache", types.ModuleType("_saltmarsh_worker_cache"))
    state = holder.__dict__
    if state.get("owner") != owner:
        state["owner"], state["table"] = owner, {}
        give_back()
    table = state["table"]
    if key not in table:
        table[key] = make()
    return table[key]


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in order, in slices of about ``limit`` bytes of the text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [t or "" for t in column.to_pylist()]
