"""Groups of sorted rows inside Arrow tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def give_back() -> None:
    """Return freed memory to the system.  Workers live on between tasks, and would keep what the
    largest batch of any of them took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # Not this C library.
        pass


def slices(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("text",), rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows and, in the columns ``by``, bytes at most (or one row):
    what a task makes of texts is held for one part only, and given back at the task's end."""
    for batch in batches:
        upto = np.zeros(batch.num_rows + 1, np.int64)
        for c in by:
            upto[1:] += np.cumsum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(upto, upto[at] + size, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to
        del batch, upto
    give_back()


def runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the columns ``by``; a run may stretch over batches.

    Only one run is held at a time: callers deal groups out in blocks of bounded size.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in by:
            k = batch.column(c).to_numpy()
            change[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            if held and lo == 0 and all(held[-1].column(c)[-1] == part.column(c)[0] for c in by):
                held.append(part)
                continue
            if held:
                yield pa.Table.from_batches(held)
            held = [part]
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    give_back()


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that the links a[i] - b[i] connect it with."""
    low = np.arange(n)
    while len(a):
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            break
    return low
