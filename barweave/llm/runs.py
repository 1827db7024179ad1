"""Runs of equal keys in batches that arrive sorted by them."""

from __future__ import annotations

import numpy as np


def whole_runs(batches, keys: int):
    """Arrow tables holding whole runs of equal values in the first ``keys`` columns (no nulls); a run never spans two tables."""
    import pyarrow as pa
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        changed = np.zeros(table.num_rows - 1, dtype=bool)
        for k in range(keys):
            v = table.column(k).to_numpy()
            changed |= v[1:] != v[:-1]
        last = np.flatnonzero(changed)
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held


def run_starts(table, keys: int) -> np.ndarray:
    """First row of each run, and the number of rows at the end."""
    changed = np.ones(table.num_rows + 1, dtype=bool)
    if table.num_rows > 1:
        changed[1:-1] = False
        for k in range(keys):
            v = table.column(k).to_numpy()
            changed[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(changed)


def pairs_in_runs(starts: np.ndarray, most: int):
    """All pairs inside runs, in slices of about ``most``."""
    size = np.diff(starts)
    rows = np.arange(starts[0], starts[-1]) if len(size) else np.zeros(0, np.int64)
    after = np.repeat(starts[1:], size) - rows - 1           # partners behind each row of its run
    ends = np.cumsum(after)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        n = after[lo:hi]
        left = np.repeat(rows[lo:hi], n)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi
