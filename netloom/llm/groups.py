"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key in turn; batches come sorted by the keys. Holds one key at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for first, last in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[first] for c in cols)
            if key != held_key and held:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held)
