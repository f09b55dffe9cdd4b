"""Groups of rows from a stream of batches that is sorted by its keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch per run of equal integer keys; a run may span incoming batches."""
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry:
            batch = pa.Table.from_batches([*carry, batch]).combine_chunks().to_batches()[0]
        codes = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        bounds = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1).tolist()]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield batch.slice(a, b - a)
        carry = [batch.slice(bounds[-1])]
    yield from carry


def spanning(ids_r: np.ndarray, ids_c: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) of a spanning forest of the links ``near`` between rows and columns, without loops."""
    names = np.unique(np.concatenate([ids_r, ids_c]))
    at_r, at_c = np.searchsorted(names, ids_r), np.searchsorted(names, ids_c)
    root = np.arange(len(names))
    while True:
        before = root.copy()
        np.minimum.at(root, at_r, np.where(near, root[at_c][None, :], len(names)).min(1))
        np.minimum.at(root, at_c, np.where(near, root[at_r][:, None], len(names)).min(0))
        root = root[root]
        if (root == before).all():
            moved = root != np.arange(len(names))
            return names[moved], names[root[moved]]
