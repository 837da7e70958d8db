"""Whole groups out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Yield (table, bounds) with whole groups of rows that are equal in ``keys``; bounds holds each group's first row, then the end.

    The rows come sorted by ``keys``.  The last group of a batch waits for the next batch.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = pa.Table.from_batches([batch])
        found = pa.concat_tables([held, found]) if held is not None else found
        cuts = _starts(found, keys)
        if len(cuts) > 1:
            yield found.slice(0, cuts[-1]).combine_chunks(), cuts
        held = found.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _starts(found: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(found.num_rows, bool)
    change[0] = True
    for key in keys:
        values = found.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def column(found: pa.Table, name: str) -> np.ndarray:
    return found.column(name).to_numpy()
