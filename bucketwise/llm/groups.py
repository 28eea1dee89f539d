"""Whole groups out of a stream of sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def group_cuts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Row at which each group begins, and the number of rows."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows:
        columns = [table.column(k).to_numpy() for k in keys]
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
    return np.append(np.flatnonzero(new), table.num_rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of one or more whole groups and their cuts; holds a batch and the group that it breaks off."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.concat_tables([*rest, pa.Table.from_batches([batch])])
        cuts = group_cuts(table, keys)
        last = int(cuts[-2])
        if last:
            yield table.slice(0, last).combine_chunks(), cuts[:-1]
        rest = [table.slice(last)]
    if rest:
        table = rest[0].combine_chunks()
        yield table, group_cuts(table, keys)
