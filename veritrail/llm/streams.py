"""Sorted partitions as runs of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def key_changes(block: pa.RecordBatch, keys: int) -> np.ndarray:
    """For each row but the first, whether one of the first ``keys`` columns differs from the row before."""
    out = np.zeros(max(0, block.num_rows - 1), bool)
    for k in range(keys):
        column = block.column(k)
        out |= np.asarray(pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, block.num_rows - 1)), True))
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 20_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of complete groups with the groups' bounds; the input is sorted by its first ``keys`` columns.

    A block has about ``rows`` rows, or one group; a group has to fit in memory.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(last: bool):
        nonlocal held, size
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None
        if block is None or not block.num_rows:
            return None
        ends = np.flatnonzero(key_changes(block, keys)) + 1
        if last:
            held, size = [], 0
            return block, np.concatenate([[0], ends, [block.num_rows]])
        if not len(ends):
            return None
        rest = block.slice(int(ends[-1]))
        held, size = [rest], rest.num_rows
        return block.slice(0, int(ends[-1])), np.concatenate([[0], ends])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            found = cut(False)
            if found:
                yield found
    found = cut(True)
    if found:
        yield found
