"""Arrow text columns as flat byte arrays, shared by the text operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one vectorised step holds; one longer document is a step of its own.
STEP_BYTES = 1 << 20


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and the n + 1 offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offset_buffer, data_buffer = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offset_buffer, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    column = batch.column(batch.schema.get_field_index(text))
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    group = (np.cumsum(lengths) - lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


class Memory(dict):
    """What a worker remembers, up to a bound, with an overflow that lasts for one call."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.overflow: dict = {}

    def __missing__(self, key):
        return self.overflow[key]

    def learn(self, learned: dict) -> None:
        """Takes entries as long as there is room; the rest can be looked up until the next call."""
        room = self.most - len(self)
        if len(learned) <= room:
            self.update(learned)
            self.overflow = {}
        else:
            self.update(islice(learned.items(), max(0, room)))
            self.overflow = learned
