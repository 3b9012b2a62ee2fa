"""Arrays that travel between stages as one binary value per partition key instead of one row per element."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def packed(parts: np.ndarray, arrays: Sequence[np.ndarray], names: Sequence[str], part: str = "part") -> pa.RecordBatch:
    """One row per distinct part with the bytes of the part's elements of every array, in their order."""
    order = np.argsort(parts, kind="stable")
    keys, starts = np.unique(parts[order], return_index=True)
    bounds = np.append(starts, len(parts)).astype(np.int64)
    columns = [pa.array(keys.astype(np.int32))]
    for values in arrays:
        data = np.ascontiguousarray(values[order])
        offsets = (bounds * data.dtype.itemsize).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays(columns, names=[part, *names])


def packed_schema(names: Sequence[str], part: str = "part") -> str:
    return ", ".join([f"{part} int", *(f"{name} binary" for name in names)])


def unpacked(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    """All elements of a packed column, row after row."""
    out = []
    for chunk in table.column(name).chunks:
        if len(chunk):
            _, offsets, data = chunk.cast(pa.large_binary()).buffers()
            places = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
            if places[-1] > places[0]:
                out.append(np.frombuffer(data, np.uint8)[places[0] : places[-1]].copy().view(dtype))
    return np.concatenate(out) if out else np.zeros(0, dtype)


def batches_of(columns: dict[str, np.ndarray | list], limit: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of at most `limit` rows."""
    table = pa.table(columns)
    yield from table.to_batches(max_chunksize=limit)
