"""Words, word hashes and shingles of many texts at once, as numpy arrays over UTF-8 bytes.

Texts of an Arrow batch lie one after the other in one buffer. Everything here works on that buffer, so no Python
object is made per word. Chunks are bounded by bytes; a text longer than the bound forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
#: Words that white space separates.
SPACED = ~SPACE_BYTES
#: Words of ASCII letters and digits and of all code points beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes with A-Z made lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random-looking value per byte, equal for both cases of A-Z.
_VALUES = mix((LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
_EXACT_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept per process."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        up, down = cls.up[:n], cls.down[:n]
        if len(cls.up) > 2 * CHUNK_BYTES:
            # Made for one very long text; do not keep it.
            cls.up, cls.down = cls.up[: CHUNK_BYTES + 1].copy(), cls.down[: CHUNK_BYTES + 1].copy()
        return up, down


class RangeHash:
    """Hashes of any byte ranges of a buffer from one prefix sum."""

    def __init__(self, data: np.ndarray, exact: bool = False) -> None:
        up, self.down = _Powers.to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_EXACT_VALUES if exact else _VALUES)[data] * up[:-1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[begin]) * self.down[begin]
        return mix(raw + (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Chunk:
    """Some rows of a batch: `data` holds their bytes, row i lies in `data[bounds[i]:bounds[i + 1]]`."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column (null: empty) in chunks of at most `limit` bytes, or of one longer text."""
    column = text_column(batch, name)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(places, places[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        low, high = int(places[first]), int(places[last])
        yield Chunk(first, everything[low:high], places[first : last + 1] - low)
        first = last


@dataclass
class Words:
    """Byte ranges of all words of a chunk; row i has the words `starts[rows[i]:rows[i + 1]]`."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def words(chunk: Chunk, kind: np.ndarray) -> Words:
    """The words of each text; `kind` says which (lower-cased) bytes belong to words."""
    n = len(chunk.data)
    inside = kind[LOWER[chunk.data]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = chunk.bounds[(chunk.bounds > 0) & (chunk.bounds < n)]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.bounds))


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row number of each element, for elements laid out by `bounds`."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, ascending, and the bounds of each text's set.

    A text with fewer than `size` words, but not none, has its whole word sequence as its one shingle.
    """
    found = words(chunk, SPACED)
    hashes = RangeHash(chunk.data).of(found.starts, found.ends)
    counts = found.counts()
    total = np.zeros(len(hashes), np.uint64)
    # Position j of a shingle has its own odd factor, so order matters.
    for j in range(size):
        factor = np.uint64((2 * j + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
        if len(hashes) > j:
            total[: len(hashes) - j] += mix(hashes[j:] * factor)
    out, per_row = [], np.zeros(len(counts) + 1, np.int64)
    for row, count in enumerate(counts.tolist()):
        low = int(found.rows[row])
        if count >= size:
            own = np.sort(total[low : low + count - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif count:
            # The number of words tells short sequences from shingles.
            own = np.zeros(1, np.uint64)
            for j in range(count):
                own += mix(hashes[low + j : low + j + 1] * np.uint64((2 * j + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
            own += np.uint64(count)
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        per_row[row + 1] = len(own)
    joined = mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)
    return joined, np.cumsum(per_row)
