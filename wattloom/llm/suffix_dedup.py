"""Suffix-array dedup: byte strings of a minimum length that already start in a text with a smaller doc_id are cut out.

1. Deal. A window is a byte string of `length` (50) bytes. The k-gram with the least hash inside a window is its anchor; equal
   windows have equal anchors at equal places, so they meet where their anchor is dealt to. Consecutive windows with the
   same anchor are one run, described by hashes of the anchor and of the run's bytes.
2. Equal runs settle at once: the smallest doc_id stays, all others are covered. Tasks do so among themselves before
   anything is sent, so a passage that a third of all texts share costs one entry per task.
3. What is left are different runs with one anchor, which may share some windows only. Their bytes are gathered and
   expanded: a suffix order of the concatenation, its Burrows-Wheeler transform, and breadth-first backward extension of
   all intervals. Extending every interval by the preceding byte gives the boundaries of the next common-prefix value,
   in increasing order, up to `length`; suffixes still in one interval share a window.
4. Covered ranges are merged per text and cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.line_dedup import merged
from wattloom.llm.packing import packed, packed_schema, unpacked
from wattloom.llm.text_arrays import Chunk, RangeHash, chunks, rows_of, text_column

LENGTH = 50
GRAM = 20
FLUSH = 1_000_000
#: Bytes that are expanded at once; the runs of one anchor are never parted.
EXPANSION = 1_000_000


def runs(chunk: Chunk, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of the run's bytes, row, first window, windows) of all runs, places within the chunk."""
    size = len(chunk.data)
    none = np.zeros(0, np.uint64)
    if size < length:
        return none, none, *(np.zeros(0, np.int64) for _ in range(3))
    hashes = RangeHash(chunk.data, exact=True)
    place = np.arange(size - gram + 1)
    grams = hashes.of(place, place + gram)
    bits = np.uint64((1 << max(22, size.bit_length())) - 1)
    # Least hash, then leftmost, as one number.
    least = (grams & ~bits) | place.astype(np.uint64)
    wide, width = 1, length - gram + 1
    while 2 * wide <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < width:
        least = np.minimum(least[: len(least) - (width - wide)], least[width - wide :])
    anchor = (least & bits).astype(np.int64)
    row = rows_of(chunk.bounds)[: len(anchor)]
    window = np.flatnonzero(chunk.bounds[row + 1] - np.arange(len(anchor)) >= length)
    if not len(window):
        return none, none, *(np.zeros(0, np.int64) for _ in range(3))
    anchor, row = anchor[window], row[window]
    fresh = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    first, last = window[fresh], window[np.append(fresh[1:], len(window)) - 1]
    return grams[anchor[fresh]], hashes.of(first, last + length), row[fresh], first, last - first + 1


def _smallest(key: np.ndarray, content: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, content and doc; whether an element is of its content's smallest doc; where a content begins."""
    order = np.lexsort((doc, content, key))
    key, content, doc = key[order], content[order], doc[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1]))) if len(order) else np.zeros(0, bool)
    leader = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return order, doc == doc[leader], fresh


#: What travels of a run; wide numbers in halves, as upper halves of ids and places hardly vary and compress away. Anchors
#: are told apart by 32 bits besides their part (two that are not only meet in vain), equal runs by 40 bits more.
RUN = ["key", "content4", "content1", "doc_low", "doc_high", "start_low", "start_high", "windows", "covered"]


def _sent(parts: int, key, content, doc, start, windows) -> pa.RecordBatch:
    order, own, _ = _smallest(key, content, doc)
    key, content, doc, start, windows = (x[order] for x in (key, content, doc, start, windows))
    # A covered run only travels to be gathered with the others.
    part = np.where(own, key % np.uint64(parts), doc.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    kept_key, doc = key // np.uint64(parts), doc.view(np.uint64)
    columns = [
        kept_key.astype(np.uint32), content.astype(np.uint32), (content >> np.uint64(32)).astype(np.uint8),
        doc.astype(np.uint32), (doc >> np.uint64(32)).astype(np.uint32),
        start.astype(np.uint16), (start >> 16).astype(np.uint16), windows.astype(np.uint8), (~own).astype(np.uint8),
    ]
    return packed(part, columns, RUN)


def _settled(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Covered runs, and open ones: the smallest doc's runs where an anchor has different runs of different docs."""
    kinds = [np.uint32, np.uint32, np.uint8, np.uint32, np.uint32, np.uint16, np.uint16, np.uint8, np.uint8]
    got = {name: unpacked(table, name, kind) for name, kind in zip(RUN, kinds, strict=True)}
    anchor = got["key"].astype(np.uint64)
    content = got["content4"].astype(np.uint64) | (got["content1"].astype(np.uint64) << np.uint64(32))
    doc = (got["doc_low"].astype(np.uint64) | (got["doc_high"].astype(np.uint64) << np.uint64(32))).view(np.int64)
    start = got["start_low"].astype(np.int64) | (got["start_high"].astype(np.int64) << 16)
    windows, local = got["windows"].astype(np.int32), got["covered"].astype(bool)
    rest = np.flatnonzero(~local)
    order, own, fresh = _smallest(anchor[rest], content[rest], doc[rest])
    order = rest[order]
    sorted_anchor, sorted_doc = anchor[order], doc[order]
    if len(order):
        new = np.concatenate(([True], sorted_anchor[1:] != sorted_anchor[:-1]))
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        contents = np.add.reduceat(fresh.astype(np.int64), starts)
        apart = np.minimum.reduceat(sorted_doc, starts) != np.maximum.reduceat(sorted_doc, starts)
        open_ = own & ((contents > 1) & apart)[group]
    else:
        open_ = np.zeros(0, bool)
    gone = np.concatenate((np.flatnonzero(local), order[~own]))
    asked = order[open_]
    every = np.concatenate((gone, asked))
    parts_key = anchor[every].view(np.int64) * (1 << 20) + int(key[0].as_py())
    return pa.table(
        {
            "doc_id": doc[every],
            "start": start[every].astype(np.int32),
            "windows": windows[every],
            "anchor": parts_key,
            "open": np.concatenate((np.zeros(len(gone), bool), np.ones(len(asked), bool))),
        }
    )


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first `depth` symbols or more; symbols are below 512, 0 ends a string."""
    count = len(symbols)
    padded = np.concatenate((symbols.astype(np.uint64), np.zeros(7, np.uint64)))
    rank = np.zeros(count, np.uint64)
    for j in range(7):
        rank = (rank << np.uint64(9)) | padded[j : j + count]
    known = 7
    while True:
        order = np.argsort(rank, kind="stable")
        fresh = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
        if known >= depth or fresh.all():
            return order
        dense = np.empty(count, np.uint64)
        dense[order] = np.cumsum(fresh).astype(np.uint64)
        following = np.zeros(count, np.uint64)
        following[: count - known] = dense[known:]
        rank = dense * np.uint64(count + 1) + following
        known *= 2


def expanded(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each place, the number of its interval: places share it if their next `length` symbols are equal.

    Level by level, backward extension: the suffixes of an interval that the same symbol precedes are an interval of
    the next level. Row j of the order comes, by that step, from row `source[j]`; two neighbours stay together if
    they begin with the same symbol and their sources were together. A pair that parts at level v has v - 1 symbols in
    common; only pairs that have not parted are looked at again.
    """
    order = suffix_order(symbols, length)
    count = len(order)
    row_of = np.empty(count, np.int64)
    row_of[order] = np.arange(count)
    source = row_of[(order + 1) % count]
    together = np.zeros(count, bool)
    together[1:] = symbols[order][1:] == symbols[order][:-1]
    alive = np.flatnonzero(together)
    for _ in range(length - 1):
        if not len(alive):
            break
        interval = np.cumsum(~together)
        stay = interval[source[alive]] == interval[source[alive - 1]]
        together[alive[~stay]] = False
        alive = alive[stay]
    return np.cumsum(~together)[row_of]


def _shared_windows(doc, start, windows, text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, start, end) of the byte ranges whose windows also start in a run of a smaller doc."""
    width = text.shape[1]
    inside = np.arange(width + 1)[None, :] < sizes[:, None]
    symbols = np.zeros((len(doc), width + 1), np.uint16)
    symbols[:, :width] = text.astype(np.uint16) + 1
    symbols[~inside] = 0
    # One 0 ends each string.
    held = np.arange(width + 1)[None, :] <= sizes[:, None]
    flat = symbols[held]
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    row = np.repeat(np.arange(len(doc)), windows)
    step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    interval = expanded(flat, length)[begins[row] + step]
    smallest = np.full(int(interval.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, interval, doc[row])
    hit = doc[row] > smallest[interval]
    edge = hit & np.concatenate(([True], (row[1:] != row[:-1]) | ~hit[:-1]))
    last = hit & np.concatenate(((row[1:] != row[:-1]) | ~hit[1:], [True]))
    a, b = np.flatnonzero(edge), np.flatnonzero(last)
    return doc[row[a]], start[row[a]] + step[a], start[row[b]] + step[b] + length


def _plain(blob: bytes | None) -> bytes:
    return zstandard.decompress(blob) if blob else b""


def compressed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed text), dealt by doc_id; two joins of one plan read the same shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = [press.compress(x) if x else None for x in text_column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], names=["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, packed binary").repartition("doc_id")


def repeated(docs: DataFrame, texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, end): byte ranges made of windows that also start in a text with a smaller doc_id."""
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = 2 * length - gram

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids = batch.column("doc_id")
            for chunk in chunks(batch):
                key, content, row, first, windows = runs(chunk, length, gram)
                own = ids.slice(chunk.first, len(chunk)).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((key, content, own[row], first - chunk.bounds[row], windows))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield _sent(parts, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held.clear()
        if sum(len(x[0]) for x in held):
            yield _sent(parts, *(np.concatenate(x) for x in zip(*held, strict=True)))

    known = docs.filter("doc_id is not null").select("doc_id", "text")
    settled = (
        known.mapInArrow(send, packed_schema(RUN))
        .groupBy("part")
        .applyInArrow(_settled, "doc_id long, start int, windows int, anchor long, open boolean")
    )
    names = ["anchor", "doc", "start", "windows", "size", "text"]
    asked = settled.filter("open").groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, bytes]] = []
            for doc, blob, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("packed"), batch.column("asked"), strict=True):
                text = _plain(blob.as_py())
                for run in wanted.as_py():
                    low = run["start"]
                    rows.append((run["anchor"], doc, low, run["windows"], text[low : low + run["windows"] - 1 + length]))
            if rows:
                anchor, doc, start, windows, found = zip(*rows, strict=True)
                columns = [
                    np.array(anchor, np.int64), np.array(doc, np.int64), np.array(start, np.int32), np.array(windows, np.int32),
                    np.array([len(x) for x in found], np.int32),
                    np.frombuffer(b"".join(x.ljust(width, b"\0") for x in found), f"V{width}"),
                ]
                yield packed((columns[0] % parts).astype(np.int32), columns, names)

    def expand(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        anchor, doc = unpacked(table, "anchor", np.int64), unpacked(table, "doc", np.int64)
        start, windows, size = (unpacked(table, name, np.int32).astype(np.int64) for name in ("start", "windows", "size"))
        text = unpacked(table, "text", np.uint8).reshape(-1, width)
        order = np.argsort(anchor, kind="stable")
        whole = size[order] == windows[order] - 1 + length
        order = order[whole]
        total, out, low = np.cumsum(size[order]), [], 0
        ends = np.append(np.flatnonzero(anchor[order][1:] != anchor[order][:-1]) + 1, len(order))
        while low < len(order):
            reach = np.searchsorted(total, (total[low - 1] if low else 0) + EXPANSION, "right")
            high = int(ends[max(np.searchsorted(ends, reach, "right") - 1, np.searchsorted(ends, low, "right"))])
            own = order[low:high]
            out.append(_shared_windows(doc[own], start[own], windows[own], text[own], size[own], length))
            low = high
        found = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"doc_id": found[0], "start": found[1].astype(np.int32), "end": found[2].astype(np.int32)})

    parted = (
        texts.join(asked, "doc_id")
        .mapInArrow(fetch, packed_schema(names))
        .groupBy("part")
        .applyInArrow(expand, "doc_id long, start int, end int")
    )
    covered = settled.filter("not open").select("doc_id", "start", (F.col("start") + F.col("windows") - 1 + length).alias("end"))
    return covered.unionByName(parted)


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, kept (the bytes left), n_bytes, n_removed, spans (maximal, in bytes).

    Matches never cross texts. Null and empty texts, and texts shorter than `length`, lose nothing. A doc_id stands for one
    text: rows that repeat it lose the same and never cover each other. A row without doc_id stays whole and covers nothing.
    Texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    texts = compressed(docs)
    ranges = repeated(docs, texts, length, gram)
    gathered = ranges.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, spans = [], [], []
            for blob, starts, ends in zip(*(batch.column(x) for x in ("packed", "starts", "ends")), strict=True):
                text = _plain(blob.as_py())
                a, b = [], []
                if starts.is_valid:
                    a, b = (x.tolist() for x in merged(starts.values.to_numpy(), ends.values.to_numpy()))
                kept.append(b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)))
                sizes.append(len(text))
                spans.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
            removed = [n - len(x) for n, x in zip(sizes, kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span)],
                names=["doc_id", "kept", "n_bytes", "n_removed", "spans"],
            )

    return texts.join(gathered, "doc_id", "left").mapInArrow(
        work, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>"
    )
