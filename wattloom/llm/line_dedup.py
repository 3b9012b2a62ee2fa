"""Substring dedup by hashing lines and sentences.

Units are lines, and sentences inside lines of several sentences. Those too short to tell anything alone form units with
their neighbours, across lines: from each one on, and up to each one, as few sentences as have enough words, once among
short ones only and once among all. So it does not matter where in a text a repeated passage of them begins or ends. A unit
is normalised (A-Z lower case, white space to one space) and hashed to 128 bits over its words. Of equal units the one with
the smallest (doc_id, place) stays; all others are cut out of their texts, by byte ranges of the original.

Tasks first settle equal units among themselves and send one entry per digest, so a line that a third of all texts
share costs its task one entry, not one per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.packing import packed, packed_schema, unpacked
from wattloom.llm.text_arrays import SPACED, Chunk, RangeHash, _Powers, chunks, mix, words

MIN_LINE_WORDS = 5
MIN_SENTENCE_WORDS = 8
#: Words of a unit of a short sentence and neighbours that are not all short. In a repeated passage of 50 words, each sentence
#: has that many on one side of it at least, itself included.
CONTEXT_WORDS = 25
#: Bytes that end a sentence, and those that may close a quotation or bracket behind them.
STOPS, CLOSERS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b".!?", b"\"')]}"))
#: Their like beyond ASCII, by their last three bytes, or two.
WIDE_STOPS = [x.encode() for x in "…。！？"]
WIDE_CLOSERS = [x.encode() for x in "”’»）」"]
NAMES = ["high", "low", "doc", "start", "end", "kind"]
FLUSH = 1_000_000


def _between(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of word hashes."""
    up, down = _Powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _ends_with(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sign: bytes) -> np.ndarray:
    """Whether the byte ranges end with a sign."""
    out = ends - starts >= len(sign)
    for i, byte in enumerate(reversed(sign)):
        out &= data[np.maximum(ends - 1 - i, 0)] == byte
    return out


def _stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a sentence ends with the word: a stop, and at most two signs that close something behind it."""
    ends = ends.copy()
    stop = STOPS[data[ends - 1]]
    for _ in range(2):
        # Few words end with a sign; only they are looked at.
        some = np.flatnonzero(~stop & (CLOSERS[data[ends - 1]] | (data[ends - 1] >= 0x80)))
        low, high = starts[some], ends[some]
        less = CLOSERS[data[high - 1]].astype(np.int64)
        for sign in WIDE_CLOSERS:
            less[_ends_with(data, low, high, sign)] = len(sign)
        high = np.where(high - less > low, high - less, high)
        ends[some] = high
        stop[some] = STOPS[data[high - 1]]
        for sign in WIDE_STOPS:
            stop[some] |= _ends_with(data, low, high, sign)
    return stop


def _joined(begin: np.ndarray, end: np.ndarray, some: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of `least` words or more from each of `some` sentences on, and up to each, inside its group.

    Sentences follow each other (`begin`, `end`: words); groups are runs of them.
    """
    last = np.searchsorted(end, begin[some] + least)
    inside = last < len(end)
    inside[inside] = group[last[inside]] == group[some[inside]]
    first = np.searchsorted(begin, end[some] - least, "right") - 1
    within = first >= 0
    within[within] = group[first[within]] == group[some[within]]
    return (
        np.concatenate((begin[some[inside]], begin[first[within]])),
        np.concatenate((end[last[inside]], end[some[within]])),
    )


def units(chunk: Chunk, min_line: int, min_sentence: int) -> tuple[np.ndarray, ...]:
    """(high, low, row, start byte, end byte) of every unit of each text, places within the text."""
    found = words(chunk, SPACED)
    none = np.zeros(0, np.uint64)
    if not len(found.starts):
        return none, none, *(np.zeros(0, np.int64) for _ in range(3))
    data, count = chunk.data, len(found.starts)
    breaks = np.flatnonzero(data == 0x0A)
    # Words of one line have as many line feeds, and texts, before them.
    text = np.searchsorted(chunk.bounds, found.starts, "right")
    line = np.searchsorted(breaks, found.starts) + text * (len(breaks) + 1)
    new_line = np.concatenate(([True], line[1:] != line[:-1]))
    stop = _stops(data, found.starts, found.ends)
    new_sentence = new_line | np.concatenate(([True], stop[:-1]))
    lines, sentences = np.flatnonzero(new_line), np.flatnonzero(new_sentence)
    line_ends, sentence_ends = np.append(lines[1:], count), np.append(sentences[1:], count)
    part = ~(new_line[sentences] & np.isin(sentence_ends, line_ends))
    keep_line = line_ends - lines >= min_line
    keep_sentence = part & (sentence_ends - sentences >= min_sentence)
    short = (sentence_ends - sentences < min_sentence) | (~part & (sentence_ends - sentences < min_line))
    some, text = np.flatnonzero(short), text[sentences]
    # Short sentences that follow each other in a text, and whole texts.
    run = np.cumsum(np.concatenate(([True], (text[1:] != text[:-1]) | (short[1:] != short[:-1]))))
    joined = [_joined(sentences, sentence_ends, some, *x) for x in ((run, min_sentence), (text, max(CONTEXT_WORDS, min_sentence)))]
    begin = np.concatenate((lines[keep_line], sentences[keep_sentence], *(x[0] for x in joined)))
    end = np.concatenate((line_ends[keep_line], sentence_ends[keep_sentence], *(x[1] for x in joined)))
    begin, end = np.divmod(np.unique(begin * (count + 1) + end), count + 1)
    hashes = RangeHash(data).of(found.starts, found.ends)
    row = np.searchsorted(chunk.bounds, found.starts[begin], "right") - 1
    first = chunk.bounds[row]
    # A unit takes the white space behind it, up to the next word or the line feed that ends its line.
    after = np.minimum(np.append(found.starts, len(data))[end], chunk.bounds[row + 1])
    feed = np.append(breaks, len(data))[np.searchsorted(breaks, found.ends[end - 1])] + 1
    ends = np.minimum(after, feed)
    other = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return _between(hashes, begin, end), _between(other, begin, end), row, found.starts[begin] - first, ends - first


def _first_of_equal(high: np.ndarray, low: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by digest, then rank; whether an element in that order is the first of its digest.

    Rows that repeat a doc_id and place count as the same occurrence.
    """
    order = np.lexsort((start, doc, low, high))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    leader = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    same = (doc[order] == doc[order][leader]) & (start[order] == start[order][leader])
    return order, fresh | same


def repeated(docs: DataFrame, min_line_words: int = MIN_LINE_WORDS, min_sentence_words: int = MIN_SENTENCE_WORDS) -> DataFrame:
    """(doc_id, start, end): byte ranges of units that occur earlier, in any text or above in the same one."""
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            high, low, doc, start, end = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, first = _first_of_equal(high, low, doc, start)
            kind = (~first).astype(np.uint8)
            high, low, doc, start, end = (x[order] for x in (high, low, doc, start, end))
            # What is not the first here is not the first anywhere: it only travels to be gathered with the rest.
            part = np.where(first, high, doc.view(np.uint64)) % np.uint64(parts)
            return packed(part.astype(np.int32), [high, low, doc, start.astype(np.int32), end.astype(np.int32), kind], NAMES)

        for batch in batches:
            ids = batch.column("doc_id")
            for chunk in chunks(batch):
                high, low, row, start, end = units(chunk, min_line_words, min_sentence_words)
                own = ids.slice(chunk.first, len(chunk)).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((high, low, own[row], start, end))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield flush()
        if sum(len(x[0]) for x in held):
            yield flush()

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        high, low = unpacked(table, "high", np.uint64), unpacked(table, "low", np.uint64)
        doc = unpacked(table, "doc", np.int64)
        start, end = unpacked(table, "start", np.int32), unpacked(table, "end", np.int32)
        local = unpacked(table, "kind", np.uint8).astype(bool)
        rest = np.flatnonzero(~local)
        order, first = _first_of_equal(high[rest], low[rest], doc[rest], start[rest])
        gone = np.concatenate((np.flatnonzero(local), rest[order[~first]]))
        return pa.table({"doc_id": doc[gone], "start": start[gone], "end": end[gone]})

    rows = docs.filter("doc_id is not null").select("doc_id", "text")
    return rows.mapInArrow(send, packed_schema(NAMES)).groupBy("part").applyInArrow(settle, "doc_id long, start int, end int")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that byte ranges cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]


def cut(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, kept (text without the ranges), n_bytes, n_removed, spans (merged byte ranges)."""
    gathered = ranges.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    pairs = docs.select("doc_id", "text").join(gathered, "doc_id", "left")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            kept, sizes, removed, spans = [], [], [], []
            for text, starts, ends in zip(texts, batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                text = text or b""
                sizes.append(len(text))
                runs: list[tuple[int, int]] = []
                if starts:
                    a, b = merged(np.array(starts), np.array(ends))
                    runs = list(zip(a.tolist(), b.tolist(), strict=True))
                out, at = [], 0
                for start, end in runs:
                    out.append(text[at:start])
                    at = end
                out.append(text[at:])
                kept.append(b"".join(out))
                removed.append(len(text) - len(kept[-1]))
                spans.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span)],
                names=["doc_id", "kept", "n_bytes", "n_removed", "spans"],
            )

    return pairs.mapInArrow(
        work, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>"
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, kept (UTF-8), n_bytes, n_removed, spans of the original.

    Null and empty texts lose nothing; a short sentence or line without neighbours that repeat with it stays. Rows that repeat a doc_id are
    judged by place, so equal rows of one id keep or lose the same; a row without doc_id stays whole. Texts are read whole;
    an empty table gives no rows; other columns are ignored.
    """
    return cut(docs, repeated(docs, **options))
