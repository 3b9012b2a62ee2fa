"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton reads a training text word by word and tracks the longest match with any item. Where that reaches the
window (13 words, or the whole of a shorter item), the window's words are hit. Only runs of words whose neighbours
also stand side by side in an item are read; no window can lie elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.text_arrays import ALNUM, RangeHash, chunks, rows_of, words

WINDOW = 13
#: Items are dealt to automata of about so many words; each is broadcast by itself, so a broadcast has a bound.
AUTOMATON_WORDS = 200_000
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A document is contaminated if hits cover one word in so many, or more.
COVERAGE = 20
STATE = "bits binary, longest long, items array<string>"
HITS = "n_words long, n_hit long, longest long, items array<string>, spans array<struct<start:int,end:int>>"


class Automaton:
    """Suffix automaton of several word sequences; states know the items of their windows."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for _, sequence in items:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
            ends.append(last)
        #: Items that have a state's window of full length; items that are a state's whole (short) sequence.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}
        for (name, sequence), end in zip(items, ends, strict=True):
            if len(sequence) < window:
                if sequence:
                    self.short.setdefault(end, set()).add(name)
                continue
            state = 0
            for place, word in enumerate(sequence):
                state = self.next[state][word]
                if place + 1 >= window:
                    self.full.setdefault(self._suffix(state), set()).add(name)
        #: The nearest state on the way to the root, itself included, that ends a short item.
        self.ending = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.ending[state] = state if state in self.short else self.ending[self.link[state]]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, origin: int, word: int, target: int) -> int:
        """A copy of `target` for the shorter sequences that come through `origin`."""
        copy = self._state(self.length[origin] + 1, self.link[target], dict(self.next[target]))
        while origin != -1 and self.next[origin].get(word) == target:
            self.next[origin][word] = copy
            origin = self.link[origin]
        self.link[target] = copy
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:
            # Another item began like this.
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._state(self.length[last] + 1, 0, {})
        origin = last
        while origin != -1 and word not in self.next[origin]:
            self.next[origin][word] = new
            origin = self.link[origin]
        if origin != -1:
            target = self.next[origin][word]
            self.link[new] = target if self.length[target] == self.length[origin] + 1 else self._split(origin, word, target)
        return new

    def _suffix(self, state: int) -> int:
        """The state of the last `window` words of a match that ends in `state`."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def read(self, sequence: list[int]) -> Iterator[tuple[int, int, int, set[str]]]:
        """(begin, end, longest match at the end, items) of every window that occurs in the sequence."""
        state = matched = 0
        for place, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= self.window:
                yield place + 1 - self.window, place + 1, matched, self.full[self._suffix(state)]
            ending = self.ending[state]
            while ending > 0:
                if self.length[ending] <= matched:
                    yield place + 1 - self.length[ending], place + 1, matched, self.short[ending]
                ending = self.ending[self.link[ending]]


def _hashes(sequence: list[str]) -> np.ndarray:
    """The hash that RangeHash gives each word inside a text."""
    encoded = [x.encode() for x in sequence]
    ends = np.cumsum([len(x) for x in encoded])
    return RangeHash(np.frombuffer(b"".join(encoded), np.uint8)).of(np.concatenate(([0], ends[:-1])), ends)


class Index:
    """An automaton over word numbers, with the words and the word pairs of its items."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int) -> None:
        items = [(name, sequence) for name, sequence in items if sequence]
        every = [word for _, sequence in items for word in sequence]
        self.least = min([window, *(len(sequence) for _, sequence in items)])
        self.vocabulary = np.unique(_hashes(every)) if every else np.zeros(0, np.uint64)
        numbers = []
        for _, sequence in items:
            numbers.append(np.searchsorted(self.vocabulary, _hashes(sequence)))
        pairs = [x[:-1] * len(self.vocabulary) + x[1:] for x in numbers if len(x) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.automaton = Automaton([(name, x.tolist()) for (name, _), x in zip(items, numbers, strict=True)], window)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def runs(self, numbers: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of known words whose neighbours are neighbours in an item, at least as long as a window."""
        if not len(numbers):
            return []
        known = numbers >= 0
        joined = np.zeros(len(numbers), bool)
        both = np.flatnonzero(known[1:] & known[:-1] & (rows[1:] == rows[:-1])) + 1
        if len(self.pairs) and len(both):
            key = numbers[both - 1] * len(self.vocabulary) + numbers[both]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[both] = self.pairs[at] == key
        starts = np.flatnonzero(known & ~joined)
        if not len(starts):
            return []
        # A run ends before the next word that does not continue one.
        breaks = np.append(np.flatnonzero(~joined), len(numbers))
        ends = breaks[np.searchsorted(breaks, starts, "right")]
        enough = ends - starts >= self.least
        return list(zip(starts[enough].tolist(), ends[enough].tolist(), strict=True))


def _bits(blob: bytes | None, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=count).astype(bool) if blob else np.zeros(count, bool)


def _scan_with(items, window: int, first: bool, last: bool, with_text: bool):
    """A function over Arrow batches that matches texts with the items of a broadcast.

    Between two automata a row carries its hits so far: a bit per word, its longest match and its items.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items.value, window)
        for batch in batches:
            for chunk in chunks(batch):
                count = len(chunk)
                found = words(chunk, ALNUM)
                numbers = index.numbers(RangeHash(chunk.data).of(found.starts, found.ends))
                row_of = rows_of(found.rows)
                rest = pa.Table.from_batches([batch.slice(chunk.first, count)])
                hit = np.zeros(len(numbers), bool)
                longest: dict[int, int] = {}
                names: dict[int, set[str]] = {}
                if not first:
                    for row, (bits, most, own) in enumerate(
                        zip(*(rest.column(x).to_pylist() for x in ("bits", "longest", "items")), strict=True)
                    ):
                        if own:
                            low, high = int(found.rows[row]), int(found.rows[row + 1])
                            hit[low:high] = _bits(bits, high - low)
                            longest[row], names[row] = most, set(own)
                    rest = rest.drop_columns(["bits", "longest", "items"])
                for start, end in index.runs(numbers, row_of):
                    row = int(row_of[start])
                    for a, b, matched, own in index.automaton.read(numbers[start:end].tolist()):
                        hit[start + a : start + b] = True
                        longest[row] = max(longest.get(row, 0), matched)
                        names.setdefault(row, set()).update(own)
                if last:
                    spans: list = [[]] * count
                    for row in names:
                        spans[row] = _spans(chunk, found, hit, row)
                    if not with_text:
                        rest = rest.drop_columns(["text"])
                    columns = {
                        "n_words": pa.array(found.counts(), pa.int64()),
                        "n_hit": pa.array(np.bincount(row_of[hit], minlength=count), pa.int64()),
                        "longest": pa.array([longest.get(i, 0) for i in range(count)], pa.int64()),
                        "items": pa.array([sorted(names.get(i, ())) for i in range(count)], pa.list_(pa.string())),
                        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    }
                else:
                    ranges = [(int(found.rows[i]), int(found.rows[i + 1])) for i in range(count)]
                    columns = {
                        "bits": pa.array([np.packbits(hit[a:b]).tobytes() if i in names else None for i, (a, b) in enumerate(ranges)], pa.binary()),
                        "longest": pa.array([longest.get(i, 0) for i in range(count)], pa.int64()),
                        "items": pa.array([sorted(names.get(i, ())) for i in range(count)], pa.list_(pa.string())),
                    }
                for name, column in columns.items():
                    rest = rest.append_column(name, column)
                yield from rest.to_batches()

    return work


def _spans(chunk, found, hit: np.ndarray, row: int) -> list[dict]:
    """Code point ranges from the first to the last word of each run of hit words."""
    low, high = int(found.rows[row]), int(found.rows[row + 1])
    edge = np.diff(np.concatenate(([0], hit[low:high].astype(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1) + low, np.flatnonzero(edge == -1) - 1 + low
    first = int(chunk.bounds[row])
    points = np.concatenate(([0], np.cumsum((chunk.data[first : int(chunk.bounds[row + 1])] & 0xC0) != 0x80)))
    return [
        {"start": int(points[found.starts[a] - first]), "end": int(points[found.ends[b] - first])}
        for a, b in zip(begins, ends, strict=True)
    ]


def _hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], with_text: bool, window: int) -> DataFrame:
    """The columns `keep` as _keep_0, _keep_1, ..., the text if asked for, and the hits."""
    spark = docs.sparkSession
    items = benchmark.filter("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item_id"), "text"
    )
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 + int(size) // (5 * AUTOMATON_WORDS)
    rows = docs.select(*[F.col(name).alias(f"_keep_{i}") for i, name in enumerate(keep)], "text")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]
    kept = fields if with_text else fields[:-1]
    for shard in range(shards):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).collect()
        sequences = [(row.item_id, _WORD.findall(row.text.translate(_LOWER))) for row in own]
        last = shard == shards - 1
        schema = ", ".join([*kept, HITS] if last else [*fields, STATE])
        work = _scan_with(spark.sparkContext.broadcast(sequences), window, shard == 0, last, with_text)
        rows = rows.mapInArrow(work, schema)
    return rows


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_hit, longest match, items hit, spans hit (code points).

    `benchmark` has item_id and text. Null, empty and wordless texts have no words; such items match nothing; rows with a
    null item_id are left out. Items that share an id count as one. Texts are read whole. An empty benchmark hits nothing, an
    empty `docs` gives no rows, repeated rows are scanned one by one; other columns are ignored.

    A benchmark of more than about AUTOMATON_WORDS words is dealt to several automata by the hash of its items; the
    documents pass through one after the other in the same tasks, and each broadcast keeps its bound.
    """
    return _hits(docs, benchmark, ["doc_id"], False, window).withColumnRenamed("_keep_0", "doc_id")


def contaminated(share: int = COVERAGE) -> Column:
    """Whether hits cover at least one word in `share`."""
    return F.expr(f"n_hit > 0 and {share} * n_hit >= n_words")


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: int = COVERAGE) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns."""
    names = [name for name in docs.columns if name != "text"]
    hits = _hits(docs, benchmark, names, True, WINDOW).filter(~contaminated(share))
    return hits.select(*[F.col("text") if n == "text" else F.col(f"_keep_{names.index(n)}").alias(n) for n in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, share: int = COVERAGE) -> DataFrame:
    """All rows of `docs`, the hit spans cut out of contaminated texts; other columns as they are."""
    names = [name for name in docs.columns if name != "text"]
    hits = _hits(docs, benchmark, names, True, WINDOW)
    left = F.expr(
        "concat(array_join(transform(spans, (s, i) -> substring(text, if(i = 0, 0, spans[i - 1].end) + 1,"
        " s.start - if(i = 0, 0, spans[i - 1].end))), ''), substring(text, spans[size(spans) - 1].end + 1))"
    )
    cut = F.when(contaminated(share), left).otherwise(F.col("text"))
    return hits.select(*[cut.alias(n) if n == "text" else F.col(f"_keep_{names.index(n)}").alias(n) for n in docs.columns])
