"""Spelling variants: words one edit apart, found through a reduced alphabet, and the form each of them goes back to.

1. Count. Tasks count the words of their texts; words that occur often enough are the vocabulary, a written table.
2. Reduce. Letters are hashed to a few symbols, so a word becomes a short string over a small alphabet. Of each reduced word
   the one-edit neighbourhood is generated. An edit is made at one end of a pair only: the longer word deletes, and of two
   words of one length the one with the larger symbol replaces it by each smaller one. Together these are the full
   neighbourhoods, and every pair meets once.
3. Join. Reduced words and neighbours meet by their hash. They are dealt to as many parts as the vocabulary needs, whatever
   the cluster's setting; a word's letters travel once per part.
4. Verify. Pairs that meet are compared on their original letters, in blocks of bounded size.
5. Follow. Each word's most frequent neighbour, if ten times as frequent, is its form; forms are followed to the last by
   pointer doubling.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.packing import unpacked
from wattloom.llm.text_arrays import LOWER, Chunk, chunks, mix
from wattloom.session import cut_lineage

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
#: One run in this many, by its hash, loses a letter.
EVERY = 31
#: Distinct words a task holds before it sends their counts on.
HELD_WORDS = 400_000
#: Neighbours generated before they are sent on, words per part, and letters compared at once.
HELD_KEYS = 1_000_000
PART_WORDS = 20_000
BLOCK_LETTERS = 16 << 20
#: Letters in the usual order of their frequency; neighbours in this order get different symbols.
BY_FREQUENCY = b"etaoinshrdlucmfwypvbgkqjxz"

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def continued_crc(data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The crc32 of many byte ranges at once, each continued from the crc32 `state` of what stands before it."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    starts, sizes = begin[order], size[order]
    crc = state[order] ^ np.uint32(0xFFFFFFFF)
    # A few very long runs are left to the library.
    long = int(np.searchsorted(-sizes, -64, "left"))
    for place in range(long):
        head = int(crc[place] ^ np.uint32(0xFFFFFFFF))
        crc[place] = zlib.crc32(data[starts[place] : starts[place] + sizes[place]].tobytes(), head) ^ 0xFFFFFFFF
    for step in range(int(sizes[long]) if long < len(sizes) else 0):
        high = int(np.searchsorted(-sizes, -step, "left"))
        part = crc[long:high]
        crc[long:high] = _CRC[(part ^ data[starts[long:high] + step]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def words_of(chunk: Chunk, heads: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(letters, bounds) of the words of a chunk, one byte per letter (its code point); `heads` is the crc32 of `<doc_id>:`.

    Runs are of a-z and U+00C0 to U+00FF, A-Z lower-cased; a run whose crc32 is divided by EVERY loses a letter.
    """
    data = LOWER[chunk.data]
    edge = np.zeros(len(data) + 1, bool)
    edge[chunk.bounds] = True
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    second &= ~edge[:-1]
    last = np.flatnonzero(_LETTER[data] | second)
    if not len(last):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = second[last]
    first = last - wide
    fresh = edge[first]
    fresh[0] = True
    fresh[1:] |= first[1:] != last[:-1] + 1
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(last)))
    kept = sizes >= least
    starts, sizes = starts[kept], sizes[kept]
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    begin, end = first[starts], last[starts + sizes - 1] + 1
    crc = continued_crc(data, begin, end, heads[np.searchsorted(chunk.bounds, begin, "right") - 1])
    cut = np.flatnonzero(crc % np.uint32(EVERY) == 0)
    letters = np.where(wide, data[last] | 0x40, data[last]).astype(np.uint8)
    member = np.zeros(len(last) + 1, np.int32)
    member[starts] += 1
    member[starts + sizes] -= 1
    member = np.cumsum(member[:-1]).astype(bool)
    member[starts[cut] + (crc[cut].astype(np.int64) % sizes[cut])] = False
    sizes[cut] -= 1
    short = np.flatnonzero(sizes < least)
    for place in short.tolist():
        # Runs of the least length that lost a letter.
        member[starts[place] : starts[place] + least] = False
    sizes = sizes[sizes >= least]
    return letters[member], np.concatenate(([0], np.cumsum(sizes)))


def _binary(letters: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))]
    )


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word binary, n): the words of all texts that occur `least_count` times or more, letters as one byte each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            heads = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids], np.uint32)
            for chunk in chunks(batch):
                found = _binary(*words_of(chunk, heads[chunk.first : chunk.first + len(chunk)], least))
                counts = pc.value_counts(found)
                held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                if sum(len(x) for x in held) > 2 * HELD_WORDS:
                    held = [summed()]
                    if len(held[0]) > HELD_WORDS:
                        yield from held.pop().cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).to_batches(50_000)
        if held:
            yield from summed().cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).to_batches(50_000)

    counted = docs.select("doc_id", "text").mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def symbol_table(symbols: int) -> np.ndarray:
    """The symbol of every letter: usual letters are dealt out by frequency, all others by their code."""
    table = (np.arange(256) % symbols).astype(np.uint8)
    table[list(BY_FREQUENCY)] = np.arange(len(BY_FREQUENCY)) % symbols
    return table


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def neighbour_keys(reduced: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own keys, neighbours' keys, their rows) of reduced words of one length, one per row of the matrix.

    A reduced word is a polynomial over its symbols, so the hash after an edit follows from sums of a part of it.
    """
    count, length = reduced.shape
    powers = np.full(length + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    value = mix(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    terms = value[reduced] * powers[:length]
    before = np.zeros((count, length + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    total = before[:, -1:]

    def closed(raw: np.ndarray, size: int) -> np.ndarray:
        return mix(raw + np.uint64(size * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))

    # Deleting any symbol of a run of equal ones gives the same word: only the first is deleted.
    first = np.ones(reduced.shape, bool)
    first[:, 1:] = reduced[:, 1:] != reduced[:, :-1]
    row, place = np.nonzero(first)
    keys = [closed(before[row, place] + (total[row, 0] - before[row, place + 1]) * _BACK, length - 1)]
    rows = [row]
    for smaller in range(symbols - 1):
        row, place = np.nonzero(reduced > smaller)
        keys.append(closed(total[row, 0] + (value[smaller] - value[reduced[row, place]]) * powers[place], length))
        rows.append(row)
    return closed(total[:, 0], length), np.concatenate(keys), np.concatenate(rows)


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    begins = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - begins, sizes) + np.arange(int(sizes.sum()))]


#: What travels per part: words (letters, sizes, counts), then keys with the place of their word, neighbours' flag apart.
SENT = "part int, letters binary, sizes binary, counts binary, key binary, word binary, own binary"


def _sent(parts: int, letters, starts, sizes, counts, keys, words, own) -> pa.RecordBatch:
    """One row per part with its words and keys."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((words, part))
    part, words, own = part[order], words[order], own[order]
    rest = (keys[order] // np.uint64(parts)).astype(np.uint32)
    fresh = np.ones(len(part), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (words[1:] != words[:-1])
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    begins = np.flatnonzero(new)
    bounds = np.append(begins, len(part))
    number = np.cumsum(fresh) - 1
    entry = words[fresh]
    # Words of the part, and the place of each key's word among them.
    word_bounds = np.append(number[begins], len(entry))
    place = (number - np.repeat(number[begins], np.diff(bounds))).astype(np.uint32)
    text = _gathered(letters, starts[entry], sizes[entry])
    text_bounds = np.concatenate(([0], np.cumsum(sizes[entry])))[word_bounds]

    def column(values: np.ndarray, edges: np.ndarray) -> pa.Array:
        data = np.ascontiguousarray(values)
        offsets = (edges * data.dtype.itemsize).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())

    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[begins].astype(np.int32)), column(text, text_bounds), column(sizes[entry].astype(np.uint32), word_bounds),
            column(counts[entry].astype(np.int64), word_bounds), column(rest, bounds), column(place, bounds), column(own.astype(np.uint8), bounds),
        ],
        names=["part", "letters", "sizes", "counts", "key", "word", "own"],
    )


def _dealt(words: DataFrame, symbols: int, parts: int) -> DataFrame:
    """Reduced words and their neighbourhoods, by part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table(symbols)
        for batch in batches:
            for chunk in chunks(batch, "word", 1 << 18):
                sizes = np.diff(chunk.bounds)
                starts = chunk.bounds[:-1]
                counts = batch.column("n").slice(chunk.first, len(chunk)).to_numpy().astype(np.int64)
                held: list[tuple[np.ndarray, ...]] = []
                for length in np.unique(sizes).tolist():
                    mine = np.flatnonzero(sizes == length)
                    step = max(1, HELD_KEYS // (length * (symbols + 1)))
                    for low in range(0, len(mine), step):
                        some = mine[low : low + step]
                        reduced = table[chunk.data[starts[some][:, None] + np.arange(length)]]
                        own, keys, rows = neighbour_keys(reduced, symbols)
                        held.append((np.concatenate((own, keys)), np.concatenate((some, some[rows])), np.arange(len(own) + len(keys)) < len(own)))
                        if sum(len(x[0]) for x in held) > HELD_KEYS:
                            yield _sent(parts, chunk.data, starts, sizes, counts, *(np.concatenate(x) for x in zip(*held, strict=True)))
                            held.clear()
                if held:
                    yield _sent(parts, chunk.data, starts, sizes, counts, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return words.select("word", "n").mapInArrow(work, SENT)


def one_edit(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words a[i] and b[i] differ by exactly one letter inserted, deleted or replaced.

    Words lie in `data`. Pairs are compared by width, BLOCK_LETTERS letters at a time.
    """
    out = np.zeros(len(a), bool)
    swap = sizes[a] < sizes[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    gap = sizes[a] - sizes[b]
    width = np.where(gap <= 1, 1 << np.ceil(np.log2(np.maximum(sizes[a], 8))).astype(np.int64), 0)
    padded = np.concatenate((data, np.zeros(int(width.max(initial=0)), np.uint8)))
    for wide in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == wide)
        step = max(1, BLOCK_LETTERS // wide)
        column = np.arange(wide)
        for low in range(0, len(mine), step):
            some = mine[low : low + step]
            x, y = padded[starts[a[some]][:, None] + column], padded[starts[b[some]][:, None] + column]
            size = sizes[b[some]]
            inside = column < size[:, None]
            differ = (x != y) & inside
            same_size = gap[some] == 0
            # The longer word, without the letter at the first difference, goes on as the shorter does.
            shifted = (x[:, 1:] != y[:, :-1]) & inside[:, :-1]
            from_first = np.maximum.accumulate(differ, axis=1)[:, :-1]
            out[some] = np.where(same_size, differ.sum(axis=1) == 1, ~(shifted & from_first).any(axis=1))
    return out


def _letter_sets(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The set of a word's letters as bits; one edit changes two at most."""
    bits = np.uint64(1) << (data % np.uint8(64)).astype(np.uint64)
    return np.bitwise_or.reduceat(bits, starts) if len(starts) else np.zeros(0, np.uint64)


def _near(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Per word of a part: the number of its near words there, and the best of those TIMES as frequent."""
    letters, sizes = unpacked(table, "letters", np.uint8), unpacked(table, "sizes", np.uint32).astype(np.int64)
    counts = unpacked(table, "counts", np.int64)
    rest, place = unpacked(table, "key", np.uint32), unpacked(table, "word", np.uint32).astype(np.int64)
    own = unpacked(table, "own", np.uint8).astype(bool)
    per_row = np.array([len(x) // 4 for x in table.column("sizes").to_pylist()], np.int64)
    keys_per_row = np.array([len(x) // 4 for x in table.column("key").to_pylist()], np.int64)
    word = place + np.repeat(np.cumsum(per_row) - per_row, keys_per_row)
    starts = np.cumsum(sizes) - sizes
    sets = _letter_sets(letters, starts, sizes)
    order = np.argsort(rest[own], kind="stable")
    own_key, own_word = rest[own][order], word[own][order]
    near_key, near_word = rest[~own], word[~own]
    # A reduced word meets the equal ones before it, a neighbour all that are equal to it.
    low = np.concatenate((np.searchsorted(own_key, own_key, "left"), np.searchsorted(own_key, near_key, "left")))
    high = np.concatenate((np.arange(len(own_key)), np.searchsorted(own_key, near_key, "right")))
    asks = np.concatenate((own_word, near_word))
    meets = high > low
    low, high, asks = low[meets], high[meets], asks[meets]
    ends = np.cumsum(high - low)
    found: list[np.ndarray] = []
    at = 0
    while at < len(asks):
        base = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + 2_000_000, "right")))
        n = high[at:upto] - low[at:upto]
        a = np.repeat(asks[at:upto], n)
        b = own_word[np.repeat(low[at:upto] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        alike = np.flatnonzero(np.bitwise_count(sets[a] ^ sets[b]) <= 2)
        a, b = a[alike], b[alike]
        true = one_edit(letters, starts, sizes, a, b)
        found.append(np.minimum(a[true], b[true]) << 32 | np.maximum(a[true], b[true]))
        at = upto
    # A pair whose keys agree in the bits that were sent could meet twice.
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    better = np.where(counts[b] >= TIMES * counts[a], counts[b], 0)
    all_words = _binary(letters, np.concatenate((starts, [len(letters)])))
    rank = np.empty(len(sizes), np.int64)
    rank[pc.sort_indices(all_words).to_numpy()] = np.arange(len(sizes))
    order = np.lexsort((rank[b], -better, a))
    a, b, better = a[order], b[order], better[order]
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    chosen = better[first]
    form = pc.if_else(pa.array(chosen > 0), all_words.take(pa.array(b[first])), pa.scalar(None, pa.large_binary()))
    return pa.table(
        {
            "word": all_words.take(pa.array(a[first])).cast(pa.binary()),
            "n_near": np.diff(np.append(first, len(a))),
            "form": form.cast(pa.binary()),
            "form_n": pa.array(chosen, mask=chosen == 0),
        }
    )


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): pointers are doubled until none moves.

    Counts grow tenfold with each step, so a chain has at most 19 of them and five rounds are enough.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(5):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(roots.join(onward, "root", "left").select("word", "root", "_next"))
        roots = moved.select("word", F.coalesce("_next", "root").alias("root"))
        if moved.filter("_next is not null").isEmpty():
            break
    return roots


def default_symbols(words: int) -> int:
    """So many symbols that ten letters have about one reduced word for each word: 4 for a million, 10 for ten thousand million."""
    return max(3, round(words**0.1))


def variants(docs: DataFrame, symbols: int | None = None, part_words: int = PART_WORDS) -> DataFrame:
    """Per word of `docs` (doc_id, text): word, n, n_near, form, form_n, root.

    Words are the runs of letters (see `words_of`) of LEAST_LENGTH letters or more that occur LEAST_COUNT times or more over
    all texts. `form` is the most frequent word one edit away (the first in code-point order on a tie) if it is TIMES as
    frequent, else null; `root` is where the forms lead in the end, the word itself without one.

    Null, empty and letterless texts add no words, and an empty table gives no rows. Rows that repeat count again; a null
    doc_id enters the hash as empty text. Long texts and runs are whole. Other columns are ignored. `symbols` and `part_words`
    change the plan, never the result.
    """
    words = cut_lineage(vocabulary(docs))
    size = words.count()
    symbols = symbols or default_symbols(size)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_words))
    near = _dealt(words, symbols, parts).groupBy("part").applyInArrow(_near, "word binary, n_near long, form binary, form_n long")
    # Of equally frequent forms the smallest: the order of the words, taken as text, is that of their letters.
    chosen = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    joined = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), chosen.alias("best"))
    found = cut_lineage(
        words.join(joined, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"),
        )
    )
    roots = _rooted(found.filter("form is not null"))
    text = {name: F.decode(name, "ISO-8859-1").alias(name) for name in ("word", "form")}
    return found.join(roots, "word", "left").select(
        text["word"], "n", "n_near", text["form"], "form_n", F.decode(F.coalesce("root", "word"), "ISO-8859-1").alias("root")
    )
