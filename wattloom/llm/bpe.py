"""Byte-pair encoding and decoding with a pair occurrence index.

The words of a batch that are not known yet lie in one array of symbols. An index maps every adjacent pair to all its
positions there; a heap holds the ranks that occur. Ranks are applied in ascending order: the pair is merged at all
its positions, and the lists of the pairs beside them are brought up to date. A merge that makes a pair of a
lower rank gives way to it, so every word sees its merges in the order it would see alone.

The vocabulary is a file of a public tokenizer (kind: words with an end mark, lower case, white space dropped). Its path
is a parameter, and every executor reads it there; nothing of it is stored here.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
WHITE = "\t\n\x0b\f\r \x85\xa0  -     　"
#: What separates the pieces that are looked up whole.
_PIECES = re.compile(f"[^{WHITE}]+")
#: Characters that Python's split takes for white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
# Code points that Unicode made letters or numbers after version 16, whose classes the tokenizer uses. To it
# they are neither.
_LATER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+", regex.V1)
#: The same by the tokenizer's classes; slower.
_NEWER_WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATER}]]+|[\p{{N}}--[{_LATER}]]|[[^{WHITE}\p{{L}}\p{{N}}]||[{_LATER}]]+", regex.V1
)
# Marks that Unicode added after version 9, whose normal form the tokenizer uses. They neither move nor combine there.
_MARKS = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85"
    "\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34"
    "\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1"
    "\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
_UNMOVED = re.compile(f"([{_MARKS}])")
# Lower case forms newer than Python's.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {upper: upper + 0x20 for upper in range(0x10D50, 0x10D66)} | {upper: upper + 0x1B for upper in range(0x16EA0, 0x16EB9)}
#: No character of the lists above comes before this one.
_FIRST_NEWER = "\u0558"
#: Entries per generation of a worker's memory of words; two generations are kept.
GENERATION = 100_000
SYMBOL_BITS = 20
#: Ranks that are taken up together, and the rank of a pair that does not merge.
WINDOW = 512
NEVER = 1 << 40


class Memory:
    """A bounded dictionary: what was not used for a whole generation is forgotten."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str):
        value = self.young.get(key)
        if value is None and key in self.old:
            value = self.old[key]
            self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Ids and merges of a vocabulary file, and what this process has encoded with them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.ids: dict[str, int] = stored["model"]["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in stored["added_tokens"]}
        self.tokens = {number: token for token, number in (self.ids | self.special).items()}
        self.texts = {number: str(number) for number in self.tokens}
        #: A pair is one number, its left symbol above its right one. Merges are (rank, joined symbol).
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(stored["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left] << SYMBOL_BITS | self.ids[right]] = (rank, self.ids[left + right])
        #: By rank: the pair, what it becomes, whether its symbols are equal.
        self.by_rank = {rank: (pair, joined, pair >> SYMBOL_BITS == pair & (1 << SYMBOL_BITS) - 1) for pair, (rank, joined) in self.merges.items()}
        self.pairs = np.array(sorted(self.merges), np.int64)
        self.ranks = np.array([self.merges[pair][0] for pair in self.pairs.tolist()], np.int64)
        self.size = len(stored["model"]["merges"])
        # A merge whose symbol is part of a pair of a lower rank.
        least: dict[int, int] = {}
        for rank, (pair, _, _) in self.by_rank.items():
            for part in (pair >> SYMBOL_BITS, pair & (1 << SYMBOL_BITS) - 1):
                least[part] = min(rank, least.get(part, rank))
        self.risky = {rank: least.get(joined, rank) < rank for rank, (_, joined, _) in self.by_rank.items()}
        characters = _byte_characters()
        self.inner = np.array([self.ids.get(x, -1) for x in characters], np.int64)
        self.final = np.array([self.ids.get(x + END, -1) for x in characters], np.int64)
        self.split_special = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        self.words, self.pieces = Memory(GENERATION), Memory(GENERATION)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, bounds) of words laid out one after the other: a symbol per byte that the vocabulary has."""
        data = [word.encode() for word in words]
        place = np.frombuffer(b"".join(data), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
        found = self.inner[place]
        found[bounds[1:] - 1] = self.final[place[bounds[1:] - 1]]
        known = found >= 0
        return found[known], np.concatenate(([0], np.cumsum(known)))[bounds]

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER for one that does not merge."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.ranks[at], NEVER)

    def encoded(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word (none is empty), all words worked on together.

        `rank[i]` is the rank of the pair that begins at place i. Active ranks are taken in ascending order, a window of them
        at a time: the index maps each to all places where its pair stands, and all of them are merged at once. The pairs on
        both sides get new ranks; those within the window enter the index.
        """
        if not words:
            return []
        start, bounds = self.symbols(words)
        count = len(start)
        # One more place, which stands for the end of a word on either side and merges with nothing.
        symbol = np.append(start, (1 << SYMBOL_BITS) - 1)
        first = np.zeros(count + 1, bool)
        first[bounds] = True
        places = np.arange(count + 1)
        after = np.where(np.append(first[1:], True), count, np.minimum(places + 1, count))
        before = np.where(first, count, places - 1)
        rank = self.ranks_of(symbol << SYMBOL_BITS | symbol[after])
        rank[count] = NEVER
        gone = np.zeros(count + 1, bool)
        for high in range(WINDOW, self.size + WINDOW, WINDOW):
            here = np.flatnonzero(rank < high)
            if not len(here):
                continue
            here = here[np.argsort(rank[here], kind="stable")]
            kinds, starts = np.unique(rank[here], return_index=True)
            index = dict(zip(kinds.tolist(), np.split(here, starts[1:]), strict=True))
            late: dict[int, list[int]] = {}
            heap = list(index)
            while heap:
                number = heapq.heappop(heap)
                at = index.pop(number, None)
                if number in late:
                    more = np.array(late.pop(number))
                    at = np.unique(more if at is None else np.concatenate((at, more)))
                if at is None:
                    continue
                # A place whose pair is another by now, or that is part of a symbol before it, has another rank.
                at = at[rank[at] == number]
                if len(at) and self.by_rank[number][2]:
                    at = self._apart(at, after)
                # Where a merge can make a pair of a lower rank, that one goes first in its word.
                for low in range(0, len(at), 1 if self.risky[number] else max(1, len(at))):
                    some = at[low : low + 1] if self.risky[number] else at
                    new, changed = self._merged(some, number, symbol, after, before, rank, gone)
                    inside = new < high
                    if inside.any():
                        soon = new[inside].tolist()
                        for kind, place in zip(soon, changed[inside].tolist(), strict=True):
                            if kind not in late:
                                late[kind] = []
                                heapq.heappush(heap, kind)
                            late[kind].append(place)
                        if min(soon) < number and low + 1 < len(at):
                            late.setdefault(number, []).extend(at[low + 1 :].tolist())
                            heapq.heappush(heap, number)
                            break
        left = np.flatnonzero(~gone[:count])
        cuts = np.searchsorted(left, bounds).tolist()
        ids = symbol[left].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Places of a pair of equal symbols without those that overlap the one taken before."""
        taken, blocked = [], -1
        for place, following in zip(at.tolist(), after[at].tolist(), strict=True):
            if place != blocked:
                taken.append(place)
                blocked = following
        return np.array(taken, np.int64)

    def _merged(self, at: np.ndarray, number: int, symbol, after, before, rank, gone) -> tuple[np.ndarray, np.ndarray]:
        """Merges the pair of rank `number` at places that do not overlap; the new ranks and where they stand."""
        joined = self.by_rank[number][1]
        right = after[at]
        following = after[right]
        symbol[at] = joined
        gone[right] = True
        rank[right] = NEVER
        after[at] = following
        before[following] = at
        previous = before[at]
        changed = np.concatenate((at, previous))
        new = self.ranks_of(np.concatenate((joined << SYMBOL_BITS | symbol[following], symbol[previous] << SYMBOL_BITS | joined)))
        rank[changed] = new
        return new, changed

    def learn(self, pieces: list[str]) -> dict[str, tuple[str, str, int]]:
        """Ids, decoded text and number of tokens of pieces without white space."""
        split = split_pieces(pieces)
        known: dict[str, tuple[str, str, int]] = {}
        fresh: dict[str, None] = {}
        memory = self.words
        for words in split:
            for word in words:
                if word not in known and word not in fresh:
                    value = memory.get(word)
                    if value is None:
                        fresh[word] = None
                    else:
                        known[word] = value
        texts, tokens = self.texts, self.tokens
        unknown = list(fresh)
        for word, ids in zip(unknown, self.encoded(unknown), strict=True):
            known[word] = value = (" ".join([texts[x] for x in ids]), " ".join([tokens[x] for x in ids]), len(ids))
            memory.put(word, value)
        out = {}
        put = self.pieces.put
        for piece, words in zip(pieces, split, strict=True):
            if len(words) == 1:
                value = known[words[0]]
            else:
                parts = [x for x in map(known.__getitem__, words) if x[2]]
                value = (" ".join([x[0] for x in parts]), " ".join([x[1] for x in parts]), sum([x[2] for x in parts]))
            out[piece] = value
            put(piece, value)
        return out


def normalised(text: str) -> str:
    """NFC and lower case, one character at a time (a final sigma is a sigma)."""
    if text.isascii():
        return text.lower()
    if max(text) < _FIRST_NEWER:
        composed = unicodedata.normalize("NFC", text)
    else:
        composed = "".join([unicodedata.normalize("NFC", x) for x in _UNMOVED.split(text)]).translate(_LOWER)
    return composed.replace("Σ", "σ").lower()


def split_words(piece: str) -> list[str]:
    """The words of a piece without white space, normalised."""
    text = normalised(piece)
    return (_WORDS if text.isascii() or max(text) < _FIRST_NEWER else _NEWER_WORDS).findall(text)


#: Words of ASCII texts and of those before the newer characters, and the line feed that parts pieces.
_ASCII_LINES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|\n|[^a-z0-9\n]+")
_LINES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|\n|[^{WHITE}\p{{L}}\p{{N}}]+", regex.V1)


def split_pieces(pieces: list[str]) -> list[list[str]]:
    """The words of each piece. Pieces hold no white space, so they are normalised and split in one go, as a line each."""
    out: list[list[str]] = [[] for _ in pieces]
    kinds: tuple[list[int], list[int]] = [], []
    for place, piece in enumerate(pieces):
        if piece.isascii():
            kinds[0].append(place)
        elif max(piece) < _FIRST_NEWER:
            kinds[1].append(place)
        else:
            out[place] = split_words(piece)
    for places, pattern in zip(kinds, (_ASCII_LINES, _LINES), strict=True):
        if places:
            rows = iter(places)
            found = out[next(rows)]
            for word in pattern.findall(normalised("\n".join([pieces[place] for place in places]))):
                if word == "\n":
                    found = out[next(rows)]
                else:
                    found.append(word)
    return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _pieces(text: str) -> list[str]:
    return _PIECES.findall(text) if _ODD.search(text) else text.split()


def encode_texts(path: str, texts: list[str | None]) -> Iterator[tuple[str, str, int]]:
    """Per text: token ids in decimal and decoded tokens, each joined by spaces, and the number of tokens."""
    book = vocabulary(path)
    # Special tokens are taken as they stand, before anything is normalised.
    split: list[list[tuple[list[str], str | None]]] = []
    unknown: list[str] = []
    seen: dict[str, tuple[str, str, int] | None] = {}
    memory = book.pieces
    for text in texts:
        text = text or ""
        specials = book.split_special.findall(text) if "<|" in text else []
        plain = book.split_special.split(text) if specials else [text]
        row = []
        for part, special in zip(plain, [*specials, None], strict=True):
            pieces = _pieces(part)
            row.append((pieces, special))
            for piece in set(pieces).difference(seen):
                value = seen[piece] = memory.get(piece)
                if value is None:
                    unknown.append(piece)
        split.append(row)
    if unknown:
        seen |= book.learn(unknown)
    for row in split:
        found: list[tuple[str, str, int]] = []
        for pieces, special in row:
            found += map(seen.__getitem__, pieces)
            if special is not None:
                found.append((str(book.special[special]), special, 1))
        ids, plain, counts = zip(*found, strict=True) if found else ((), (), ())
        if 0 in counts:
            # A piece without tokens leaves no space.
            ids, plain = [x for x in ids if x], [x for x, n in zip(plain, counts, strict=True) if n]
        yield " ".join(ids), " ".join(plain), sum(counts)


def _groups(texts: list[str | None], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` characters, or of one longer text."""
    start = size = 0
    for row, text in enumerate(texts):
        size += len(text or "")
        if size > limit and row > start:
            yield start, row
            start, size = row, len(text or "")
    if start < len(texts):
        yield start, len(texts)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_tokens, `ids` (decimal, joined by spaces) and `decoded`.

    Equal to the tokenizer of the file `path` without added special tokens, truncation or padding; special tokens that
    stand in a text are encoded as such. `decoded` joins the tokens as they are in the vocabulary by spaces. Null and
    empty texts have no tokens. Texts are encoded whole, repeated rows one by one; an empty table gives no rows; other
    columns are ignored. `path` must be readable under the same name on every executor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in _groups(texts):
                ids, plain, counts = zip(*encode_texts(path, texts[start:end]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, end - start), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids string, decoded string")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """`tokens` (ids: decimal, joined by spaces) with the tokens' text, joined by spaces, as `decoded`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = vocabulary(path).tokens
        for batch in batches:
            texts = [" ".join(names[int(x)] for x in (ids or "").split()) for ids in batch.column("ids").to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return tokens.mapInArrow(work, tokens.withColumn("decoded", F.lit("")).schema)
