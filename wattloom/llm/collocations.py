"""Phrases whose words stand together far more often than their parts alone, by SON partitioning.

A shard is what a task holds at once. It is mined completely at a local support that is lowered in proportion to its share of
the language's words: a phrase that reaches the support in all texts reaches the lowered one in some shard. Locally frequent
phrases are united, and then all shards count all of them exactly. This is done length by length, so shards extend only
phrases that are frequent in all texts; which these are is known to tasks by a bitmap of fixed size, whose false marks cost
work and never change a count. Where every shard's local support is 1, mining has already counted everything exactly.

Words travel as 64-bit hashes. Two words of one hash are noticed when words are counted, and all is hashed anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.llm.packing import packed, packed_schema, unpacked
from wattloom.llm.text_arrays import LOWER, Chunk, RangeHash, chunks, mix, rows_of, words
from wattloom.session import cut_lineage

SUPPORT = 30
LONGEST = 4
#: A phrase goes if a longer one around it has this share of its occurrences, in hundredths.
WITHIN = 80
SCALE = 2_000_000
TOP = 2000
UNKNOWN = "und"
#: Words of one shard.
SHARD_WORDS = 500_000
#: Words whose phrases one part sums up.
PART_WORDS = 4_000_000
#: Different words a task holds before it sends their counts on.
HELD_WORDS = 400_000
#: Bits of the bitmap of frequent phrases: 8 MB.
BITS = 26
#: Longer words are hashed one by one.
LONG_WORD = 255

_BREAK = np.zeros(256, bool)
_BREAK[[ord(x) for x in ".,;:!?\n\v\f\r"]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


@dataclass
class Tokens:
    """Words in order: two hashes, the number of the text's language, whether the next word follows in the same piece."""

    word: np.ndarray
    check: np.ndarray
    lang: np.ndarray
    follows: np.ndarray


def _salts(langs: Sequence[str], seed: int) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(f"{seed}:{x}".encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def tokens(chunk: Chunk, lang: np.ndarray, salts: np.ndarray, check: bool = False) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """The words of a chunk with the byte ranges they have; `lang` has the number of each row's language."""
    found = words(chunk, _WORD)
    low = LOWER[chunk.data]
    row = rows_of(found.rows)
    salt = salts[lang[row]]
    first = RangeHash(chunk.data).of(found.starts, found.ends)
    second = RangeHash(low, exact=True).of(found.starts, found.ends) if check else first
    for place in np.flatnonzero(found.ends - found.starts > LONG_WORD).tolist():
        digest = blake2b(low[found.starts[place] : found.ends[place]].tobytes(), digest_size=16).digest()
        first[place], second[place] = np.frombuffer(digest, np.uint64) if check else np.frombuffer(digest, np.uint64)[[0, 0]]
    breaks = np.cumsum(_BREAK[low], dtype=np.int32)
    follows = np.zeros(len(row), bool)
    follows[:-1] = (row[1:] == row[:-1]) & (breaks[found.starts[1:]] == breaks[found.ends[:-1] - 1])
    out = Tokens(mix(first ^ salt), mix(second ^ ~salt) if check else first, lang[row].astype(np.int32), follows)
    return out, found.starts, found.ends


def _languages(batch: pa.RecordBatch) -> list[str]:
    return [UNKNOWN if x is None else x for x in batch.column("lang").to_pylist()]


def _united(held: list[pa.Table]) -> pa.Table:
    """Counts of several tables, summed per word; rows that agree in one hash alone stay apart."""
    table = pa.concat_tables(held, promote_options="default")
    word, check = (table.column(x).to_numpy().view(np.uint64) for x in ("word", "check"))
    order = np.lexsort((check, word))
    word, check = word[order], check[order]
    first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (check[1:] != check[:-1]))))
    n = np.add.reduceat(table.column("n").to_numpy()[order], first)
    return table.take(pa.array(order[first])).set_column(2, "n", pa.array(n)).combine_chunks()


def counted_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(word long, check long, n, lang, text binary): every word of every language; two that share `word` differ in the rest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            langs = _languages(batch)
            names = sorted(set(langs))
            numbers = {x: i for i, x in enumerate(names)}
            own = np.array([numbers[x] for x in langs], np.int64)
            salts = _salts(names, seed)
            for chunk in chunks(batch):
                got, starts, ends = tokens(chunk, own[chunk.first : chunk.first + len(chunk)], salts, check=True)
                order = np.argsort(got.word, kind="stable")
                word, check = got.word[order], got.check[order]
                if not len(order):
                    continue
                first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (check[1:] != check[:-1]))))
                at = order[first]
                size = ends[at] - starts[at]
                bounds = np.concatenate(([0], np.cumsum(size)))
                text = LOWER[chunk.data][np.repeat(starts[at] - bounds[:-1], size) + np.arange(bounds[-1])]
                column = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(text)])
                held.append(
                    pa.table(
                        {
                            "word": word[first].view(np.int64),
                            "check": check[first].view(np.int64),
                            "n": np.diff(np.append(first, len(order))),
                            "lang": pa.array(names).take(pa.array(got.lang[at])),
                            "text": column.cast(pa.binary()),
                        }
                    )
                )
                if sum(len(x) for x in held) > 2 * HELD_WORDS:
                    held = [_united(held)]
                    if len(held[0]) > HELD_WORDS:
                        yield from held.pop().to_batches(50_000)
        if held:
            yield from _united(held).to_batches(50_000)

    rows = docs.select("text", "lang").mapInArrow(count, "word long, check long, n long, lang string, text binary")
    # Tasks have summed already; dealt by the hash alone, so that words which share it meet without another shuffle.
    return rows.repartition("word").groupBy("word", "check", "lang", "text").agg(F.sum("n").alias("n"))


def _joined_hash(columns: Sequence[np.ndarray]) -> np.ndarray:
    out = columns[0]
    for column in columns[1:]:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def bitmap(phrases: DataFrame, columns: Sequence[str], bits: int = BITS) -> bytes:
    """A bit for every phrase, by hash: 2^bits / 8 bytes whatever the number of phrases. Slices are made by tasks."""
    slices = 64
    span = (1 << bits) // slices

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _joined_hash([batch.column(x).to_numpy().view(np.uint64) for x in columns]) >> np.uint64(64 - bits)
            yield packed((place // np.uint64(span)).astype(np.int32), [(place % np.uint64(span)).astype(np.uint32)], ["place"])

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        marked = np.zeros(span, bool)
        marked[unpacked(table, "place", np.uint32)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(marked).tobytes()])})

    made = phrases.select(*columns).mapInArrow(mark, packed_schema(["place"])).groupBy("part").applyInArrow(build, "part int, bits binary")
    found = {row["part"]: bytes(row["bits"]) for row in made.collect()}
    return b"".join(found.get(i, bytes(span // 8)) for i in range(slices))


def _marked(bits: np.ndarray, columns: Sequence[np.ndarray]) -> np.ndarray:
    """Whether a bitmap has each phrase."""
    place = _joined_hash(columns) >> np.uint64(64 - int(len(bits) * 8).bit_length() + 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1


def _places(shard: Tokens, length: int, known: np.ndarray, asked: np.ndarray | None) -> np.ndarray:
    """Where phrases of `length` words stand whose parts of one word less are all known, and which are asked for."""
    last = len(shard.word) - length + 1
    if last < 1:
        return np.zeros(0, np.int64)
    columns = [shard.word[j : len(shard.word) - (length - 2) + j] for j in range(length - 1)]
    part = _marked(known, columns)
    for j in range(length - 2):
        part &= shard.follows[j : j + len(part)]
    whole = part[:last] & part[1 : last + 1] & shard.follows[length - 2 : length - 2 + last]
    places = np.flatnonzero(whole)
    if asked is not None:
        places = places[_marked(asked, [shard.word[places + j] for j in range(length)])]
    return places


def _phrases(shard: Tokens, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, occurrences) of the different phrases at `places`, compared word by word."""
    need = np.unique((places[:, None] + np.arange(length)).ravel()) if len(places) else places
    number = np.zeros(len(shard.word), np.int64)
    kinds, number[need] = np.unique(shard.word[need], return_inverse=True)
    key = number[places]
    for j in range(1, length):
        if j > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(kinds) + number[places + j]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return places[first], counts


def _names(length: int) -> list[str]:
    return [f"w{j}" for j in range(1, length + 1)]


def _mined(docs: DataFrame, totals: dict[str, int], seed: int, length: int, known, asked, support: int, parts: int) -> DataFrame:
    """(part, w1.., n): phrases of one length that can reach the support in all texts, with the counts that shards sent.

    Without `asked` a shard sends what reaches its local support. A shard that sends nothing of a phrase has at most one
    occurrence less than its local support; by these bounds of all shards a part leaves out what cannot reach the support.
    Part -1 holds the largest sum of such bounds: with 0 all counts are exact. With `asked` all that is asked for is counted.
    """
    langs = sorted(totals)
    numbers = {x: i for i, x in enumerate(langs)}
    names = _names(length)

    def sent(held: list[Tokens]) -> Iterator[pa.RecordBatch]:
        word, lang, follows = (np.concatenate([getattr(x, name) for x in held]) for name in ("word", "lang", "follows"))
        shard = Tokens(word, word, lang, follows)
        held.clear()
        bits = np.frombuffer(known.value, np.uint8)
        places = _places(shard, length, bits, None if asked is None else np.frombuffer(asked.value, np.uint8))
        first, counts = _phrases(shard, places, length)
        unsent = 0
        if asked is None:
            share = np.bincount(shard.lang, minlength=len(langs))
            least = np.array([max(1, -(-support * int(x) // totals[name])) for x, name in zip(share, langs, strict=True)], np.int64)
            kept = counts >= least[shard.lang[first]]
            first, counts = first[kept], counts[kept]
            unsent = int(least.max()) - 1
        if unsent:
            # What this shard may hold of any phrase that it does not send is told to every part.
            every = np.arange(-1, parts)
            none = np.zeros(len(every), np.uint64)
            yield packed(every, [*(none for _ in names), np.full(len(every), unsent, np.int32), np.ones(len(every), np.uint8)], [*names, "n", "bound"])
        columns = [shard.word[first + j] for j in range(length)]
        part = (_joined_hash(columns) % np.uint64(parts)).astype(np.int32)
        if len(first):
            yield packed(part, [*columns, (counts - unsent).astype(np.int32), np.zeros(len(first), np.uint8)], [*names, "n", "bound"])

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _salts(langs, seed)
        held: list[Tokens] = []
        for batch in batches:
            own = np.array([numbers[x] for x in _languages(batch)], np.int64)
            for chunk in chunks(batch):
                held.append(tokens(chunk, own[chunk.first : chunk.first + len(chunk)], salts)[0])
                if sum(len(x.word) for x in held) > SHARD_WORDS:
                    yield from sent(held)
        if held:
            yield from sent(held)

    def summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        columns = [unpacked(table, name, np.uint64) for name in names]
        counts, bound = unpacked(table, "n", np.int32).astype(np.int64), unpacked(table, "bound", np.uint8).astype(bool)
        unsent = int(counts[bound].sum())
        if key[0].as_py() < 0:
            columns, counts, least = [x[:1] for x in columns], np.array([unsent]), 0
        else:
            columns, counts, least = [x[~bound] for x in columns], counts[~bound], support - unsent
        order = np.lexsort(columns[::-1])
        columns = [x[order] for x in columns]
        fresh = np.zeros(len(order), bool)
        fresh[:1] = True
        for x in columns:
            fresh[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(fresh)
        n = np.add.reduceat(counts[order], starts) if len(starts) else counts
        starts, n = starts[n >= least], n[n >= least]
        return pa.table({"part": pa.array([key[0].as_py()] * len(starts), pa.int32()), **{x: y[starts].view(np.int64) for x, y in zip(names, columns, strict=True)}, "n": n})

    schema = f"part int, {', '.join(f'{x} long' for x in names)}, n long"
    rows = docs.select("text", "lang").mapInArrow(mine, packed_schema([*names, "n", "bound"]))
    return rows.groupBy("part").applyInArrow(summed, schema)


def frequent(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (word, text, lang, n) of all words, and (key array of words, length, lang, a) of all words and phrases
    of up to `longest` words that occur `support` times or more in their language. All counts are exact."""
    spark = docs.sparkSession
    for seed in range(8):
        counted = cut_lineage(counted_words(docs, seed))
        if counted.groupBy("word").agg(F.count(F.lit(1)).alias("words")).filter("words > 1").isEmpty():
            break
    else:
        raise RuntimeError("no hash tells all words apart")
    # One row per language.
    totals = {row["lang"]: row["n"] for row in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(totals.values()) // PART_WORDS))
    often = counted.filter(F.col("n") >= support)
    out = often.select(F.array("word").alias("key"), F.lit(1).alias("length"), "lang", F.col("n").alias("a"))
    level = often.select(F.col("word").alias("w1"))
    for length in range(2, longest + 1):
        known = spark.sparkContext.broadcast(bitmap(level, _names(length - 1), bits))
        mined = cut_lineage(_mined(docs, totals, seed, length, known, None, support, parts))
        local = mined.filter("part >= 0")
        if mined.filter("part < 0 and n > 0").isEmpty():
            counts = local
        else:
            asked = spark.sparkContext.broadcast(bitmap(local, _names(length), bits))
            counts = _mined(docs, totals, seed, length, known, asked, support, parts)
        level = cut_lineage(counts.filter(F.col("n") >= support))
        word = counted.select(F.col("word").alias("w1"), "lang")
        out = out.unionByName(
            level.join(word, "w1").select(F.array(*_names(length)).alias("key"), F.lit(length).alias("length"), "lang", F.col("n").alias("a"))
        )
    return counted, out


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """Per language of `docs` (text, lang) its best `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Words and pieces are those of `tokens`, A-Z lower-cased. A phrase of two to `longest` words that occurs a >= `support` times
    is cut after each of its words but the last; l and r count its halves, and floor(SCALE * a / (l + r)) is the cut's
    score. The lowest cut counts, the first on a tie. Phrases inside a longer one with WITHIN hundredths of their occurrences
    are left out. Ranks are by score, a (descending) and phrase (by bytes).

    Null and empty texts have no words, a null language is `und`. Repeated rows count again, long texts are whole, an empty
    table gives no rows, other columns are ignored.
    """
    counted, phrases = frequent(docs, support, longest, bits)
    phrases = cut_lineage(phrases)
    long = phrases.filter("length > 1")
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("length") - 1),
        lambda k: F.struct(k.alias("k"), F.slice("key", F.lit(1), k).alias("left"), F.slice("key", k + 1, F.col("length") - k).alias("right")),
    )
    known = phrases.select("key", F.col("a").alias("n"))
    halves = (
        long.select("key", "length", "lang", "a", F.explode(cuts).alias("cut"))
        .join(known.select(F.col("key").alias("_left"), F.col("n").alias("l")), F.col("cut.left") == F.col("_left"))
        .join(known.select(F.col("key").alias("_right"), F.col("n").alias("r")), F.col("cut.right") == F.col("_right"))
    )
    score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * {SCALE} div (l + r)")
    scored = halves.groupBy("key", "length", "lang", "a").agg(
        F.min(F.struct(score.alias("score"), F.col("cut.k").alias("k"), "l", "r")).alias("best")
    )
    inner = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("length") - 1),
                lambda n: F.transform(F.sequence(F.lit(1), F.col("length") - n + 1), lambda at: F.slice("key", at, n)),
            )
        )
    )
    around = long.filter("length > 2").select(inner.alias("key"), F.col("a").alias("_around")).groupBy("key").agg(F.max("_around").alias("_around"))
    kept = (
        scored.join(around, "key", "left")
        .filter(F.coalesce(100 * F.col("_around").cast("decimal(20,0)") < WITHIN * F.col("a").cast("decimal(20,0)"), F.lit(True)))
        .select("key", "lang", "a", "best.score", "best.l", "best.r")
    )
    # The first by score and a, with all ties, in parts of a language first; texts are joined only then.
    order = [F.desc("score"), F.desc("a")]
    for groups in (["lang", "_salt"], ["lang"]):
        kept = kept.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(64)))
        kept = kept.withColumn("_place", F.rank().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("_place") <= top)
    named = (
        kept.select("key", "lang", "a", "score", "l", "r", F.posexplode("key").alias("at", "word"))
        .join(counted.select("word", "text"), "word")
        .groupBy("key", "lang", "a", "score", "l", "r")
        .agg(F.array_sort(F.collect_list(F.struct("at", F.col("text").cast("string").alias("text")))).alias("words"))
        .withColumn("phrase", F.array_join(F.transform("words", lambda x: x["text"]), " "))
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    # One row per language.
    return (
        ranked.filter(F.col("rank") <= top)
        .join(F.broadcast(totals), "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
