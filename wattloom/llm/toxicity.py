"""Toxicity by nearest labelled examples: exact TF-IDF cosine over an inverted index.

Terms are words and the beginnings of words, and each again for texts that have it twice or four times. All terms of a
bounded sample of labelled texts count; their document frequencies are taken over all documents. A term's axis is stretched
by how much more often toxic examples have it than clean ones, never shrunk: without that, what a text is about decides its
neighbours. The sample's vectors form the index: terms that many examples have lie in a matrix, the others have postings, and
texts are compared with all examples, many texts at once. (Bounds per block of examples left out 1 % of the blocks and cost
more than the cosines.) Votes weigh similarity and how many labelled texts an example stands for; a monotone fit on the
examples themselves, each left out of its own vote, turns votes into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.text_arrays import ALNUM, RangeHash, chunks, mix, rows_of, words

#: Labelled texts per class that the classifier is fitted on, at most.
EXAMPLES = 3000
NEIGHBOURS = 25
#: A term that one example in so many has, or more, is kept with a weight for every example.
USUAL = 16
#: Texts that are searched together.
TOGETHER = 32
#: Examples whose votes one task takes.
VOTERS = 512
PREFIXES = (5, 7)
LEVELS = (1, 2, 4)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _terms(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all texts of a chunk with repetitions, and the row of each."""
    found = words(chunk, ALNUM)
    hashes = RangeHash(chunk.data)
    row = rows_of(found.rows)
    every, rows = [hashes.of(found.starts, found.ends)], [row]
    for length in PREFIXES:
        long = np.flatnonzero(found.ends - found.starts > length)
        every.append(mix(hashes.of(found.starts[long], found.starts[long] + length) ^ np.uint64(length)))
        rows.append(row[long])
    return np.concatenate(every), np.concatenate(rows)


def _counted(terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) with counts; levels beyond the first are terms of their own."""
    order = np.lexsort((terms, rows))
    terms, rows = terms[order], rows[order]
    fresh = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (rows[1:] != rows[:-1])))) if len(terms) else np.zeros(0, int)
    counts = np.diff(np.append(fresh, len(terms)))
    terms, rows = terms[fresh], rows[fresh]
    out = [(rows[counts >= n], _at_level(terms[counts >= n], n), counts[counts >= n]) for n in LEVELS]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _at_level(terms: np.ndarray, level: int) -> np.ndarray:
    """The term that stands for `level` occurrences of a term or more."""
    return terms if level == 1 else mix(terms + np.uint64(level))


def _sampled(labels: DataFrame, docs: DataFrame, examples: int) -> DataFrame:
    """At most `examples` labelled, not held out texts per class: doc_id, toxic, text, weight."""
    learn = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(~held_out(F.col("doc_id")))
    )
    totals = learn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    # The first by a hash of the id: a sample that does not depend on the layout.
    chosen = None
    for value in (0, 1):
        part = learn.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    weighed = chosen.join(F.broadcast(totals), "toxic").withColumn("weight", F.col("n") / F.least("n", F.lit(examples)))
    # At most 2 * examples rows.
    found = docs.select("doc_id", "text").join(F.broadcast(weighed.select("doc_id", "toxic", "weight")), "doc_id")
    # Rows that repeat an id: the text that comes first.
    return found.groupBy("doc_id", "toxic", "weight").agg(F.min("text").alias("text"))


class Vocabulary:
    """Sorted term hashes, found by their first bits, and where the terms of further levels are."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.size = len(hashes)
        bits = self.size.bit_length() + 1
        self.shift = np.uint64(64 - bits)
        own = np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << bits)
        #: The first place of each beginning; a last hash, which no place has, ends every search.
        self.begins = (np.cumsum(own) - own).astype(np.int32)
        self.hashes = np.append(hashes, np.uint64(2**64 - 1))
        #: Of the term in each place, the place of its second and of its further levels, -1 for none.
        self.levels = [self.places(_at_level(hashes, n)) for n in LEVELS[1:]]

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term, -1 for none."""
        at = self.begins[(terms >> self.shift).astype(np.int64)]
        late = np.flatnonzero(self.hashes[at] < terms)
        while len(late):
            at[late] += 1
            late = late[self.hashes[at[late]] < terms[late]]
        at[(self.hashes[at] != terms) | (at == self.size)] = -1
        return at


def _found(chunk, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the vocabulary, count) of the terms that a text has, levels one after the other."""
    terms, rows = _terms(chunk)
    places = known.places(terms)
    # A term's first level is in the vocabulary if any of its levels is.
    hit = places >= 0
    bits = known.size.bit_length()
    keys = np.sort(rows[hit] << bits | places[hit])
    fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(fresh, len(keys)))
    rows, places = keys[fresh] >> bits, keys[fresh] & ((1 << bits) - 1)
    out = [(rows, places, counts)]
    for n, further in zip(LEVELS[1:], known.levels, strict=True):
        often = np.flatnonzero(counts >= n)
        at = further[places[often]]
        often, at = often[at >= 0], at[at >= 0]
        out.append((rows[often], at.astype(np.int64), counts[often]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _vectors(chunk, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the vocabulary, count) of the terms that a text has, by row, then place."""
    rows, places, counts = _found(chunk, known)
    order = np.argsort(rows << known.size.bit_length() | places)
    return rows[order], places[order], counts[order]


def _examples(sample: DataFrame) -> list:
    """The sampled texts as rows of doc_id, toxic, weight, terms (hashes) and counts, ascending."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                rows, terms, counts = _counted(*_terms(chunk))
                order = np.argsort(rows, kind="stable")
                terms, counts = terms[order], counts[order].astype(np.int32)
                bounds = np.searchsorted(rows[order], np.arange(len(chunk) + 1))
                own = pa.Table.from_batches([batch.slice(chunk.first, len(chunk))]).drop_columns(["text"])
                for name, values in (("terms", terms), ("counts", counts)):
                    own = own.append_column(name, pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))
                yield from own.to_batches()

    schema = "doc_id long, toxic int, weight double, terms binary, counts binary"
    return sorted(sample.select("doc_id", "toxic", "weight", "text").mapInArrow(work, schema).collect(), key=lambda x: x.doc_id)


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term of the vocabulary occurs, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(shared.value)
        # The last place counts documents.
        counts = np.zeros(known.size + 1, np.int64)
        for batch in batches:
            for chunk in chunks(batch):
                counts[:-1] += np.bincount(_found(chunk, known)[1], minlength=known.size)
                counts[-1] += len(chunk)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["place", "n"])

    sums = docs.select("text").mapInArrow(work, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    counts = np.zeros(len(vocabulary) + 1)
    counts[sums.column("place").to_numpy()] = sums.column("n").to_numpy()
    return counts[:-1], int(counts[-1])


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some ranges, one range after the other."""
    ends = np.cumsum(sizes)
    kind = np.int32 if len(ends) and max(ends[-1], begins.max()) < 1 << 30 else np.int64
    out = np.arange(sizes.sum(), dtype=kind)
    out += np.repeat((begins - ends + sizes).astype(kind), sizes)
    return out


@dataclass
class Postings:
    """Weights of the examples by term.

    The postings of usual terms have no gaps: their weights are rows of `dense`, term t's is row `usual[t]` (-1: none). Those
    of the others lie by term, then example; term t has the postings `begins[t]` to `begins[t + 1]`.
    """

    usual: np.ndarray
    dense: np.ndarray
    begins: np.ndarray
    examples: np.ndarray
    weights: np.ndarray


@dataclass
class Index:
    """Example vectors as counts by term, then example, and the fitted votes.

    `sizes` tells how many postings a term has, `inside` and `times` the example and the count of each. Weights are worked
    out where texts are searched, and do not travel.
    """

    vocabulary: np.ndarray
    scale: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    sizes: np.ndarray
    inside: np.ndarray
    times: np.ndarray
    nothing: float
    #: Votes in ascending order and the probability of each.
    votes: np.ndarray
    chance: np.ndarray

    def __getstate__(self) -> dict:
        return {x.name: getattr(self, x.name) for x in fields(self)}

    @cached_property
    def postings(self) -> Postings:
        terms = np.repeat(np.arange(len(self.vocabulary), dtype=np.int32), self.sizes)
        weights = (1 + np.log(self.times, dtype=float)) * self.scale[terms]
        weights /= np.sqrt(np.bincount(self.inside, weights**2, len(self.ids)))[self.inside]
        common = self.sizes.astype(np.int64) * USUAL >= max(len(self.ids), 1)
        usual = np.where(common, np.cumsum(common) - 1, -1)
        dense = np.zeros((int(common.sum()), len(self.ids)))
        gapless = common[terms]
        dense[usual[terms[gapless]], self.inside[gapless]] = weights[gapless]
        begins = np.concatenate(([0], np.cumsum(np.where(common, 0, self.sizes), dtype=np.int64)))
        return Postings(usual, dense, begins, self.inside[~gapless], weights[~gapless])

    def vectors(self, examples: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The unit vectors (places, values) of some examples."""
        order = np.argsort(self.inside, kind="stable")
        terms = np.repeat(np.arange(len(self.vocabulary), dtype=np.int32), self.sizes)[order]
        bounds = np.searchsorted(self.inside[order], np.arange(len(self.ids) + 1))
        return [
            (terms[a:b], _unit(terms[a:b], self.times[order[a:b]], self.scale)) for a, b in zip(bounds[examples], bounds[examples + 1], strict=True)
        ]

    @property
    def matrix(self) -> np.ndarray:
        """All vectors, one row per example; for tests."""
        out = np.zeros((len(self.ids), len(self.vocabulary)))
        book = self.postings
        out[book.examples, np.repeat(np.arange(len(self.vocabulary)), np.diff(book.begins))] = book.weights
        out[:, book.usual >= 0] = book.dense.T
        return out

    def nearest(self, places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most similar examples of one unit vector and their cosines."""
        return next(self.neighbours([(places, values)]))

    def neighbours(self, vectors: list[tuple[np.ndarray, np.ndarray]], examples: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The k most similar examples of each unit vector (places, values) and their cosines, ties by place in the index.

        With `examples`, the vectors are those of the examples in these places, and none is its own neighbour.
        """
        for start in range(0, len(vectors), TOGETHER):
            cosines = self._cosines(vectors[start : start + TOGETHER])
            if examples is not None:
                cosines[np.arange(len(cosines)), examples[start : start + TOGETHER]] = 0
            for own in cosines:
                found = np.flatnonzero(own > 0)
                if len(found) > NEIGHBOURS:
                    # Few can be among the nearest; only they are put in order.
                    found = np.flatnonzero(own >= max(np.partition(own, -NEIGHBOURS)[-NEIGHBOURS] - 1e-8, 1e-300))
                best = found[np.lexsort((found, -np.round(own[found], 9)))[:NEIGHBOURS]]
                yield best, own[best]

    def _cosines(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Cosines of some vectors with all examples."""
        count, n, book = len(vectors), len(self.ids), self.postings
        query = np.repeat(np.arange(count), [len(x) for x, _ in vectors])
        places, values = np.concatenate([x for x, _ in vectors]), np.concatenate([x for _, x in vectors])
        at = book.usual[places]
        table = np.zeros((count, len(book.dense)))
        table[query[at >= 0], at[at >= 0]] = values[at >= 0]
        query, places, values = query[at < 0], places[at < 0], values[at < 0]
        begins = book.begins[places]
        sizes = book.begins[places + 1] - begins
        at = _ranges(begins, sizes)
        spot = np.repeat(query * n, sizes)
        spot += book.examples[at]
        parts = np.repeat(values, sizes)
        parts *= book.weights[at]
        cosines = table @ book.dense
        cosines += np.bincount(spot, parts, count * n).reshape(count, n)
        return cosines

    def vote(self, best: np.ndarray, cosines: np.ndarray) -> float:
        if not len(best):
            return -1.0
        force = self.weight[best] * cosines**2
        return float((force * self.toxic[best]).sum() / force.sum())

    def score(self, vote: float) -> float:
        if vote < 0 or not len(self.votes):
            return self.nothing
        return float(np.interp(vote, self.votes, self.chance))


def _unit(places: np.ndarray, counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts, dtype=float)) * scale[places]
    length = np.sqrt((values**2).sum())
    return values / length if length > 0 else values


def _monotone(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the best non-decreasing probabilities over the votes."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for vote, hit, mass in zip(votes[order], toxic[order], weight[order], strict=True):
        pools.append([hit * mass, mass, vote, vote])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b = pools[-2], pools.pop()
            pools[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    x = [v for p in pools for v in ((p[2], p[3]) if p[3] > p[2] else (p[2],))]
    y = [p[0] / p[1] for p in pools for _ in range(2 if p[3] > p[2] else 1)]
    return np.array(x), np.array(y)


def fitted(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """The index over at most `examples` labelled texts per class; its size is bounded by theirs, whatever the tables hold."""
    rows = _examples(_sampled(labels, docs, examples))
    vocabulary = np.unique(np.concatenate([np.frombuffer(x.terms, np.uint64) for x in rows])) if rows else np.zeros(0, np.uint64)
    return _with_votes(docs.sparkSession, built(rows, vocabulary, *_frequencies(docs, vocabulary)))


def built(rows: list, vocabulary: np.ndarray, frequency: np.ndarray, total: int) -> Index:
    """The index, without votes, of example rows (see _examples), with the documents that have each term and the number of documents."""
    blank = [x for x in rows if not x.terms]
    rows = [x for x in rows if x.terms]
    mass = sum(x.weight for x in blank)
    nothing = (sum(x.weight * x.toxic for x in blank) + 0.01) / (mass + 1)
    places = [np.searchsorted(vocabulary, np.frombuffer(x.terms, np.uint64)).astype(np.int32) for x in rows]
    counts = [np.frombuffer(x.counts, np.int32) for x in rows]
    # Texts of each class that have a term, in the table's proportion.
    with_term = np.zeros((2, len(vocabulary)))
    for row, own in zip(rows, places, strict=True):
        with_term[row.toxic, own] += row.weight
    # Above 0 for every term, so a text that shares one with an example has a neighbour.
    idf = np.log((total + 1) / (frequency + 0.5))
    scale = idf * np.log2(2 + with_term[1] / np.maximum(with_term[0], 1))
    # Examples with the same strongest term lie together.
    strongest = [int(x[_unit(x, y, scale).argmax()]) for x, y in zip(places, counts, strict=True)]
    order = sorted(range(len(rows)), key=lambda i: (strongest[i], rows[i].doc_id))
    rows, places, counts = ([x[i] for i in order] for x in (rows, places, counts))
    terms = np.concatenate(places) if rows else np.zeros(0, np.int64)
    inside = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in places])
    order = np.argsort(terms, kind="stable")
    times = np.concatenate(counts)[order] if rows else np.zeros(0, np.int32)
    return Index(
        vocabulary, scale, np.array([x.doc_id for x in rows], np.int64), np.array([x.toxic for x in rows], float),
        np.array([x.weight for x in rows], float), np.bincount(terms, minlength=len(vocabulary)).astype(np.int32),
        inside[order].astype(np.min_scalar_type(len(rows))), times.astype(np.min_scalar_type(int(times.max(initial=0)))), float(nothing),
        np.zeros(0), np.zeros(0),
    )


def _with_votes(spark: SparkSession, index: Index) -> Index:
    """The index with the votes of its examples, each left out of its own, and their probabilities."""
    count = len(index.ids)
    if not count:
        return index
    shared = spark.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            at = batch.column("id").to_numpy()
            votes = [book.vote(*x) for x in book.neighbours(book.vectors(at), at)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(votes, pa.float64())], names=["id", "vote"])

    found = spark.range(0, count, 1, -(-count // VOTERS)).mapInArrow(work, "id long, vote double").toArrow()
    shared.unpersist()
    own = np.zeros(count)
    own[found.column("id").to_numpy()] = found.column("vote").to_numpy()
    told = own >= 0
    if told.any():
        index.votes, index.chance = _monotone(own[told], index.toxic[told], index.weight[told])
    return index


def scored(docs: DataFrame, index: Index) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, score, and `evidence`, the three nearest examples (doc_id, toxic, cosine).

    A null or empty text, or one that shares no term with any example, has no evidence and the score of such examples. Texts
    are read whole, repeated rows one by one; an empty table gives no rows; other columns are ignored. Equal cosines go by place
    in the index. Of examples that repeat a doc_id the smallest text counts, and toxic if any label says so. Without labelled
    texts all scores are nearly 0; with texts of one class, votes are for that class.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        known = Vocabulary(book.vocabulary)
        for batch in batches:
            for chunk in chunks(batch):
                rows, places, counts = _vectors(chunk, known)
                scores = np.full(len(chunk), book.nothing)
                evidence: list = [[]] * len(chunk)
                some, starts = np.unique(rows, return_index=True)
                ends = np.append(starts[1:], len(rows))
                vectors = [(places[a:b], _unit(places[a:b], counts[a:b], book.scale)) for a, b in zip(starts, ends[: len(starts)], strict=True)]
                for row, (best, cosines) in zip(some, book.neighbours(vectors), strict=True):
                    scores[row] = book.score(book.vote(best, cosines))
                    evidence[row] = [
                        {"doc_id": int(book.ids[i]), "toxic": int(book.toxic[i]), "cosine": float(c)} for i, c in zip(best[:3], cosines[:3], strict=True)
                    ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, len(chunk)), pa.array(scores), pa.array(evidence, kind)],
                    names=["doc_id", "score", "evidence"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        work, "doc_id long, score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>"
    )
