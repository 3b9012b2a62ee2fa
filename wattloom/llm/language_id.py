"""Language of a text by its nearest centroid.

A text is a vector of hashed n-grams of one to three bytes, weighted by TF-IDF and normalised. Document frequencies are
counted over all learning rows. Of each language a bounded sample of different texts is parted into a few clusters by
spherical k-means; their normalised means are the language's centroids. A text takes the language of the centroid with the
largest cosine; it is marked as rejected where it is farther from that centroid than nearly all of the centroid's examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.packing import packed, packed_schema, unpacked
from wattloom.llm.text_arrays import LOWER, Chunk, chunks
from wattloom.operators.ranking import first_k

UNKNOWN = "und"
#: Places of a vector, by hash.
DIMS = 4096
#: Different texts per language that the centroids are fitted on, at most.
EXAMPLES = 1000
CENTROIDS = 4
ROUNDS = 12
LEAST_MEMBERS = 5
#: Share of a centroid's examples that are farther away than it accepts.
OUTSIDE = 0.01
#: Rows whose vectors are held at once.
ROWS = 256
SLICES = 64

_FOLDED = LOWER.copy()
_FOLDED[:0x61] = 0x20
_FOLDED[0x41:0x5B] = LOWER[0x41:0x5B]
_FOLDED[0x7B:0x80] = 0x20
_FACTORS = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def counts(chunk: Chunk, dims: int = DIMS) -> np.ndarray:
    """Occurrences of hashed n-grams, a row per text. A-Z and Latin capitals are lower-cased, runs of other ASCII are one blank."""
    folded = _FOLDED[chunk.data]
    capital = np.zeros(len(folded), bool)
    capital[1:] = (chunk.data[:-1] == 0xC3) & (chunk.data[1:] >= 0x80) & (chunk.data[1:] <= 0x9E) & (chunk.data[1:] != 0x97)
    folded[capital] += 0x20
    edge = np.zeros(len(folded) + 1, bool)
    edge[chunk.bounds] = True
    blank = folded == 0x20
    kept = ~blank
    kept[1:] |= blank[1:] & ~blank[:-1]
    kept |= edge[:-1]
    place = np.flatnonzero(kept)
    folded = folded[place].astype(np.uint32)
    row = np.searchsorted(chunk.bounds, place, "right") - 1
    total = np.zeros(len(chunk) * dims, np.int64)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    gram = folded
    for size, factor in enumerate(_FACTORS, 1):
        if size > 1:
            gram = (gram[:-1] << np.uint32(8)) | folded[size - 1 :]
        whole = row[: len(gram)] == row[size - 1 :]
        bucket = ((gram + np.uint32(size << 24)) * factor) >> shift
        total += np.bincount((row[: len(gram)] * dims + bucket)[whole], minlength=len(total))
    return total.reshape(len(chunk), dims)


def _blocks(batch: pa.RecordBatch) -> Iterator[Chunk]:
    """Chunks of at most ROWS rows."""
    for first in range(0, batch.num_rows, ROWS):
        for chunk in chunks(batch.slice(first, ROWS)):
            yield Chunk(first + chunk.first, chunk.data, chunk.bounds)


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors, the term frequency damped by its logarithm."""
    out = np.log1p(found, dtype=np.float32) * idf.astype(np.float32)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def document_frequencies(docs: DataFrame, dims: int = DIMS) -> tuple[int, np.ndarray]:
    """(texts, texts with each n-gram) over all of `docs`; sums per task, then per slice of the vector."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(dims, np.int64), 0
        for batch in batches:
            for chunk in _blocks(batch):
                total += (counts(chunk, dims) > 0).sum(axis=0)
                texts += len(chunk)
        if texts:
            slices = np.append(np.repeat(np.arange(SLICES), dims // SLICES), -1)
            yield packed(slices, [np.append(total, texts)], ["n"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        width = 1 if key[0].as_py() < 0 else dims // SLICES
        total = unpacked(table, "n", np.int64).reshape(-1, width).sum(axis=0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, packed_schema(["n"])).groupBy("part").applyInArrow(add, "part int, n binary").collect()
    found = {row["part"]: np.frombuffer(bytes(row["n"]), np.int64) for row in rows}
    if not found:
        return 0, np.zeros(dims, np.int64)
    return int(found[-1][0]), np.concatenate([found[i] for i in range(SLICES)])


def clustered(vectors: np.ndarray, centroids: int, rounds: int = ROUNDS, least: int = LEAST_MEMBERS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, each row's centroid) by spherical k-means.

    It begins with rows from the most to the least typical. Clusters of fewer than `least` rows join the others.
    """
    typical = np.argsort(-(vectors @ vectors.mean(axis=0)), kind="stable")
    steps = (2 * np.arange(centroids) + 1) * len(vectors) // (2 * centroids)
    means = vectors[typical[np.unique(steps)]]
    own = np.zeros(len(vectors), np.int64)
    for step in range(rounds):
        new = np.argmax(vectors @ means.T, axis=1)
        size = np.bincount(new, minlength=len(means))
        few = size < min(least, size.max())
        if few.any():
            means = means[~few]
            continue
        if step and (new == own).all():
            break
        own = new
        sums = np.zeros_like(means)
        np.add.at(sums, own, vectors)
        means = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    return means, np.argmax(vectors @ means.T, axis=1)


@dataclass
class Model:
    """Centroids of all languages: `langs[i]` is the language of `means[i]`, which accepts a cosine of `least[i]`."""

    langs: list[str]
    means: np.ndarray
    least: np.ndarray
    idf: np.ndarray


def examples(docs: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """(lang, place, text): at most `limit` different texts of each language, those with the least hash."""
    placed = docs.select("lang", F.xxhash64("text").alias("place"), "text")
    first = first_k(placed.select("lang", "place").distinct(), ["lang"], ["place"], limit, "place")
    # One row per language.
    last = first.groupBy("lang").agg(F.max("place").alias("_last"))
    return placed.join(F.broadcast(last), "lang").filter(F.col("place") <= F.col("_last")).groupBy("lang", "place").agg(F.min("text").alias("text"))


def fitted(docs: DataFrame, dims: int = DIMS, limit: int = EXAMPLES, centroids: int = CENTROIDS) -> Model:
    """The model from (text, lang); rows without a text or language teach nothing.

    Frequencies cover all rows, centroids at most `limit` texts per language. The model has `centroids` x `dims` x 4 bytes
    per language (64 KB); that is what the driver gets and tasks are sent.
    """
    known = docs.select("text", "lang").filter("text is not null and lang is not null")
    texts, frequency = document_frequencies(known, dims)
    idf = np.log((1 + texts) / (1 + frequency)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _blocks(batch):
                rows = weighted(counts(chunk, dims), idf)
                part = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("place"), pa.array([x.tobytes() for x in rows], pa.binary())], names=["lang", "place", "vector"]
                )

    def cluster(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.sort_by("place").column("vector").to_pylist()
        matrix = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), dims)
        means, own = clustered(matrix, centroids)
        cosine = (matrix * means[own]).sum(axis=1)
        least = [float(np.quantile(cosine[own == i], OUTSIDE)) if (own == i).any() else 1.0 for i in range(len(means))]
        langs = pa.array([key[0].as_py()] * len(means), pa.string())
        return pa.table({"lang": langs, "number": pa.array(range(len(means)), pa.int32()), "mean": pa.array([x.tobytes() for x in means], pa.binary()), "least": least})

    made = (
        examples(known, limit)
        .mapInArrow(vectors, "lang string, place long, vector binary")
        .groupBy("lang")
        .applyInArrow(cluster, "lang string, number int, mean binary, least double")
        .orderBy("lang", "number")
        .collect()
    )
    means = np.array([np.frombuffer(bytes(row["mean"]), np.float32) for row in made]).reshape(-1, dims)
    return Model([row["lang"] for row in made], means, np.array([row["least"] for row in made]), idf)


def _letterless(chunk: Chunk) -> np.ndarray:
    """Rows without any letter, of any script."""
    letters = np.concatenate(([0], np.cumsum((LOWER[chunk.data] >= 0x61) & (LOWER[chunk.data] <= 0x7A))))
    none = letters[chunk.bounds[1:]] == letters[chunk.bounds[:-1]]
    for row in np.flatnonzero(none).tolist():
        text = chunk.data[chunk.bounds[row] : chunk.bounds[row + 1]].tobytes().decode("utf-8", "replace")
        none[row] = not any(x.isalpha() for x in text)
    return none


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, lang (of the nearest centroid), score (its cosine, 0 to 1), rejected.

    Texts that are null or hold no letter, and all texts if nothing was learnt, are `und` with score 0 and rejected. On equal
    cosines the first language in order is taken. Repeated rows are scored alike, texts are read whole, an empty table gives
    no rows, other columns are ignored.
    """
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        names = np.array([*known.langs, UNKNOWN], object)
        for batch in batches:
            for chunk in _blocks(batch):
                none = _letterless(chunk)
                best, cosine = np.full(len(chunk), len(known.langs)), np.zeros(len(chunk))
                least = np.full(len(chunk), np.inf)
                if len(known.langs):
                    near = weighted(counts(chunk, known.means.shape[1]), known.idf) @ known.means.T
                    best = np.where(none, len(known.langs), near.argmax(axis=1))
                    cosine = np.where(none, 0.0, np.clip(near.max(axis=1).astype(np.float64), 0, 1))
                    least = np.append(known.least, np.inf)[best]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(chunk.first, len(chunk)), pa.array(names[best].tolist(), pa.string()),
                        pa.array(cosine), pa.array(cosine < least),
                    ],
                    names=["doc_id", "lang", "score", "rejected"],
                )

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang string, score double, rejected boolean")
