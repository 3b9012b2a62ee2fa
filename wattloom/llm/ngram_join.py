"""N-gram Jaccard join: T-occurrence search over inverted lists of word shingles, by DivideSkip.

Every text is a set of word shingles; two texts link when 100 * |A & B| >= 80 * |A | B|. Steps:

1. Equal sets form one class (128-bit digest), numbered once. A fixed-size sketch counts how frequent shingles are over all texts.
2. Divide: in the global order rare to frequent, a set's longest lists are skipped. A text of n shingles must meet a
   partner T = ceil(0.8 n) times; setting the T - m most frequent lists aside leaves its n - T + m rarest, among which any
   partner occurs at least min(m, m of the partner) times. Only these short lists are built, and shuffled by shingle.
3. Short lists are merged: classes that meet in one are counted per pair, and pairs below the threshold or of
   incompatible lengths go. A list of more than `long_list` classes is not expanded; it ties its classes together.
4. Classes that are tied form cells. A cell's sets are indexed in memory, each set queries the index: the lists that
   are short there are merged by counting, survivors are looked up in the long ones by binary search, and the exact
   overlap decides. A cell larger than `block_shingles` is worked in blocks of sets of like length, one task per
   pair of blocks whose lengths allow a link.
5. Components of the links; a component's id is its smallest document id.

Results are whole: no list, cell or pair is capped. Steps 2 to 4 only leave out pairs that cannot reach T.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.components import components
from wattloom.llm.packing import packed, packed_schema, unpacked
from wattloom.llm.text_arrays import chunks, mix, shingle_sets
from wattloom.session import cut_lineage

#: Counters of the frequency sketch; what is broadcast has one byte per counter.
SKETCH_BITS = 22
SLICES = 64
#: Classes that a task remembers to have sent, at most.
SENT_CLASSES = 1 << 18
#: A list with more classes ties them together instead of listing its pairs.
LONG_LIST = 256
#: Shingles that one task holds when it works on a cell.
BLOCK_SHINGLES = 4_000_000
#: Bits of the fixed-size filter of document ids whose texts are needed again.
ID_BITS = 1 << 23
#: Lengths are compared in steps of 5 %; a similarity of 0.8 spans at most 5 of them.
STEP, SPAN = 1.05, 5
#: Large cells are cut into bands of length; sets of one similarity of 0.8 are at most one band apart.
BAND, BAND_SLOTS = 1.25, 1 << 32


def _least_overlap(n: np.ndarray) -> np.ndarray:
    return (80 * n + 99) // 100


def _kept_occurrences(n: np.ndarray) -> np.ndarray:
    """m: how often a pair of sets must at least meet in short lists."""
    return np.maximum(1, n // 20)


def _digest(sets: np.ndarray, bounds: np.ndarray, key_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit digest of each set in two halves, which mix elements differently; 0 for the empty set. Tests narrow the first."""
    sizes = np.diff(bounds)

    def summed(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    first, second = mix(sets ^ np.uint64(0x5851F42D4C957F2D)), mix(sets + np.uint64(0x9E3779B97F4A7C15))
    key = mix(summed(sets) ^ mix(summed(first) + sizes.astype(np.uint64))) & np.uint64((1 << key_bits) - 1)
    check = mix(summed(second) + mix(summed(mix(second))))
    return np.where(sizes > 0, key, np.uint64(0)), np.where(sizes > 0, check, np.uint64(0))


def _digests(docs: DataFrame, size: int, bits: int, key_bits: int = 64) -> DataFrame:
    """Per text: doc_id, n and the digest (key, check). Besides, rows with doc_id null hold slices of the task's counters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.uint32)
        used = False
        for batch in batches:
            for chunk in chunks(batch):
                sets, bounds = shingle_sets(chunk, size)
                counters += np.bincount((sets >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                used = True
                rows = len(chunk)
                keys, checks = _digest(sets, bounds, key_bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(chunk.first, rows),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(keys.view(np.int64), pa.int64()),
                        pa.array(checks.view(np.int64), pa.int64()),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.binary()),
                    ],
                    names=["doc_id", "n", "key", "check", "slice", "counts"],
                )
        if used:
            blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(counters, SLICES)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, pa.int64())] * 4 + [pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())],
                names=["doc_id", "n", "key", "check", "slice", "counts"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, key long, check long, slice int, counts binary")


def _levels(digests: DataFrame) -> bytes:
    """One byte per counter: how frequent, in quarters of a power of two; what is usual or rarer is all the same."""

    def total(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in table.column("counts").to_pylist())
        levels = np.floor(4 * np.log2(counts + 1.0)).astype(np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary())})

    rows = digests.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(total, "slice int, levels binary")
    slices = dict(rows.collect())  # SLICES rows, 2 ** bits bytes in all, whatever the size of the input
    levels = np.frombuffer(b"".join(slices[k] for k in sorted(slices)), np.uint8)
    if not len(levels):
        return b""
    usual = np.median(levels[levels > 0]) + 1 if (levels > 0).any() else 0
    return np.maximum(levels, np.uint8(usual)).tobytes()


POSTING = ["shingle", "cls", "check", "step"]


def _postings(docs: DataFrame, size: int, bits: int, levels, parts: int, key_bits: int = 64) -> DataFrame:
    """The short lists of every class, packed by part: shingle, the digest of the class (cls, check) and length step.

    A task sends the lists of a class once, however many copies it reads; it forgets which it sent after SENT_CLASSES.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(levels.value, np.uint8)
        held: list[tuple] = []
        sent: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return packed((columns[0] % np.uint64(parts)).astype(np.int32), columns, POSTING)

        for batch in batches:
            for chunk in chunks(batch):
                sets, bounds = shingle_sets(chunk, size)
                classes, checks = _digest(sets, bounds, key_bits)
                n = np.diff(bounds)
                # Rare before frequent, ties by hash: one key that sorts so.
                keys = (frequent[(sets >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (
                    sets & np.uint64((1 << 56) - 1)
                )
                lengths = np.minimum(n, n - _least_overlap(n) + _kept_occurrences(n))
                fresh, rare = [], []
                for row, (cls, low, high, keep) in enumerate(
                    zip(zip(classes.tolist(), checks.tolist(), strict=True), bounds[:-1].tolist(), bounds[1:].tolist(), lengths.tolist(), strict=True)
                ):
                    if cls in sent or low == high:
                        continue
                    if len(sent) >= SENT_CLASSES:
                        sent.clear()
                    sent.add(cls)
                    own = keys[low:high]
                    fresh.append(row)
                    rare.append(own if keep >= len(own) else np.partition(own, keep - 1)[:keep])
                if not fresh:
                    continue
                classes, checks, lengths, n = classes[fresh], checks[fresh], lengths[fresh], n[fresh]
                steps = np.minimum(np.log(np.maximum(n, 1)) / np.log(STEP) + 1e-9, 255).astype(np.uint8)
                held.append((np.concatenate(rare), np.repeat(classes, lengths), np.repeat(checks, lengths), np.repeat(steps, lengths)))
                if sum(len(x[0]) for x in held) > 1_000_000:
                    yield flush()
        if held and sum(len(x[0]) for x in held):
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(work, packed_schema(POSTING))


def _numbered(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different digests (key, check) in order, and the place of each element's among them."""
    order = np.lexsort((checks, keys))
    sorted_keys, sorted_checks = keys[order], checks[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (sorted_keys[1:] != sorted_keys[:-1]) | (sorted_checks[1:] != sorted_checks[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return sorted_keys[fresh], sorted_checks[fresh], place


def _met(postings: DataFrame, long_list: int) -> DataFrame:
    """Pairs of classes that meet in the short lists of a part, how often, and how often they need to over all parts.

    Rows with `need` 0 tie a class of a long list to another class of it.
    """

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shingles = unpacked(table, "shingle", np.uint64)
        keys, checks, classes = _numbered(unpacked(table, "cls", np.uint64), unpacked(table, "check", np.uint64))
        steps = unpacked(table, "step", np.uint8).astype(np.int64)
        order = np.lexsort((classes, shingles))
        shingles, classes, steps = shingles[order], classes[order], steps[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (shingles[1:] != shingles[:-1]) | (classes[1:] != classes[:-1])
        shingles, classes, steps = shingles[fresh], classes[fresh], steps[fresh]
        starts = np.flatnonzero(np.concatenate(([True], shingles[1:] != shingles[:-1])))
        lengths = np.diff(np.append(starts, len(shingles)))
        length, last = np.repeat(lengths, lengths), np.repeat(starts + lengths, lengths)
        left, right, need = [], [], []
        at = np.flatnonzero((length > 1) & (length <= long_list))
        apart = 1
        while len(at):
            at = at[at + apart < last[at]]
            near = at[np.abs(steps[at] - steps[at + apart]) <= SPAN]
            left.append(classes[near])
            right.append(classes[near + apart])
            need.append(np.minimum(steps[near], steps[near + apart]))
            apart += 1
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        n = np.concatenate(need) if need else np.zeros(0, np.int64)
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(a)))
        # The smallest length that the step stands for, less one for rounding.
        need = _kept_occurrences(np.maximum(1, np.floor(STEP ** n[first]).astype(np.int64) - 1))
        long = np.flatnonzero((length > long_list))
        tied = classes[np.repeat(starts, lengths)[long]]
        own = classes[long]
        apart = own != tied
        ties = np.unique(np.stack([tied[apart], own[apart]]), axis=1)
        a, b = np.concatenate((a[first], ties[0])), np.concatenate((b[first], ties[1]))
        return pa.table(
            {
                "a": pa.array(keys[a].view(np.int64)),
                "a_check": pa.array(checks[a].view(np.int64)),
                "b": pa.array(keys[b].view(np.int64)),
                "b_check": pa.array(checks[b].view(np.int64)),
                "times": pa.array(np.concatenate((times, np.ones(ties.shape[1], np.int64)))),
                "need": pa.array(np.concatenate((need, np.zeros(ties.shape[1], np.int64)))),
            }
        )

    return postings.groupBy("part").applyInArrow(work, "a long, a_check long, b long, b_check long, times long, need long")


def _needed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the documents in `wanted` (doc_id, ...), joined to it.

    A bitmap of fixed size (at most ID_BITS / 64 rows) drops most other texts before the shuffle.
    """
    def bit(name: str):
        return F.pmod(F.xxhash64(name), F.lit(ID_BITS))

    bitmap = (
        wanted.select(bit("doc_id").alias("_bit"))
        .groupBy(F.shiftright("_bit", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_mask"))
    )
    near = (
        docs.select("doc_id", "text")
        .withColumn("_bit", bit("doc_id"))
        .join(F.broadcast(bitmap), F.shiftright("_bit", 6) == F.col("_word"))
        .filter(F.expr("(_mask & shiftleft(1L, cast(_bit & 63 as int))) != 0"))
        .select("doc_id", "text")
    )
    return near.join(wanted, "doc_id")


def _t_occurrences(sets: list[np.ndarray], side: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the later sets it links with. With `side`, only pairs across both sides count.

    DivideSkip: a query's longest lists (at most T - 1) are left out of the merge; sets that occur often enough in
    the others are searched in the left-out lists.
    """
    count = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(count), sizes)
    values, ids = np.unique(everything, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    lists = owner[order]
    pointer = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(values)))))
    # Sorted (list, set) pairs, so one binary search tells whether a set is in a list.
    places = ids[order].astype(np.int64) * count + lists
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    for query in range(count):
        own = ids[bounds[query] : bounds[query + 1]]
        lengths = pointer[own + 1] - pointer[own]
        shared = lengths > 1
        own, lengths = own[shared], lengths[shared]
        least = int(_least_overlap(sizes[query : query + 1])[0])
        if len(own) < least:
            continue
        by_length = np.argsort(lengths, kind="stable")
        skipped = min(least - 1, int(least / (0.01 * np.log2(lengths.max() + 1) * 10 + 1)))
        short, long = (own[by_length[: len(own) - skipped]], own[by_length[len(own) - skipped :]])
        sums = np.cumsum(pointer[short + 1] - pointer[short])
        total = int(sums[-1])
        spread = np.arange(total) + np.repeat(pointer[short] - np.concatenate(([0], sums[:-1])), pointer[short + 1] - pointer[short])
        counts = np.bincount(lists[spread], minlength=count)
        found = np.flatnonzero(counts[query + 1 :] >= least - skipped) + query + 1
        if side is not None:
            found = found[side[found] != side[query]]
        if not len(found):
            continue
        overlap = counts[found]
        for one in long.tolist():
            probe = one * count + found
            at = np.minimum(np.searchsorted(places, probe), len(places) - 1)
            overlap = overlap + (places[at] == probe)
        linked = found[100 * overlap >= 80 * (sizes[query] + sizes[found] - overlap)]
        if len(linked):
            yield query, linked


def _forest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links inside the cells of a bucket: per class its links' weight and a class of the same component."""
    cells = table.column("cell").to_numpy()
    classes = table.column("cls").to_numpy()
    weight = table.column("size").to_numpy()
    blocks, first, second = (table.column(x).to_numpy() for x in ("block", "low", "high"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    out: list[tuple] = []
    # A class comes once, also where rows of the same doc_id were read more than once.
    met: dict[tuple, dict[int, int]] = {}
    for row, name in enumerate(zip(cells.tolist(), first.tolist(), second.tolist(), strict=True)):
        met.setdefault(name, {}).setdefault(int(classes[row]), row)
    for (_, low, high), members in met.items():
        rows = list(members.values())
        side = None if low == high else blocks[rows]
        root = list(range(len(rows)))
        links = np.zeros(len(rows), np.int64)
        weights = weight[rows]

        def find(x: int, root: list[int] = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for query, linked in _t_occurrences([sets[r] for r in rows], side):
            links[query] += weights[linked].sum()
            links[linked] += weights[query]
            for other in linked.tolist():
                a, b = find(query), find(other)
                root[max(a, b)] = min(a, b)
        out.extend((classes[r], classes[rows[find(i)]], links[i]) for i, r in enumerate(rows) if links[i])
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("a", "b", "links"), columns, strict=True)})


def _placed(members: DataFrame, block_shingles: int) -> DataFrame:
    """Members of cells (cell, cls, n, ...) with their block and the blocks, their own included, that it meets.

    A cell of at most `block_shingles` shingles is one block, -1. A larger one is cut by length, each band a quarter longer
    than the one before, and a band by hash into blocks of that size. Sets that link differ in length by a quarter at
    most, so a block meets those of its own and of both neighbouring bands, not those of the whole cell.
    """
    large = members.groupBy("cell").agg(F.sum("n").alias("_total")).filter(F.col("_total") > block_shingles).select("cell")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("long")
    banded = members.join(large, "cell").withColumn("_band", band)
    slots = banded.groupBy("cell", "_band").agg(F.ceil(F.sum("n") / block_shingles).cast("long").alias("_slots"))
    first = F.expr(f"_band * {BAND_SLOTS}L")
    near = (
        slots.withColumn("_own", F.expr("sequence(0L, _slots - 1)"))
        .select("cell", F.transform("_own", lambda slot: first + slot).alias("_blocks"), F.explode(F.expr("sequence(_band - 1, _band + 1)")).alias("_band"))
        .groupBy("cell", "_band")
        .agg(F.flatten(F.collect_list("_blocks")).alias("others"))
    )
    cut = (
        banded.join(slots.join(near, ["cell", "_band"]), ["cell", "_band"])
        .withColumn("block", first + F.expr("pmod(xxhash64(cls), _slots)"))
        .drop("_band", "_slots")
    )
    whole = members.join(large, "cell", "left_anti").withColumns(
        {"block": F.lit(-1).cast("long"), "others": F.array(F.lit(-1).cast("long"))}
    )
    return whole.unionByName(cut)


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    sketch_bits: int = SKETCH_BITS,
    long_list: int = LONG_LIST,
    block_shingles: int = BLOCK_SHINGLES,
    key_bits: int = 64,
) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, n_links.

    Null, empty and wordless texts have n_shingles 0 and are their own component. Rows that repeat a doc_id are taken one by
    one; a row without doc_id is in no component (null), unless an equal text has an id. A text with fewer than `size` words is
    one shingle. n_links counts linked documents, equal sets included. Texts of any length are taken whole; their
    sets are held one at a time. Other columns of `docs` are ignored. An empty table gives no rows. Classes are told
    apart by a 128-bit digest (n documents share one by accident with probability n^2 / 2^129).
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    digests = cut_lineage(_digests(docs, size, sketch_bits, key_bits))
    levels = spark.sparkContext.broadcast(_levels(digests))
    texts = digests.filter("slice is null").select("doc_id", "n", "key", "check")
    # The numbers hold once they are written.
    classes = cut_lineage(
        texts.filter("n > 0")
        .groupBy("key", "check")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    met = _met(_postings(docs, size, sketch_bits, levels, parts, key_bits), long_list)
    enough = met.groupBy("a", "a_check", "b", "b_check").agg(F.sum("times").alias("times"), F.min("need").alias("need")).filter("times >= need")
    ends = [classes.select(F.col("key").alias(x), F.col("check").alias(f"{x}_check"), F.col("cls").alias(f"{x}_cls")) for x in ("a", "b")]
    numbered = enough.join(ends[0], ["a", "a_check"]).join(ends[1], ["b", "b_check"])
    ties = cut_lineage(numbered.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")))
    cells = components(ties).select(F.col("node").alias("cls"), F.col("label").alias("cell"))
    members = cut_lineage(cells.join(classes, "cls"))
    placed = _placed(members, block_shingles)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                found, bounds = shingle_sets(chunk, size)
                own = pa.Table.from_batches([batch.slice(chunk.first, len(chunk))]).drop_columns(["text"])
                # The text may belong to another row of the same doc_id.
                mine = np.logical_and(
                    *(x.view(np.int64) == own.column(name).to_numpy() for x, name in zip(_digest(found, bounds, key_bits), ("key", "check"), strict=True))
                )
                blobs = [found[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                own = own.append_column("shingles", pa.array(blobs, pa.binary()))
                yield from own.filter(pa.array(mine)).drop_columns(["key", "check"]).to_batches()

    wanted = placed.select(F.col("first_id").alias("doc_id"), "cell", "cls", "key", "check", "size", "block", "others")
    indexed = _needed_texts(docs, wanted).mapInArrow(
        sets, "doc_id long, cell long, cls long, size long, block long, others array<long>, shingles binary"
    )
    paired = (
        indexed.withColumn("other", F.explode("others"))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .withColumn(
            "bucket",
            F.when(F.col("block") < 0, F.pmod(F.xxhash64("cell"), F.lit(parts))).otherwise(
                F.xxhash64("cell", "low", "high")
            ),
        )
    )
    forest = cut_lineage(
        paired.select("bucket", "cell", "cls", "size", "block", "low", "high", "shingles")
        .groupBy("bucket")
        .applyInArrow(_forest, "a long, b long, links long")
    )
    levels.unpersist()
    links = forest.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cls")
    labels = components(forest.select("a", "b")).select(F.col("node").alias("cls"), "label")
    ids = (
        labels.join(classes.select("cls", "first_id"), "cls")
        .groupBy("label")
        .agg(F.min("first_id").alias("component_id"))
    )
    linked = labels.join(ids, "label").join(links, "cls", "left").select("cls", "component_id", "links")
    known = classes.join(linked, "cls", "left").select(
        "key",
        "check",
        F.coalesce("component_id", "first_id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
    )
    alone = texts.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")
    )
    rest = texts.filter("n > 0").join(known, ["key", "check"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return rest.unionByName(alone)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest doc_id. All columns stay.

    Rows of one doc_id are kept or dropped together: kept if any of them stays. Rows without a doc_id stay.
    """
    ids = near_duplicates(docs, **options)
    gone = ids.groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("stays")).filter("not stays")
    return docs.join(gone, "doc_id", "left_anti")
