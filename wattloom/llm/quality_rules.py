"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per text; its outcome is one bit and its measurements are columns. A policy is a set of
rules under a version name; applying one, or asking what each of its rules does alone, is bit arithmetic on the
stored ledger and reads no text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Name of each rule in the order of its bits, and when a text fails it, over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 5 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
}

#: Versioned policies: the rules whose failure rejects a text.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(rule) for rule in POLICIES[policy])


def _long(column: Column) -> Column:
    return column.cast("long")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the measurements of `text` (null: no words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, WHITE, "")
    own = [F.col(name).alias(f"_keep_{i}") for i, name in enumerate(keep)]
    trimmed = F.btrim(text, F.lit(WHITE))
    parts = docs.select(
        *own,
        _long(F.length(bare)).alias("word_chars"),
        _long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "").alias("_lines"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")).alias("_words"),
    )
    # A window of three words is told by its hash; each later step reads stored columns, so nothing is computed twice.
    windows = parts.select(
        *[f"_keep_{i}" for i in range(len(keep))],
        "word_chars",
        "n_symbols",
        _long(F.size("_lines")).alias("n_lines"),
        _long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _long(F.size("_words")).alias("n_words"),
        F.expr(
            "case when size(_words) >= 3 then transform(sequence(0, size(_words) - 3),"
            " i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) else cast(array() as array<bigint>) end"
        ).alias("_windows"),
    )
    marked = windows.withColumn("_some", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    ordered = marked.withColumn(
        "_ordered",
        F.expr("case when _some then sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))) end"),
    )
    places = ordered.withColumn(
        "_places",
        F.expr(
            "sort_array(transform(filter(_ordered, (x, k) -> x.h = get(_ordered, k - 1).h or x.h = get(_ordered, k + 1).h),"
            " x -> x.i))"
        ),
    )
    # Each repeated window covers three words, or what lies between it and the one before.
    covered = F.expr(
        "coalesce(aggregate(_places, named_struct('last', -3, 'n', 0L),"
        " (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n), 0L)"
    )
    measures = F.struct(*[covered.alias(name) if name == "n_repeat_words" else F.col(name) for name in MEASUREMENTS])
    # As a generator's output the measurements are computed once; a filter on them would else be pushed below and
    # carry a copy of every array expression with it.
    return places.select(*[F.col(f"_keep_{i}").alias(name) for i, name in enumerate(keep)], F.inline(F.array(measures)))


def failures(measurements: DataFrame) -> DataFrame:
    """Adds `failed_bits`: bit k is set where rule k fails."""
    bits = [F.when(F.expr(rule), F.lit(bit(name))).otherwise(F.lit(0)) for name, rule in RULES.items()]
    total = bits[0]
    for one in bits[1:]:
        total = total.bitwiseOR(one)
    return measurements.withColumn("failed_bits", total.cast("long"))


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text): the columns `keep`, all measurements and `failed_bits`.

    A null, empty or blank text has no words, lines or symbols and fails `few_words` only. Repeated rows and ids are
    measured one by one; an empty table gives an empty ledger. Columns that are not kept are not read, so their
    names may be anything; a kept column must not have the name of a measurement.
    """
    return failures(measured(docs, keep or ["doc_id"]))


def passes(policy: str) -> Column:
    """Whether a row of a ledger has none of the policy's bits."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: texts that fail it, texts that fail no other rule, and texts kept without it.

    Ledger rows are first counted per bitmask (at most 2^rules rows); the rules are then read off the masks.
    """
    counts = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    whole = F.lit(mask(policy))
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(bit(rule)).cast("long").alias("bit")) for rule in POLICIES[policy]])
    each = counts.withColumn("_rule", F.explode(rows)).select("failed_bits", "n", "_rule.*")
    hit = F.col("failed_bits").bitwiseAND(F.col("bit")) != 0
    others = F.col("failed_bits").bitwiseAND(whole).bitwiseAND(F.bitwise_not(F.col("bit")))
    zero = F.lit(0).cast("long")
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(zero)).alias("failed"),
        F.sum(F.when(hit & (others == 0), F.col("n")).otherwise(zero)).alias("failed_alone"),
        F.sum(F.when(others == 0, F.col("n")).otherwise(zero)).alias("kept_without"),
    )


def kept_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of `docs` that pass a policy, with their columns as they are."""
    names = docs.columns
    boxed = docs.select(F.struct(*names).alias("row"), F.col("text").alias("text"))
    return ledger(boxed, ["row"]).filter(passes(policy)).select("row.*")
