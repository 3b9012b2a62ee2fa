"""Spelling variants, language and collocations against plain versions, and on hard cases."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tools.check import compare, connect
from wattloom.llm import collocations, language_id, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WIDE = "doc_id long, text string, lang string, word string, n int, key string, form string, w1 int, place string, score string"


def frame(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", "z", 2, "p", "q") for i, t, lang in rows], WIDE)


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()


def plain_variants(rows):
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    known = {w: n for w, n in counts.items() if n >= 2}
    without = defaultdict(set)
    for w in known:
        for i in range(len(w)):
            without[i, w[:i] + w[i + 1 :]].add(w)
    near = {w: set() for w in known}
    for words in without.values():
        for w in words:
            near[w] |= words - {w}
    for w in known:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in known:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-known[x], x), default=None)
        if best and known[best] >= 10 * known[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), known.get(form.get(w)), root(w)) for w, n in known.items()}


def variants_of(result):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in result.collect()}


def test_spelling_equals_brute_force(spark, docs):
    assert variants_of(entry.queries()["op11_spelling"](spark, SF)) == plain_variants(docs)


@pytest.mark.parametrize("symbols,part_words", [(2, 50), (3, 10_000), (9, 7)])
def test_spelling_plan_changes_nothing(spark, docs, symbols, part_words):
    rows = docs[:60]
    assert variants_of(spelling.variants(frame(spark, rows), symbols, part_words)) == plain_variants(rows)


def test_spelling_hard_cases(spark):
    chain = [("gardenéry", 1000), ("gardenér", 90), ("gardner", 3), ("gardenr", 8), ("GARDENER", 7), ("gardenerx", 2), ("jardener", 70)]
    rows = [(i, " ".join([word] * n), "en") for i, (word, n) in enumerate(chain, 100)]
    long = "ab" * 4000
    rows += [(1, None, None), (2, "", None), (3, " 7\n", None), (None, "gardener Gardener", "x"), (5, f"{long} {long}x {long} {long}x", "x"), (6, "straßen×÷ " * 40, "x")]
    rows += rows[:3]
    got = variants_of(spelling.variants(frame(spark, rows)))
    assert got == plain_variants(rows)
    assert any(form for _, _, form, _, _ in got.values())
    assert spelling.variants(frame(spark, rows).limit(0)).collect() == []


def test_crc_of_ranges():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    begin, end = np.array([0, 5, 300, 10, 7]), np.array([0, 600, 364, 11, 72])
    state = np.array([zlib.crc32(b"%d:" % i) for i in range(5)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(begin, end, state, strict=True)]
    assert spelling.continued_crc(data, begin, end, state).tolist() == want


def test_one_edit_is_exact():
    words = [b"abcdefgh", b"abcdefg", b"abcdefgx", b"bcdefgh", b"abcdefghi", b"abcdefghij", b"aabcdefgh", b"abdcefgh", b"abcdefgh", b"x" * 40, b"x" * 41, b"x" * 40 + b"y" * 2]

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    data, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    got = spelling.one_edit(data, np.cumsum(sizes) - sizes, sizes, a, b)
    assert got.tolist() == [apart(words[i], words[j]) for i, j in zip(a, b, strict=True)]


def plain_collocations(rows, support=30, top=2000):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    known = {key: a for key, a in f.items() if a >= support and len(key[1]) > 1}
    gone = set()
    for (lang, phrase), a in known.items():
        for size in range(2, len(phrase)):
            for i in range(len(phrase) - size + 1):
                inner = (lang, phrase[i : i + size])
                if 100 * a >= 80 * known[inner]:
                    gone.add(inner)
    out = defaultdict(list)
    for (lang, p), a in known.items():
        if (lang, p) not in gone:
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, i, p.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items()
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def collected(result):
    return sorted(tuple(row) for row in result.select(COLUMNS).collect())


def test_collocations_equal_sql_and_brute_force(spark, docs):
    got = entry.queries()["op13_collocations"](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(entry.oracle_sql()["op13_collocations"]).df()) == ""
    assert sorted(map(tuple, got[COLUMNS].itertuples(index=False))) == plain_collocations(docs)


def test_local_support_and_false_marks_change_nothing(spark, docs, monkeypatch):
    """Few shards with a lowered support above 1, many shards, and a bitmap that is nearly full."""
    rows = docs[:120]
    want = plain_collocations(rows, 12, 50)
    assert len(want) > 20
    assert collected(collocations.collocations(frame(spark, rows).repartition(4), 12, top=50)) == want
    assert collected(collocations.collocations(frame(spark, rows).repartition(40), 12, top=50, bits=10)) == want


def test_collocations_hard_cases(spark):
    rows = [(i, "New York, new york city! a b c d a b c d. x", "en") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, " \t\n", None), (103, "q q " * 60, None), (104, "Z" * 70_000 + " tail " + "Z" * 70_000, "de"), (None, "new york " * 3, "und")]
    rows += [(105, f"{'w' * 300} t " * 30 + f"{'w' * 299}W t " * 5, "de")]
    assert collected(collocations.collocations(frame(spark, rows))) == plain_collocations(rows)
    assert collocations.collocations(frame(spark, rows).limit(0)).collect() == []


def test_language_of_held_out_rows(spark, docs):
    got = {r["doc_id"]: r for r in entry.queries()["op12_language_id"](spark, SF).collect()}
    assert len(got) == len(docs)
    right = total = 0
    for i, text, lang in docs:
        row = got[i]
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= row["score"] <= 1
        if text is None or not any(c.isalpha() for c in text):
            assert row["lang_pred"] == "und"
        elif row["held_out"] and lang is not None:
            total += 1
            right += row["lang_pred"] == lang
    assert total > 30 and right >= 0.97 * total


def test_language_equals_a_plain_nearest_centroid(spark, docs):
    """Vectors and cosines once more, gram by gram."""
    rows = docs[:80]
    model = language_id.fitted(frame(spark, rows), dims=256, limit=30, centroids=3)
    assert len(set(model.langs)) < len(model.langs)

    def vector(text):
        folded = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text).encode())
        counts = np.zeros(256)
        for size, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), 1):
            for i in range(len(folded) - size + 1):
                gram = int.from_bytes(folded[i : i + size], "big") + (size << 24)
                counts[(gram * factor & 0xFFFFFFFF) >> 24] += 1
        out = np.log1p(counts) * model.idf
        return out / np.linalg.norm(out)

    got = {r["doc_id"]: r for r in language_id.identified(frame(spark, rows), model).collect()}
    for i, text, _ in rows:
        cosines = model.means @ vector(text)
        assert got[i]["score"] == pytest.approx(min(1, cosines.max()), abs=1e-4)
        assert cosines[[x == got[i]["lang"] for x in model.langs]].max() == pytest.approx(cosines.max(), abs=1e-4)


def test_language_rejects_far_texts(spark, docs):
    model = language_id.fitted(frame(spark, docs))
    rows = [(1, "中文没有 привет", None), (2, None, "en"), (3, "", "en"), (4, "12 \n !", "de"), (5, docs[0][1], None), (5, docs[0][1], None), (None, docs[0][1], None), (7, docs[0][1] * 300, None)]
    got = language_id.identified(frame(spark, rows), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[1]["rejected"] and by[1]["lang"] in model.langs
    assert all(by[i]["lang"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4))
    assert {by[i]["lang"] for i in (5, None, 7)} == {docs[0][2]} and not by[5]["rejected"]
    none = language_id.fitted(frame(spark, rows).limit(0))
    assert none.langs == [] and language_id.identified(frame(spark, rows).limit(0), none).collect() == []
    assert {r["lang"] for r in language_id.identified(frame(spark, rows), none).collect()} == {"und"}


def test_examples_are_bounded_and_differ(spark):
    rows = [(i, f"text {i % 50}" if i < 900 else "the same", "en" if i % 3 else "de") for i in range(2000)]
    got = language_id.examples(frame(spark, rows), 20).collect()
    assert Counter(r["lang"] for r in got) == {"en": 20, "de": 20}
    assert len({(r["lang"], r["text"]) for r in got}) == 40
    assert spark.range(4).select(language_id.held_out(F.col("id").cast("long")).alias("h")).collect()[0]["h"] == (zlib.crc32(b"0") % 4 == 2)
