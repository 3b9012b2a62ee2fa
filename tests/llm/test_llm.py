"""The training-data operators against brute force, round trips and SQL, and on hard cases."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tools.check import compare, connect
from wattloom.llm import (
    bpe,
    chat_format,
    decontaminate,
    html_extract,
    line_dedup,
    ngram_join,
    quality_rules,
    secret_scan,
    suffix_dedup,
    toxicity,
)

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i}" for i in range(30_000))
LINE = "the same long line of ten words stands here twice"
#: Nulls, empty and blank texts, ties, repeated rows and a very long text.
HARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (6, LONG), (7, LONG + " more"), (8, f"{LINE}\n{LINE}"), (8, f"{LINE}\n{LINE}"), (None, LINE)]


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def hard(spark):
    """The hard cases with columns whose names operators use themselves."""
    rows = [(i, t, "x", 1, 2, "y") for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, items string, n_words int, cls int, spans string")


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def results(spark):
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = entry.queries()[name](spark, SF).toPandas()
        return kept[name]

    return get


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & {"op6_quality_rules", "op9_chat_format"}))
def test_query_equals_sql(results, name):
    assert compare(results(name), connect(SF).execute(entry.oracle_sql()[name]).df()) == ""


@pytest.mark.parametrize("name", ["op6_quality_rules", "op9_chat_format"])
def test_native_operators_have_no_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found)} if 0 < len(found) < 5 else {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def linked_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_finds_all_links(results, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in results("op1_ngram_join").itertuples()}
    assert got == linked_components(docs)


def test_ngram_join_blocks_and_long_lists_change_nothing(spark, docs):
    """Near copies of one text, with lists too long to expand and cells parted into blocks."""
    base = [f"v{i}" for i in range(60)]
    texts = {i: " ".join(base[:50] + base[50 + i % 5 :]) for i in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = ngram_join.near_duplicates(frame, long_list=3, block_shingles=400).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked_components(texts)


def test_ngram_join_sends_a_class_once_per_task(spark):
    rows = [(i, " ".join(f"v{j}" for j in range(40)) if i % 10 else f"w{i} x{i} y{i} z{i} a{i} b{i}") for i in range(200)] + [(900, None), (901, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    levels = spark.sparkContext.broadcast(bytes(1 << 16))
    sent = []
    for row in ngram_join._postings(frame, 5, 16, levels, 4).collect():
        sent += zip(np.frombuffer(row.shingle, np.uint64).tolist(), np.frombuffer(row.cls, np.uint64).tolist(), strict=True)
    assert len(sent) == len(set(sent)) and len({cls for _, cls in sent}) == 21
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame).collect()}
    assert got == linked_components({i: t or "" for i, t in rows})


def test_ngram_join_bands_of_length_lose_no_link(spark):
    """Beginnings of one text, 20 to 260 words long, in one cell cut into many blocks over many bands."""
    words = [f"v{i}" for i in range(260)]
    texts = {i: " ".join(words[: 20 + (i * 37) % 241]) for i in range(120)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    whole = ngram_join.near_duplicates(frame, long_list=3).collect()
    cut = ngram_join.near_duplicates(frame, long_list=3, block_shingles=500).collect()
    assert sorted(cut) == sorted(whole)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in cut} == linked_components(texts)


def test_ngram_join_of_classes_that_share_half_a_digest(spark, docs):
    """With two bits of the first half, the second tells classes apart in every step."""
    texts = {**docs, **{900_000 + i: f"{docs[min(docs)]} tail {i % 3}" for i in range(9)}}
    rows = [*texts.items(), (900_000, "another text of the same id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(frame, key_bits=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.n_shingles > 2 or r.doc_id != 900_000} == linked_components(texts)
    assert sorted(map(str, got)) == sorted(map(str, ngram_join.near_duplicates(frame).collect()))


def test_ngram_join_hard_cases(hard):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.near_duplicates(hard).collect())
    assert [x[2] for x in got if x[0] in (1, 2, 3)] == [1, 2, 3]
    assert [x[2] for x in got if x[0] in (4, 5)] == [4, 4]
    assert [x[2] for x in got if x[0] in (6, 7)] == [6, 6]
    kept = ngram_join.one_of_each(hard)
    assert kept.columns == hard.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 8]


def removed_bytes(texts, length=50):
    seen, out = {}, {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if seen.setdefault(data[p : p + length], i) < i:
                gone[p : p + length] = b"\1" * length
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), digest(bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def test_suffix_dedup_equals_brute_force(results, docs):
    rows = results("op2_suffix_dedup").itertuples()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == removed_bytes(docs)


def test_suffix_dedup_hard_cases(hard):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicated(hard).collect()}
    assert got[1] == got[2] == (0, 0) and got[6][1] == 0 and got[7][1] == len(LONG) and got[8][1] == 0 and got[None][1] == 0


def test_bpe_equals_the_library(results, docs):
    library = Tokenizer.from_file(VOCABULARY)
    for row in results("op3_bpe").itertuples():
        ids = library.encode(docs[row.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(text))


@pytest.mark.parametrize("text", ["", "a<|endoftext|>B <|startoftext|>", "x\x1cy", "Σίσυφος ΟΔΥΣΣΕΥΣ", "½² ⅷ 中文 's's we'd", "🙂 ‍zero", "a\u1acd\u0323 \U00010d50 a\U00016ea0", None])
def test_bpe_hard_texts(text):
    library = Tokenizer.from_file(VOCABULARY)
    ids = library.encode(text or "", add_special_tokens=False).ids
    got = next(bpe.encode_texts(VOCABULARY, [text]))
    assert got == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False), len(ids))


def test_bpe_round_trip(hard):
    tokens = bpe.encoded(hard, VOCABULARY)
    again = bpe.decoded(tokens.drop("decoded"), VOCABULARY)
    assert sorted(again.select("ids", "decoded").collect()) == sorted(tokens.select("ids", "decoded").collect())


def test_toxicity_on_held_out_rows(spark):
    rows = [(i, f"plain text number {i} of many " + ("awful rotten awful" if i % 3 == 0 else "good fine"), int(i % 3 == 0)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fitted(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.scored(frame, index).collect()}
    assert all((got[i] >= 0.3) == bool(toxic) for i, _, toxic in rows)
    # The bounds leave out no neighbour: the same cosines as over all examples at once.
    places, values = index.matrix[5].nonzero()[0], index.matrix[5][index.matrix[5].nonzero()[0]]
    whole = sorted((index.matrix[:, places] @ values).tolist(), reverse=True)[: toxicity.NEIGHBOURS]
    assert index.nearest(places, values)[1].tolist() == pytest.approx(whole, abs=1e-6)


def test_toxicity_takes_all_telling_terms(spark):
    # 700 words of toxic texts, a word that is only twice as usual in them, and one that only clean texts have.
    rows = [(i, " ".join(f"rot{(i // 2 * 7 + j) % 700}x" for j in range(60)) + (" usual" if i % 4 else "") if i % 2 == 0 else "calm text" + (" usual" if i % 4 == 1 else "") + f" n{i}", int(i % 2 == 0)) for i in range(0, 1600)]
    rows = [(i, text + (" mild" if (i % 10 < 7 if toxic else i % 10 < 3) else ""), toxic) for i, text, toxic in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fitted(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    known = set(index.vocabulary.tolist())
    found = toxicity.RangeHash(np.frombuffer(b"calm mild", np.uint8)).of(np.array([0, 5]), np.array([4, 9]))
    assert len(index.vocabulary) > 700 and known.issuperset(found.tolist())
    got = {r.doc_id: r for r in toxicity.scored(frame, index).collect()}
    assert all(len(got[i].evidence) == 3 and (got[i].score >= 0.3) == bool(toxic) for i, _, toxic in rows)
    dense = index.matrix
    for at in range(0, len(dense), 97):
        places = dense[at].nonzero()[0]
        whole = dense[:, places] @ dense[at][places].astype(float)
        assert index.nearest(places, dense[at][places])[1].tolist() == pytest.approx(np.sort(whole)[::-1][: toxicity.NEIGHBOURS].tolist(), abs=1e-6)


def test_toxicity_finds_terms_by_their_first_bits():
    near = np.uint64(0xABCDEF << 40) + np.arange(50, dtype=np.uint64)
    hashes = np.unique(np.concatenate([near, np.random.default_rng(5).integers(0, 2**64 - 1, 1000, np.uint64), np.array([0, 2**64 - 2], np.uint64)]))
    sought = np.concatenate([hashes, hashes + np.uint64(1), near - np.uint64(60), np.array([2**64 - 1], np.uint64)])
    for some in (hashes, hashes[:1], hashes[:0], np.append(hashes, np.uint64(2**64 - 1))):
        order = {x: i for i, x in enumerate(some.tolist())}
        assert toxicity.Vocabulary(some).places(sought).tolist() == [order.get(x, -1) for x in sought.tolist()]


def test_toxicity_takes_less_time_than_sorting_rows_and_terms():
    # Of a text's terms, those of the examples are found and counted; searching and sorting all of them took half of the time.
    order = np.random.default_rng(7)
    texts = [" ".join(f"word{n}" for n in (order.pareto(0.7, 300) * 20).astype(np.int64).clip(0, 10**9)) for _ in range(600)]
    chunk = next(iter(toxicity.chunks(pa.RecordBatch.from_pydict({"text": texts}))))
    vocabulary = np.unique(toxicity._counted(*toxicity._terms(chunk))[1])[::2]
    known = toxicity.Vocabulary(vocabulary)

    def plainly():
        terms, rows = toxicity._terms(chunk)
        have = vocabulary[np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)] == terms
        rows, terms, counts = toxicity._counted(terms[have], rows[have])
        at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        rows, at, counts = (x[vocabulary[at] == terms] for x in (rows, at, counts))
        order = np.lexsort((at, rows))
        return rows[order], at[order], counts[order]

    def seconds(work):
        begin = time.process_time()
        work()
        return time.process_time() - begin

    assert all((a == b).all() for a, b in zip(toxicity._vectors(chunk, known), plainly(), strict=True))
    assert min(seconds(lambda: toxicity._vectors(chunk, known)) for _ in range(5)) < 0.8 * min(seconds(plainly) for _ in range(5))


def plain_terms(text):
    """Terms and their counts by a regular expression: words, their beginnings, and each again at two and four occurrences."""
    counts = {}
    for word in re.findall(r"[0-9a-z\x80-\xff]+", (text or "").encode().decode("latin-1").translate({i: i + 32 for i in range(65, 91)})):
        for term in [word, *((n, word[:n]) for n in (5, 7) if len(word) > n)]:
            counts[term] = counts.get(term, 0) + 1
    return {(term, level): n for term, n in counts.items() for level in (1, 2, 4) if n >= level}


def plain_toxicity(docs, labels):
    """Evidence cosines and votes of every document over whole vectors, all examples compared."""
    terms = {i: plain_terms(text) for i, text in docs}
    frequency = Counter(t for own in terms.values() for t in own)
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in terms}
    examples = [i for i in sorted(labels) if i in terms and not held[i] and terms[i]]
    have = [Counter(t for i in examples if labels[i] == c for t in terms[i]) for c in (0, 1)]
    scale = {
        t: math.log((len(docs) + 1) / (frequency[t] + 0.5)) * math.log2(2 + have[1][t] / max(have[0][t], 1)) for t in have[0] | have[1]
    }

    def unit(own):
        values = {t: (1 + math.log(n)) * scale[t] for t, n in own.items() if t in scale}
        length = math.sqrt(sum(v * v for v in values.values()))
        return {t: v / length for t, v in values.items()}

    units = {i: unit(terms[i]) for i in examples}
    out = {}
    for i, own in terms.items():
        vector = unit(own)
        near = sorted(((sum(v * units[j].get(t, 0) for t, v in vector.items()), labels[j]) for j in examples), reverse=True)
        out[i] = [x for x in near if x[0] > 0][: toxicity.NEIGHBOURS + 1]
    return out


def test_toxicity_equals_whole_vectors(spark, docs):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    index = toxicity.fitted(frame, labels)
    texts = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    want = plain_toxicity(texts, {r.doc_id: r.toxic for r in labels.collect()})
    for row in toxicity.scored(frame, index).collect():
        near = want[row.doc_id]
        assert [e.cosine for e in row.evidence] == pytest.approx([c for c, _ in near[:3]], abs=1e-9)
        if not near:
            assert row.score == index.nothing
        elif len(near) <= toxicity.NEIGHBOURS or near[-2][0] - near[-1][0] > 1e-6:
            near = near[: toxicity.NEIGHBOURS]
            vote = sum(c * c * toxic for c, toxic in near) / sum(c * c for c, _ in near)
            assert row.score == pytest.approx(float(np.interp(vote, index.votes, index.chance)), abs=1e-6)


def test_toxicity_ties_repeated_rows_and_empty_tables(spark):
    rows = [(i, "same rotten words" if i % 2 else "same kind words", i % 2) for i in range(200)]
    frame = spark.createDataFrame([*rows, *rows[:9], (500, None, 0), (501, "", 0), (502, "nothing shared", 0)], "doc_id long, text string, toxic int")
    index = toxicity.fitted(frame, frame.select("doc_id", "toxic"))
    got = toxicity.scored(frame, index).collect()
    assert len(got) == 212 and all((r.score >= 0.3) == bool(r.doc_id % 2) for r in got if r.doc_id < 200)
    # All cosines are equal; the first places of the index come out.
    assert len({tuple(e.doc_id for e in r.evidence) for r in got if r.doc_id < 200}) == 2
    assert all(r.evidence == [] for r in got if r.doc_id in (500, 501))
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert toxicity.scored(none, index).collect() == []
    assert [r.score < 0.3 for r in toxicity.scored(frame, toxicity.fitted(none, none)).collect()] == [True] * 212


def test_toxicity_without_labels(spark, hard):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = [r.score for r in toxicity.scored(hard, toxicity.fitted(hard, none)).collect()]
    assert len(scores) == len(HARD) and all(0 <= x < 0.3 for x in scores)


def test_secrets_equal_plain_search(results, docs):
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for row in results("op5_secret_scan").itertuples():
        text = docs[row.doc_id] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert row.base_sha256 == digest(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)))


def test_secrets_hard_cases(spark):
    import zlib

    body, value, check = "Q" * 30, zlib.crc32(b"Q" * 30), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        check = secret_scan.DIGITS[d] + check
    rows = [(1, f"é ghp_{body}{check} ghp_{body}000000"), (2, "token=token=abcdefg"), (3, "passwd: abc PASSWORD = abcdef"), (4, None), (5, "ab" * 11), (6, "ab" * 12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", secret_scan.F.lit(1))
    got = {r.doc_id: [(s.start, secret_scan.KINDS[s.kind], s.end) for s in r.spans] for r in secret_scan.found(frame).collect()}
    assert got == {1: [(2, "github", 42)], 2: [(0, "assign", 19)], 3: [(12, "assign", 29)], 4: [], 5: [], 6: [(0, "hex", 24)]}
    assert {r.doc_id: r.text for r in secret_scan.redacted(frame).collect()}[2] == "[SECRET]"


def test_quality_policies_and_ablations(hard):
    book = quality_rules.ledger(hard)
    assert book.count() == len(HARD)
    rows = {r.rule: r for r in quality_rules.ablations(book, "v1").collect()}
    assert set(rows) == set(quality_rules.RULES) and rows["few_words"].failed == 8
    assert quality_rules.kept_documents(hard).columns == hard.columns


def test_pages(spark):
    page = (
        '<html><body><header>Site</header><nav><a href="/a">Menu</a></nav><div class="cookie-notice">We use cookies</div><main><article><h1>Title &amp; more</h1>'
        "<p><b>First<br>line<p>Second &lt;b&gt;\n  part</article><section id='comments'><p>Nice post, thank you very much indeed</p></section><ol id='readerComments'><li>More of them, and rather long</li></ol></main>"
        '<aside>Side</aside><form><input><button>Go</button></form><script>var t="</p>";</script><!-- x --><footer>Foot</footer></body></html>'
    )
    assert html_extract.main_text(page) == "Title & more\nFirst line\nSecond <b> part"
    rows = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", page), (3, "u", page), (4, None, "<p>a <b"), (5, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    got = {r.page_id: r.n_chars for r in html_extract.extracted(rows.withColumn("text", secret_scan.F.lit(1))).collect()}
    assert got[1] == got[2] == 0 and got[3] == len("Title & more\nFirst line\nSecond <b> part") and got[5] == 4


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar">{}{}</body>', '<body class="sidebar-right"><main id="comments">{}</main>{}</body>',
        '<body><div class="content with-sidebar">{}{}</div></body>', '<body><article class="post has-comments">{}</article>{}</body>',
        '<body><article class="post comments-open">{}</article>{}</body>', '<body><div id="noSidebar">{}</div>{}</body>',
        '<body><div class="content-sidebar-wrap"><div>{}</div>{}</div></body>', '<body><div class="page footer-fixed">{}{}</div></body>',
    ],
)
def test_pages_with_marks_around_the_article(page):
    text = "The article has some sentences, and they are longer than all that stands beside it. This is one more of them."
    side = '<div class="ad">Buy it</div><div class="left-sidebar"><p>Of the side</p></div><ul id="comments"><li>Nice post</li></ul>'
    assert html_extract.main_text(page.format(f"<p>{text}</p>", side)) == text


def test_pages_with_more_advertising_than_article():
    page = '<body><div class="ad">Much more of it than there is of the article, and all of it outside links</div><article><h1>Short</h1></article></body>'
    assert html_extract.main_text(page) == "Short"
    assert html_extract.main_text('<body><div class="header"><div class="ad">Buy it</div><h1>Title</h1><p>One more line</p></div></body>') == "Title\nOne more line"


def _plain_density(node, body):
    """The density of one node, all counts taken again from the tree below it."""

    def below(x):
        return [x, *(y for child in x.children if isinstance(child, html_extract.Node) and not child.dropped for y in below(child))]

    def text_of(x):
        return sum(y.weight * len("".join("".join(t.split()) for t in y.children if isinstance(t, str))) for y in below(x))

    def counts(x):
        links = [y for y in below(x) if y.tag == "a"]
        return text_of(x), len(below(x)) - 1, sum(map(text_of, links)), sum(y is not x for y in links)

    chars, tags, linked, link_tags = counts(node)
    whole = counts(body)
    if chars <= 0:
        return 0.0
    base = math.log(chars / max(chars - linked, 1) * linked + whole[2] / max(whole[0], 1) * chars + math.e)
    return chars / max(tags, 1) * max(0.0, math.log(chars / max(linked, 1) * max(tags, 1) / max(link_tags, 1))) / math.log(1 + base)


def test_densities_equal_plain_counts():
    pages = pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()
    linked = '<body><div class="c1"><a href="x">one <b>two</b></a> three</div><div><p>Four <a>five</a> six</p><p class="ad">Seven</p></div></body>'
    for page in [*pages[:20], linked]:
        root = html_extract._tree(page)
        nodes = html_extract._walk(root)
        html_extract._weigh_marks(nodes)
        body = next((x for x in nodes if x.tag == "body"), root)
        html_extract._weigh(nodes, body)
        for node in nodes:
            if not node.dropped:
                assert math.isclose(node.density, _plain_density(node, body), rel_tol=1e-9, abs_tol=1e-9)
                children = [x for x in node.children if isinstance(x, html_extract.Node) and not x.dropped]
                assert math.isclose(node.total, sum(_plain_density(x, body) for x in children), rel_tol=1e-9, abs_tol=1e-9)


def test_density_tells_pages_whose_names_say_nothing(monkeypatch):
    pages = pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()
    expected = [html_extract.main_text(x) for x in pages]
    plain = [x.replace('class="ad"', 'class="c1"').replace("<article>", '<div class="c2">').replace("</article>", "</div>") for x in pages]
    same = sum(html_extract.main_text(x) == y for x, y in zip(plain, expected, strict=True))
    assert same >= 0.9 * len(pages)
    # Without density, no mark drops anything.
    monkeypatch.setattr(html_extract, "_chosen", lambda nodes, body: ({id(body)}, set()))
    assert all(html_extract.main_text(x) != y for x, y in zip(pages, expected, strict=True) if 'class="ad"' in x)


def test_pages_keep_all_that_is_no_form():
    page = "<body><article><p>The value is <math><mi>x</mi>=2</math> here, <label>as said</label> <object>instead</object></p><fieldset>Set</fieldset></article></body>"
    assert html_extract.main_text(page) == "The value is x=2 here, as said instead\nSet"


def test_sections_of_one_article_stay_together():
    long, short = "A long sentence stands in this paragraph of the first section. " * 9, "Short."
    page = f"<body><article><section><p>{long}</p><p>{long}</p></section><section><p>{short}</p></section></article><div>Buy</div></body>"
    assert html_extract.main_text(page) == "\n".join([long.strip(), long.strip(), short])


@pytest.mark.parametrize("n", [1, 9, 40, 300])
def test_pages_whose_lower_case_is_longer(n):
    first, last = "\u0130" * n + " ve daha fazla", "Son paragraf da burada durur"
    page = f"<body><p>{first}</p><script>var a = 1;</SCRIPT><p>{last}</p><style>p {{}}</Style ><p>{last}</p><svg></svg><b>x</b></body>"
    assert html_extract.main_text(page) == f"{first}\n{last}\n{last}\nx"


def test_line_dedup(spark, hard):
    other = "A passage that two documents share has rather many words in it. It ends here."
    rows = [(1, f"first own words stand alone\n{LINE}\n{other}"), (2, f"{LINE.upper()} \nkept words of the second one. {other} End"), (3, "short\nshort")]
    got = {r.doc_id: bytes(r.kept).decode() for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == "kept words of the second one. It ends here. End"
    sizes = [(r.doc_id, r.n_bytes, r.n_removed) for r in line_dedup.deduplicated(hard).collect()]
    assert (8, 2 * len(LINE) + 1, len(LINE)) in sizes and len(sizes) == len(HARD)


def plain_units(text):
    """(normalised words, start byte, end byte) of all units, one sentence after the other."""
    data = (text or "").encode()
    found = list(re.finditer(rb"[^\x20\x09-\x0D]+", data))

    def stops(word):
        for _ in range(3):
            if word.endswith(tuple(".!?…。！？")):
                return True
            if len(word) < 2 or word[-1] not in "\"')]}”’»）」":
                return False
            word = word[:-1]
        return False

    line = [data.count(b"\n", 0, m.start()) for m in found]
    cuts = [i for i in range(len(found)) if i == 0 or line[i] != line[i - 1] or stops(found[i - 1].group().decode())]
    sentences = list(zip(cuts, [*cuts[1:], len(found)], strict=True))
    lines = [(min(x), max(x) + 1) for x in ([i for i, own in enumerate(line) if own == n] for n in sorted(set(line)))]
    out = {(a, b) for a, b in lines if b - a >= 5} | {x for x in sentences if x not in lines and x[1] - x[0] >= 8}
    for i, (a, b) in enumerate(sentences):
        if b - a >= 8:
            continue
        for only_short, least in ((True, 8), (False, 25)):
            for step in (1, -1):
                j = i
                while abs(sentences[j][1] - a if step > 0 else b - sentences[j][0]) < least:
                    j += step
                    if not 0 <= j < len(sentences) or (only_short and sentences[j][1] - sentences[j][0] >= 8):
                        break
                else:
                    out.add((a, sentences[j][1]) if step > 0 else (sentences[j][0], b))
    units = []
    for a, b in out:
        last = found[b - 1].end()
        feed = data.find(b"\n", last)
        following = found[b].start() if b < len(found) else len(data)
        end = min(following, feed + 1 if feed >= 0 else len(data))
        units.append((tuple(m.group().lower() for m in found[a:b]), found[a].start(), end))
    return units


def test_line_dedup_equals_plain_units(spark, docs):
    first = {}
    for doc in sorted(docs):
        for key, start, _ in plain_units(docs[doc]):
            first[key] = min(first.get(key, (doc, start)), (doc, start))
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    removed = 0
    for row in line_dedup.deduplicated(frame).collect():
        data = (docs[row.doc_id] or "").encode()
        gone = {i for key, start, end in plain_units(docs[row.doc_id]) if first[key] != (row.doc_id, start) for i in range(start, end)}
        assert bytes(row.kept) == bytes(x for i, x in enumerate(data) if i not in gone)
        removed += len(gone)
    assert removed > 0


def test_line_dedup_of_short_units(spark):
    verse = [f"verse {i} is short{mark}" for i, mark in enumerate([".", "!", "?", '."', ".)", "…", ".”"] * 2)]
    mixed = f"Then came n1. {' '.join(f'm{i}' for i in range(22))}. Then came n2. {' '.join(f'o{i}' for i in range(22))}. Then came n3."
    rows = [
        (1, f"These are the words that only one text has {' '.join(verse)} and these too"),
        (2, f"Its own beginning here.\n{chr(10).join(verse[1:-1])}\nIts own end."),
        (3, f"{mixed}\nMy end."),
        (4, f"Something else. {mixed} More."),
        (5, "One. Two. Three."), (6, "One. Two. Three."),
        (7, "\n".join(f"line {i} of verse" for i in range(20))), (8, "Other words\n" + "\n".join(f"line {i} of verse" for i in range(3, 20))),
    ]
    got = {r.doc_id: bytes(r.kept).decode() for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == rows[i - 1][1] for i in (1, 3, 5, 6, 7))
    assert got[2] == "Its own beginning here.\nIts own end."
    assert got[4] == "Something else. More."
    assert got[8] == "Other words\n"


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<\\|", "a<|b", "\\n", None, "<\\\\|im_start|>x\n", "ok"]
    rows = [(i, t, role, text) for i, role in enumerate(["user", "assistant", "we\nird\\n<|", None, "a\x00b", "\\\\n\\", "\\\n"]) for t, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", secret_scan.F.lit(1))
    for row in chat_format.formatted(frame).collect():
        assert row.identical and [t.text for t in row.turns] == [x or "" for x in texts]


def test_decontamination_with_many_automata(spark, monkeypatch):
    words = [f"k{i % 23}x{i % 7}" for i in range(400)]
    items = [(f"i{j}", " ".join(words[j : j + n])) for j, n in ((0, 20), (30, 5), (90, 1), (50, 40), (52, 13), (60, 14))] + [("n", None), (None, "z")]
    texts = [(i, " ".join(words[i * 9 : i * 9 + 30] + ["gap"] + words[:15])) for i in range(20)] + [(50, None), (51, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("items", secret_scan.F.lit("x"))
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    windows = defaultdict(set)
    for name, text in items:
        found = (text or "").split() if name else []
        for i in range(max(len(found) - 12, bool(found))):
            windows[tuple(found[i : i + 13])].add(name)
    want = {}
    for i, text in texts:
        found, hit, names = (text or "").split(), set(), set()
        for window, own in windows.items():
            for j in range(len(found) - len(window) + 1):
                if tuple(found[j : j + len(window)]) == window:
                    hit.update(range(j, j + len(window)))
                    names |= own
        want[i] = (len(found), len(hit), sorted(names))
    for bound in (decontaminate.AUTOMATON_WORDS, 20):
        monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", bound)
        got = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in decontaminate.scanned(frame, benchmark).collect()}
        assert got == want
    assert decontaminate.clean_documents(frame, benchmark).columns == frame.columns


def test_empty_tables(spark, hard):
    none = hard.limit(0)
    for made in (ngram_join.near_duplicates(none), suffix_dedup.deduplicated(none), bpe.encoded(none, VOCABULARY), secret_scan.found(none), quality_rules.ledger(none), line_dedup.deduplicated(none)):
        assert made.count() == 0
    benchmark = spark.createDataFrame([], "item_id string, text string")
    assert {r.n_hit for r in decontaminate.scanned(hard, benchmark).collect()} == {0}
    assert decontaminate.scanned(none, benchmark).count() == 0


def test_pipeline_stages(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, SF)
        assert after.columns == frame.columns
    tokens = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < len(tokens) <= len(docs) and tokens.doc_id.is_unique
    assert (tokens.ids.map(len) == tokens.n_tokens).all()
