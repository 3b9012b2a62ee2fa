"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions near hits, then checksums.

One automaton with all keywords reads each chunk of texts once. A regular expression is tried only where a keyword begins,
anchored there. Runs of hexadecimal digits have no keyword; their pattern searches by itself. Kinds with a
checksum in the token are kept only if it holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.text_arrays import chunks

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Tokens of 30 random characters and the six base-62 digits of their CRC-32.
CHECKED = {"github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: In the order that decides between spans with the same start.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "api_key", "apikey"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
}
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _checksum(token: bytes) -> bool:
    """Whether the last six characters are the CRC-32 of the 30 before, in base 62."""
    value, digits = zlib.crc32(token[-36:-6]), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = DIGITS[digit] + digits
    return digits.encode() == token[-6:]


def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (len(word), KINDS.index(kind)))
    machine.make_automaton()
    return machine


def _near(data: bytes, kind: int, begin: int, stop: int) -> tuple[int, bool]:
    """End of the match of a kind's pattern that begins at `begin` (0: none), and whether it counts."""
    name = KINDS[kind]
    pattern = ASSIGN if name == "assign" else ACCESS if name == "access" else CHECKED[name]
    found = pattern.match(data, begin, stop)
    if not found:
        return 0, False
    if name == "assign":
        return found.end(), len(found[2]) >= 6
    if name == "access":
        return found.end(), found.end() - begin >= 20
    return found.end(), _checksum(found[0])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = _automaton()
    for batch in batches:
        for chunk in chunks(batch):
            data = chunk.data.tobytes()
            hits = sorted((end + 1 - length, kind, end + 1) for end, (length, kind) in machine.iter(data.lower().decode("latin-1")))
            spans: dict[int, list[tuple[int, int, int]]] = {}
            rows = np.searchsorted(chunk.bounds, [x[0] for x in hits], "right") - 1 if hits else []
            past: dict[tuple[int, int], int] = {}
            for (begin, kind, keyword_end), row in zip(hits, map(int, rows), strict=True):
                stop = int(chunk.bounds[row + 1])
                if keyword_end > stop or begin < past.get((row, kind), 0):
                    continue
                end, counts = _near(data, kind, begin, stop)
                if end:
                    # A match that does not count still takes its characters.
                    past[row, kind] = end
                if counts:
                    spans.setdefault(row, []).append((begin, kind, end))
            for found in HEX.finditer(data):
                begin = found.start()
                row = int(np.searchsorted(chunk.bounds, begin, "right")) - 1
                # A run may go over into the next texts.
                while begin < found.end():
                    stop = min(int(chunk.bounds[row + 1]), found.end())
                    if stop - begin >= 24:
                        spans.setdefault(row, []).append((begin, 2, stop))
                    begin, row = stop, row + 1
            out: list = [[]] * len(chunk)
            for row, own in spans.items():
                low = int(chunk.bounds[row])
                starts = (chunk.data[low : int(chunk.bounds[row + 1])] & 0xC0) != 0x80
                points = np.concatenate(([0], np.cumsum(starts))).tolist()
                out[row] = [{"start": points[a - low], "kind": k, "end": points[b - low]} for a, k, b in sorted(own)]
            rest = pa.Table.from_batches([batch.slice(chunk.first, len(chunk))]).drop_columns(["text"])
            kind_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            yield from rest.append_column("spans", pa.array(out, kind_type)).to_batches()


def found(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id and `spans`, an array of (start, kind, end) by start, then kind.

    Offsets are code points, the end is exclusive, `kind` is the place in KINDS. Matches of one kind do not overlap;
    matches of different kinds may. Null and empty texts have no spans. Texts of any length are read whole; repeated
    rows are scanned one by one; an empty table gives no rows; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id long, spans {SPANS}")


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in KINDS]), kind + 1)


def as_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_kind(spans: Column, *kinds: str) -> Column:
    wanted = [KINDS.index(kind) for kind in kinds]
    return F.filter(spans, lambda s: s["kind"].isin(wanted))


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every secret in `text` replaced by [SECRET] and `n_chars` counted anew; no row goes.

    Overlapping spans are replaced as one. A null text stays null. Other columns stay as they are; `n_chars` is
    only set where the table has it.
    """
    names = docs.columns
    place = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            only = pa.RecordBatch.from_arrays([batch.column("text")], names=["text"]).append_column("row", pa.array(range(len(texts)), pa.int64()))
            for part in _scan(iter([only])):
                for row, spans in zip(part.column("row").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    if spans:
                        texts[row] = _cut(texts[row], spans)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            if "n_chars" in names:
                at = names.index("n_chars")
                old = batch.column(at).to_pylist()
                changed = batch.column(place).to_pylist()
                counts = [n if a == b else len(b) for n, a, b in zip(old, changed, texts, strict=True)]
                columns[at] = pa.array(counts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(work, docs.schema)


def _cut(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for span in spans:
        if span["end"] <= at:
            continue
        if span["start"] >= at:
            out.append(text[at : span["start"]])
            out.append("[SECRET]")
        at = span["end"]
    out.append(text[at:])
    return "".join(out)
