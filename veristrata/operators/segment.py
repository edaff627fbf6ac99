"""Sentence segmentation with exact offsets.

Offsets are running sums within a text, so a plan of built-in expressions would have to explode the pieces and shuffle
them for a window; a scan in Arrow batches reads each text once where it lies and shuffles nothing.

Rules. Terminators end a segment together with the terminators and closing marks that follow, except a single dot after
an abbreviation. A control character ends a segment and belongs to none. Headings, rules and fences count at line
starts only: the text before one is a segment, a heading's text is one up to the end of its line, rules and fence lines
are dropped. Line breaks end nothing. A text that ends on an abbreviation's dot loses its last, unfinished segment.

Defined cases: null and empty texts have no segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.functions import text as T

#: Terminators, marks that close after them, and abbreviations (lower case, without the last dot).
TERMINATORS = ".!?…。！？"
CLOSERS = "\"')]}"
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs etc e.g i.e cf al fig vol pp approx inc ltd co u.s u.k".split())

_INDENT = "[ \\t\u00a0]"
_BLOCK = re.compile(rf"^{_INDENT}*(?:(?P<marks>#{{1,6}})(?={_INDENT}\S)(?P<heading>[^\n]*)|(?:-{{3,}}|\*{{3,}}|_{{3,}})[^\S\n]*$|(?:```|~~~)[^\n]*)", re.M)
_STOP = re.compile(rf"(?P<control>[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x85\x9f])|[{TERMINATORS}][{TERMINATORS}{re.escape(CLOSERS)}]*")
_LEFT = re.compile(r"[^\W_]|[._']")


def _token_before(text: str, dot: int) -> str:
    start = dot
    while start and dot - start < 8 and (text[start - 1].isalnum() or text[start - 1] in "._'"):
        start -= 1
    return text[start:dot]


def _trimmed(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    piece = text[a:b]
    body = piece.strip()
    if body:
        at = a + len(piece) - len(piece.lstrip())
        yield at, at + len(body)


def _prose(text: str, a: int, b: int, last: bool) -> Iterator[tuple[int, int]]:
    """Segments of a stretch without block lines; last: it ends the text."""
    start = a
    for m in _STOP.finditer(text, a, b):
        if m.lastgroup == "control":
            yield from _trimmed(text, start, m.start())
        elif m.end() - m.start() == 1 and m.group() == "." and _token_before(text, m.start()).lower() in ABBREVIATIONS:
            if last and m.end() == b:
                return
            continue
        else:
            stop = m.end()
            if text[m.start()] == "." and _token_before(text, m.start()).lower() in ABBREVIATIONS:
                # the dot itself ends nothing; the run counts from its next terminator
                rest = next((i for i in range(m.start() + 1, stop) if text[i] in TERMINATORS), None)
                if rest is None:
                    if last and stop == b and stop == m.start() + 1:
                        return
                    continue
                if text[rest] == "." and rest + 1 == stop and _token_before(text, rest).lower() in ABBREVIATIONS:
                    continue
            yield from _trimmed(text, start, stop)
        start = m.end()
    yield from _trimmed(text, start, b)


def spans(text: str | None) -> Iterator[tuple[int, int]]:
    """Start and end of each segment in order."""
    if not text:
        return
    at = 0
    for m in _BLOCK.finditer(text):
        yield from _prose(text, at, m.start(), False)
        at = m.end()
        if m.group("marks"):
            yield from _trimmed(text, m.start("heading"), m.end("heading"))
    yield from _prose(text, at, len(text), True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ordinals, starts, ends, texts = [], [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for n, (a, b) in enumerate(spans(text)):
                keys.append(key)
                ordinals.append(n)
                starts.append(a)
                ends.append(b)
                texts.append(text[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(ordinals, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], names=["key", "ordinal", "start_offset", "end_offset", "text"])


def segments(sources: DataFrame, key: str = "uri", content: str = "content") -> DataFrame:
    """key, ordinal, start_offset, end_offset, text of every segment."""
    kind = sources.schema[key].dataType.simpleString()
    out = sources.select(key, content).mapInArrow(_scan, f"key {kind}, ordinal int, start_offset int, end_offset int, text string")
    return out.withColumnRenamed("key", key)


def propositions(found: DataFrame) -> DataFrame:
    """The segments that can be claims; ordinals stay those of all segments."""
    return found.where(T.is_proposition(F.col("text")))
