"""P7: personal information inside free text.

Method: a character-level bidirectional LSTM with CRF transitions (:mod:`veristrata.llm.tagger`, trained in numpy by
:mod:`veristrata.llm.pii_train` from labelled spans; its weights are part of the package) tags overlapping windows.
Windows are reconciled over the whole text: a span at a window's cut edge gives way to the neighbour's, spans of one
kind that overlap are one, and of different kinds the longer wins. These spans are the places. Only their edges are
settled after that (:mod:`veristrata.llm.pii_rules`): a span that means the same place as a form of its kind takes the
form's edges, any other one ends at whole words and leaves titles and punctuation out. No form adds or drops a place.

Defined cases. Null and empty texts have no places and are given back as they are. Offsets count code points. Rows with
one id are one record (the smallest text counts if its deliveries differ); a null id is no record. Texts of any length
are read whole, window by window. Extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm import pii_rules
from veristrata.llm.tagger import KINDS, Tagger, classes_of, spans_of

#: Windows overlap by more than the longest span, so each span lies whole in one of them.
WINDOW, OVERLAP = 1024, 112
ROWS = 512
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def windows_of(n: int) -> list[tuple[int, int]]:
    if n <= WINDOW:
        return [(0, n)]
    step = WINDOW - OVERLAP
    return [(a, min(a + WINDOW, n)) for a in range(0, n - OVERLAP, step)]


def reconciled(spans: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int]]:
    """Spans (start, end, kind, whole) of all windows of a text as one list; whole is false at a window's cut edge."""
    whole = [s for s in spans if s[3]]
    cut = [s for s in spans if not s[3] and not any(a < s[1] and s[0] < b and k == s[2] for a, b, k, _ in whole)]
    out: list[tuple[int, int, int]] = []
    for a, b, k, _ in sorted(whole + cut):
        if out and a < out[-1][1]:
            x, y, z = out[-1]
            if z == k:
                out[-1] = (x, max(b, y), k)
            elif b - a > y - x:
                out[-1] = (a, b, k)
        else:
            out.append((a, b, k))
    return out


def tag_texts(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Proposed spans of each text. Equal windows are tagged once."""
    jobs: dict[bytes, list[tuple[int, int, int, int]]] = {}
    for i, text in enumerate(texts):
        ids = classes_of(text)
        for a, b in windows_of(len(ids)):
            jobs.setdefault(ids[a:b].tobytes(), []).append((i, a, b, len(ids)))
    found: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    keys = sorted(jobs, key=len, reverse=True)
    for at in range(0, len(keys), ROWS):
        own = [np.frombuffer(k, np.int32) for k in keys[at : at + ROWS]]
        own = [x for x in own if len(x)]
        if not own:
            continue
        lengths = np.array([len(x) for x in own])
        ids = np.zeros((len(own), lengths[0]), np.int32)
        for row, x in zip(ids, own):
            row[: len(x)] = x
        for x, tags in zip(own, tagger.decode(tagger.emissions(ids, lengths), lengths)):
            for s, e, k in spans_of(tags):
                for i, a, b, n in jobs[x.tobytes()]:
                    found[i].append((a + s, a + e, k, (s > 0 or a == 0) and (a + e < b or b == n)))
    return [reconciled(spans) for spans in found]


def settled(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """The spans with their edges settled; where two come to overlap the first one stays whole."""
    out: list[tuple[int, int, str]] = []
    for a, b, k in sorted(spans):
        a, b = pii_rules.edges(text, a, b, KINDS[k])
        if out:
            a = max(a, out[-1][1])
        if a < b and not text[a:b].isspace():
            out.append((a, b, KINDS[k]))
    return out


def personal_places(tagger: Tagger, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    texts = [t or "" for t in texts]
    return [settled(text, spans) for text, spans in zip(texts, tag_texts(tagger, texts))]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tagger = Tagger.load(WEIGHTS)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            ids, rows = part.column(0).to_pylist(), []
            for record, places in zip(ids, personal_places(tagger, part.column(1).to_pylist())):
                rows += [(record, *p) for p in places]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], names=["record_id", "start_offset", "end_offset", "kind"])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tagger = Tagger.load(WEIGHTS)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            texts = part.column(1).to_pylist()
            out, n = [], []
            for text, places in zip(texts, personal_places(tagger, texts)):
                if text is None:
                    out.append(None)
                    n.append(0)
                    continue
                pieces, last = [], 0
                for a, b, kind in places:
                    pieces += [text[last:a], PLACEHOLDERS[kind]]
                    last = b
                out.append("".join([*pieces, text[last:]]))
                n.append(len(places))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["record_id", "text", "n_places"])


def _records(table: DataFrame, text_col: str) -> DataFrame:
    """One row per record, spread evenly: a task's cost is its characters."""
    return table.where(F.col("id").isNotNull()).groupBy(F.col("id").cast("string").alias("id")).agg(F.min(text_col).alias("text"))


def places(table: DataFrame, tab: str, text_col: str) -> DataFrame:
    """tab, record_id, start_offset, end_offset, kind of every place with personal information."""
    schema = "record_id string, start_offset int, end_offset int, kind string"
    return _records(table.where(F.length(text_col) > 0), text_col).mapInArrow(_find, schema).select(F.lit(tab).alias("tab"), "record_id", "start_offset", "end_offset", "kind")


def masked(table: DataFrame, tab: str, text_col: str) -> DataFrame:
    """tab, record_id, text with placeholders, n_places of every record."""
    return _records(table, text_col).mapInArrow(_mask, "record_id string, text string, n_places int").select(F.lit(tab).alias("tab"), "record_id", "text", "n_places")
