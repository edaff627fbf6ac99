"""P5: stretches of at least SPAN characters that a record shares with another one of its table.

A position is shared when a window of SPAN characters over it occurs in another record, so it is enough to decide
every window. Method: repeated phrases and automata. Of each window one phrase of PHRASE characters is chosen, the one with
the smallest hash (the leftmost of equal ones); equal windows choose the same phrase at the same place. Phrases that
stand in one text only can't lie in a shared window. The others are dealt into shards in the order of their hashes, and
every stretch of a text around a place of one of them is streamed past its shard:

- the phrases of a shard that occur, character by character, in two texts or more are confirmed;
- they are compiled into the shard's Aho-Corasick automaton, which locates every occurrence of theirs in the stretches;
- the windows over located occurrences are compared by a 64-bit hash of random code-point values.

A shard is a batch of whole phrases, so an automaton's size is bounded and no text is streamed past a shard that it has
no phrase of: all automata together read each text about SPAN / PHRASE times, however many they are. No phrase is left out
because it is rare or frequent: one with HOT places or more has its windows compared by an aggregation over all tasks.

Equal texts are one text before any comparing; a text that several records hold is shared as a whole.

Defined cases. Rows with one id are one record; where its deliveries differ the smallest text counts. A null id is no
record; null texts and texts below SPAN characters have no stretch. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.operators.skew import join_group_facts
from veristrata.session import written

SPAN, PHRASE = 80, 32
#: Phrases that start in a window, and characters that a window may have before its phrase.
STARTS, BEFORE = SPAN - PHRASE + 1, SPAN - PHRASE
#: Places of a phrase from which its windows are compared over all tasks; the result is the same.
HOT = 20_000

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _hashes(codes: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length the hashes of all stretches of so many characters, by joining stretches of powers of two."""
    power, size, parts, out = _BASE, 1, {}, []
    step = _mixed(codes.astype(np.uint64) + _BASE)
    while size <= max(lengths):
        parts[size] = (step, power)
        step = step[: max(len(step) - size, 0)] * power + step[size:]
        power, size = np.uint64(int(power) ** 2 % (1 << 64)), size * 2
    for length in lengths:
        whole, done = None, 0
        for s in sorted(parts, reverse=True):
            if length & s:
                h, p = parts[s]
                whole = h if whole is None else whole[: max(len(h) - done, 0)] * p + h[done:]
                done += s
        out.append(whole[: max(len(codes) - length + 1, 0)])
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and where each begins (the end of the last one too)."""
    at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def _owners(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """The text of each of the first n positions, -1 where a stretch of so many characters doesn't fit into it."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    return np.where(np.arange(n) + length <= at[owner + 1], owner, -1) if n else owner


def phrases(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and hash of every phrase that a window chooses."""
    codes, at = _codes(texts)
    if len(codes) < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    low = _mixed(_hashes(codes, PHRASE)[0])
    value, place, size = low, np.arange(len(low)), 1
    while size < STARTS:
        s = min(size, STARTS - size)
        take = value[s:] < value[:-s]
        value, place = np.where(take, value[s:], value[:-s]), np.where(take, place[s:], place[:-s])
        size += s
    inside = _owners(at, SPAN, len(value))
    chosen = np.unique(place[inside >= 0])
    owner = np.repeat(np.arange(len(texts)), np.diff(at))[chosen]
    return owner, chosen - at[owner], low[chosen].view(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, pos, h = phrases(batch.column(2).to_pylist())
        k1, k2 = (batch.column(i).to_numpy()[owner] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k1), pa.array(k2), pa.array(pos.astype(np.int32))], names=["h", "k1", "k2", "pos"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, marks = batch.column(2).to_pylist(), batch.column(3)
        many = np.diff(marks.offsets.to_numpy())
        owner, flat = np.repeat(np.arange(len(texts)), many), marks.flatten()
        pos = flat.field("pos").to_numpy()
        first = np.maximum(pos - BEFORE, 0)
        around = [texts[o][a : p + SPAN] for o, a, p in zip(owner.tolist(), first.tolist(), pos.tolist())]
        k1, k2 = (pa.array(batch.column(i).to_numpy()[owner]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([flat.field("h"), flat.field("hot"), k1, k2, flat.field("pos"), pa.array(first.astype(np.int32)), pa.array(around, pa.string())], names=["h", "hot", "k1", "k2", "pos", "first", "around"])


def _located(around: list[str], phrase_at: np.ndarray, text: np.ndarray, confirm: bool) -> list[tuple[int, int]]:
    """Row and start of every occurrence of the shard's phrases; confirm: only of those that two texts hold."""
    first: dict[str, int] = {}
    phrases: set[str] = set()
    for row, at, own in zip(around, phrase_at.tolist(), text.tolist()):
        phrase = row[at : at + PHRASE]
        if not confirm or first.setdefault(phrase, own) != own:
            phrases.add(phrase)
    if not phrases:
        return []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in phrases:
        automaton.add_word(phrase)
    automaton.make_automaton()
    return [(i, end - PHRASE + 1) for i, row in enumerate(around) for end, _ in automaton.iter(row)]


def _windows(batch: pa.RecordBatch, confirm: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in its text and hash of each window of the column around that holds a located phrase."""
    around, first = batch.column("around").to_pylist(), batch.column("first").to_numpy()
    hits = _located(around, batch.column("pos").to_numpy() - first, _text_names(batch), confirm)
    codes, at = _codes(around)
    h = _hashes(codes, SPAN)[0]
    holds = np.zeros(len(codes) + 1, np.int64)
    if hits:
        row, start = (np.array(x) for x in zip(*hits))
        np.add.at(holds, at[row] + np.maximum(start - BEFORE, 0), 1)
        np.add.at(holds, at[row] + start + 1, -1)
    owner = _owners(at, SPAN, len(h))
    good = np.flatnonzero((owner >= 0) & (np.cumsum(holds)[: len(h)] > 0))
    row = owner[good]
    return row, good - at[row] + first[row], h[good]


def _text_names(batch: pa.RecordBatch) -> np.ndarray:
    return _mixed(batch.column("k1").to_numpy().view(np.uint64)) ^ batch.column("k2").to_numpy().view(np.uint64)


def _shared(batch: pa.RecordBatch) -> pa.RecordBatch:
    """k1, k2, a, b of the stretches whose windows occur in two texts of the batch, which holds whole phrases."""
    row, start, h = _windows(batch, True)
    k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
    text = _text_names(batch)
    order = np.argsort(h)
    begin = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.empty(0, np.int64)
    hit = np.zeros(len(h), bool)
    if len(h):
        t = text[row][order]
        hit[order] = np.repeat(np.minimum.reduceat(t, begin) != np.maximum.reduceat(t, begin), np.diff(np.r_[begin, len(h)]))
    row, start = row[hit], start[hit]
    cut = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)] if len(row) else np.empty(0, bool)
    a = np.flatnonzero(cut)
    b = np.r_[a[1:], len(row)][: len(a)] - 1
    return pa.RecordBatch.from_arrays([pa.array(k1[row[a]]), pa.array(k2[row[a]]), pa.array(start[a].astype(np.int32)), pa.array((start[b] + SPAN).astype(np.int32))], names=["k1", "k2", "a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by phrase; the last phrase of a batch waits for the next batch."""
    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        if not rows.num_rows:
            continue
        h = rows.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            yield _shared(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None:
        yield _shared(held)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, start, h = _windows(batch, False)
        k1, k2 = (batch.column(c).to_numpy()[row] for c in ("k1", "k2"))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k1), pa.array(k2), pa.array(start.astype(np.int32))], names=["w", "k1", "k2", "a"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in batch.column(2).to_pylist():
            runs = []
            for s in sorted((x["a"], x["b"]) for x in spans):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            out.append([{"a": a, "b": b} for a, b in runs])
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind), batch.column(3)], names=["k1", "k2", "runs", "n"])


_PLACE = "h long, k1 long, k2 long, pos int"
_RUN = "k1 long, k2 long, a int, b int"


def spans(table: DataFrame, tab: str, column: str, hot: int = HOT) -> DataFrame:
    """tab, record_id, start_offset, end_offset of each longest run of shared positions."""
    text = table.where("id IS NOT NULL").groupBy("id").agg(F.min(column).alias("text")).where(F.length("text") >= SPAN)
    keyed = written(text.select("id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), F.col("text")).alias("k2"), "text"), "shared-records")
    texts = written(keyed.groupBy("k1", "k2").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n")), "shared-texts")
    places = written(texts.select("k1", "k2", "text").mapInArrow(_places, _PLACE), "shared-places")
    name = F.struct("k1", "k2")
    repeated = places.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("x"), F.max(name).alias("y")).where("x <> y").select("h", "n")
    marks = join_group_facts(places, repeated, ["h"], "n").groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "h", (F.col("n") >= hot).alias("hot"))).alias("marks"))
    around = texts.join(marks, ["k1", "k2"]).select("k1", "k2", "text", "marks").mapInArrow(_around, "h long, hot boolean, k1 long, k2 long, pos int, first int, around string")
    around = written(around, "shared-around")
    found = around.where("NOT hot").repartition("h").sortWithinPartitions("h").mapInArrow(_compare, _RUN)
    windows = around.where("hot").mapInArrow(_spread, "w long, k1 long, k2 long, a int")
    common = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("x"), F.max(name).alias("y")).where("x <> y").select("w", "n")
    far = join_group_facts(windows, common, ["w"], "n").select("k1", "k2", "a", (F.col("a") + SPAN).cast("int").alias("b"))
    whole = texts.where("n > 1").select("k1", "k2", F.lit(0).alias("a"), F.length("text").alias("b"))
    every = found.unionByName(far).unionByName(whole).groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    runs = every.join(texts.select("k1", "k2", "n"), ["k1", "k2"]).select("k1", "k2", "spans", "n").mapInArrow(_merged, "k1 long, k2 long, runs array<struct<a:int,b:int>>, n long")
    held = join_group_facts(keyed.select("id", "k1", "k2"), runs, ["k1", "k2"], "n")
    return held.select(F.lit(tab).alias("tab"), F.col("id").alias("record_id"), F.explode("runs").alias("r")).select("tab", "record_id", F.col("r.a").alias("start_offset"), F.col("r.b").alias("end_offset"))
