"""P10: reading level of each document by a Rasch-style latent difficulty model.

Model: every distinct word of a document is a response. Documents have a level t, words a difficulty s; the chance
that a response of a document of level t is word w is proportional to p_w * exp(s_w * t). As in Rasch's model the sum
of the difficulties of its words is all that a document's level depends on:
    t = sum(s_w - m) / (n * v + 1 / PRIOR)        m, v: mean and variance of difficulty under p
and a word's difficulty is how far the levels of the documents it occurs in lie from the mean, shrunk by KAPPA:
    s_w = (sum of t over w's documents - n_w * mean t) / (variance of t * (n_w + KAPPA))
The two steps alternate over all documents until no level moves by TOLERANCE or more in one alternation. Every second
alternation is followed by one from difficulties extrapolated from the last two changes (squared extrapolation), which reaches the
same fixed point in fewer passes. Graded documents are held at
their standardised mean grade (raters' offsets taken out). From the second step on every other document counts by its
certainty, UNGRADED * n * v / (n * v + 1 / PRIOR): one without a known word has none yet and gets it as its words become
known. The levels of these documents are centred and, where they spread more than the prior, scaled to it, as nothing
else holds the scale of a group without grades. At the end levels are mapped to grades by a line fitted on the graded
documents and kept within 1 and 5.

Every distinct word has its own parameter: words are named by 64-bit hashes (two of a million words share one with a
chance of 3e-8). Neither documents nor parameters ever lie in one place. Documents are held in chunks of about
CHUNK_ITEMS items, whose words are numbered within the chunk; the hashes are divided into ranges, and the parameters
of a range's words lie in one partition. In a pass each chunk gets the difficulties of its own words from the ranges
and returns the sums of these words to them. Chunks and the routes between chunks and ranges are shuffled once and read
from there in every pass; only difficulties and sums move again. The driver sees a few numbers for each range.

Defined cases. Null and empty texts have no words: they get the mean of the grades and n_words 0. Grades that are
null or outside 1 to 5 and those of unknown documents don't count; of repeated rows of one document and rater the
mean counts. With no usable grade the scale has no anchor and every level is null. Repeated documents are each given
a level. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.session import shared_dir, written

CHUNK_ITEMS = 1 << 21
KAPPA, PRIOR, UNGRADED = 2.0, 1.0, 0.3
#: Standard deviations of level. MOST_ROUNDS only guards against a fit that never settles, which raises an error.
TOLERANCE, MOST_ROUNDS = 0.01, 500
#: A chunk of documents, its words' hashes in order, where the ranges cut them, and what is only needed for the result.
_CHUNK = "chunk int, at binary, items binary, grade binary, cuts binary, words binary, rows binary"


#: ASCII letters in lower case and digits; other ASCII characters end a word. Bytes of other characters stay.
_ASCII = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(256))
#: Pieces whose names are remembered: so many, of up to so many bytes each.
_KNOWN, _LONG = 300_000, 64


def _name(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)


class _Names(dict):
    """By what lies between ASCII characters that end words: the name of its word or, with other characters, those of its words."""

    def __init__(self) -> None:
        import regex

        self.find = regex.compile(r"[\p{L}\p{N}]+").findall

    def __missing__(self, piece: bytes) -> int | tuple[int, ...]:
        if piece.isascii():
            names = _name(piece)
        else:
            names = tuple(_name(word.lower().encode()) for word in self.find(piece.decode()))
        if len(piece) <= _LONG:
            if len(self) >= _KNOWN:
                self.clear()
            self[piece] = names
        return names


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _Names()
    for batch in batches:
        flat, ends = array("q"), [0]
        for text in batch.column(1).to_pylist():
            if text:
                data = text.encode()
                own = map(names.__getitem__, set(data.translate(_ASCII).split()))
                if not data.isascii():
                    own = {name for found in own for name in (found if type(found) is tuple else (found,))}
                flat.extend(own)
            ends.append(len(flat))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["doc_id", "items", "kept"])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _chunks(parts: int, ranges: int):
    """Items as chunks; those of one partition stay together, as chunk numbers are equal to its number modulo parts."""
    edges = np.array([-(1 << 63) + i * (1 << 64) // ranges for i in range(1, ranges)], np.int64)

    def chunk(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        lists = pa.concat_arrays([batch.column(1) for batch in held])
        at = lists.offsets.to_numpy().astype(np.int64)
        names, items = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        grade = np.concatenate([batch.column(3).to_numpy(zero_copy_only=False) for batch in held])
        cuts = np.r_[0, np.searchsorted(names, edges), len(names)].astype(np.int64)
        data = [x.tobytes() for x in (at - at[0], items.astype(np.int32), grade, cuts, names)]
        rows = _packed(pa.Table.from_batches([batch.select([0, 2]) for batch in held]))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([x], pa.binary()) for x in (*data, rows))], names=["chunk", "at", "items", "grade", "cuts", "words", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(1).flatten())
            if size >= CHUNK_ITEMS:
                yield chunk(number, held)
                number, held, size = number + parts, [], 0
        if held:
            yield chunk(number, held)

    return run


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: mean of the raters' grades less their offsets."""
    valid = labels.where("grade BETWEEN 1 AND 5 AND doc_id IS NOT NULL").groupBy("doc_id", "rater").agg(F.avg("grade").alias("g"))
    mean = valid.groupBy("doc_id").agg(F.avg("g").alias("m"))
    offset = valid.join(mean, "doc_id").groupBy("rater").agg(F.avg(F.col("g") - F.col("m")).alias("o"))
    return valid.join(offset, valid["rater"].eqNullSafe(offset["rater"])).groupBy("doc_id").agg(F.avg(F.col("g") - F.col("o")).alias("grade"))


def _same(key: int) -> int:
    return key


@functools.cache
def _set_aside() -> None:
    """Once in a worker: it collects garbage after every task, which would walk through all loaded modules, again in each short task of a pass."""
    gc.freeze()


def _own(part: Iterator) -> dict[str, list]:
    """A range's records by kind."""
    _set_aside()
    own = defaultdict(list)
    for _, (kind, *rest) in part:
        own[kind].append(rest)
    return own


def _cut(row) -> Iterator:
    """A chunk's words for each range."""
    cuts, names = np.frombuffer(row["cuts"], np.int64), np.frombuffer(row["words"], np.int64)
    for key in range(len(cuts) - 1):
        yield key, ("words", key, row["chunk"], names[cuts[key] : cuts[key + 1]])


def _route(part: Iterator) -> Iterator:
    """Where the words of each chunk stand among the range's words."""
    if words := sorted(_own(part)["words"], key=lambda x: x[1]):
        names, place = np.unique(np.concatenate([x[2] for x in words]), return_inverse=True)
        ends = np.cumsum([len(x[2]) for x in words])[:-1]
        yield words[0][0], ("route", words[0][0], len(names), [(x[1], p) for x, p in zip(words, np.split(place.astype(np.int32), ends), strict=True)])


def _pieces(kind: str, parts: int):
    """The difficulties of a range's words for each chunk."""

    def run(part: Iterator) -> Iterator:
        own = _own(part)
        for key, _, route in own["route"]:
            s = own[kind][0][0]
            for chunk, place in route:
                yield chunk % parts, (kind, chunk, key, s[place])

    return run


class Words:
    """Difficulties s of all words, unknown ones NaN, in the partitions of rdd; their mean and variance v; the number of known ones.

    The difficulty that counts is s less the mean, and 0 for unknown words.
    """

    def __init__(self, kind: str, rdd: RDD) -> None:
        """rdd: (range, (kind, s, n, numbers)); numbers are those of _numbers and, alike in all ranges, the pass's facts and change."""
        self.kind, self.rdd = kind, rdd
        found = rdd.map(lambda x: (x[1][3], x[1][4])).collect()
        weight, s, square, known, moved, moved_square = np.sum([x[0] for x in found], axis=0)
        self.facts, self.change = found[0][1]
        self.known, self.weight = int(known), max(weight, 1e-9)
        self.mean = s / self.weight
        self.v = max(square / self.weight - self.mean**2, 1e-9)
        #: how far levels of long documents may have moved, from the change of difficulties alone
        self.moved = max(moved_square / self.weight - 2 * self.mean * moved / self.weight + self.mean**2 * (weight > 0), 0.0) ** 0.5 / self.v

    def shared(self) -> tuple[str, float, float]:
        """What tasks need of it, besides the pieces."""
        return self.kind, self.mean, self.v


def _centred(s: np.ndarray, mean: float) -> np.ndarray:
    return np.where(np.isnan(s), 0.0, s - mean)


def _numbers(n: np.ndarray, s: np.ndarray, before: np.ndarray | float = 0.0) -> np.ndarray:
    """Weight, sum and square of difficulties, known words, and sum and square of what they moved since before."""
    level, known = np.nan_to_num(s.astype(np.float64)), ~np.isnan(s)
    d = np.where(known, level - before, 0.0)
    return np.array([n.sum(), (n * level).sum(), (n * level * level).sum(), known.sum(), (n * d).sum(), (n * d * d).sum()])


def _levels_of(at: np.ndarray, items: np.ndarray, s: np.ndarray, mean: float, v: float) -> tuple[np.ndarray, np.ndarray]:
    """Level and number of known words of each document."""
    many, known = np.diff(at), ~np.isnan(s)
    n, total = many.astype(np.float64), np.zeros(len(many))
    if not known.all():
        n -= np.bincount(np.searchsorted(at, np.flatnonzero(~known[items]), "right") - 1, minlength=len(many))
    own = many > 0
    if own.any():
        total[own] = np.add.reduceat(_centred(s, mean)[items], at[:-1][own], dtype=np.float64)
    return total / (n * v + 1 / PRIOR), n


def _read(part: Iterator) -> Iterator:
    """Chunks (number, at, items, grade, cuts) with the difficulties sent to them, and the rows that stand before them."""
    _set_aside()
    sent, rows = defaultdict(list), {}
    for _, (kind, chunk, *rest) in part:
        if kind == "docs":
            at, items, grade, cuts = (np.frombuffer(x, t) for x, t in zip(rest, (np.int64, np.int32, np.float64, np.int64), strict=True))

            def difficulties(name: str, chunk=chunk, cuts=cuts) -> np.ndarray:
                s = np.empty(cuts[-1], np.float32)
                for key, x in sent.pop((name, chunk)):
                    s[cuts[key] : cuts[key + 1]] = x
                return s

            yield chunk, at, items, grade, cuts, difficulties, rows.pop(chunk, None)
        elif kind == "rows":
            rows[chunk] = rest[0]
        else:
            sent[kind, chunk].append(rest)


def _sums(kind: str, words, before, mean: float, sd: float):
    """Per chunk and range the weighted documents and levels of the chunk's words, with FACTS of all its documents.

    Without words: graded documents at their grades. With words: the others at their levels; graded ones only count in
    the greatest change of a level since ``before``, and in the line from levels to grades.
    """

    def run(part: Iterator) -> Iterator:
        for chunk, at, items, grade, cuts, difficulties, _ in _read(part):
            many, pinned, facts, change = np.diff(at), ~np.isnan(grade), np.zeros(11), 0.0
            anchor = (np.nan_to_num(grade) - mean) / sd
            if words is None:
                level, sure = anchor, pinned * 1.0
                weight = sure
            else:
                name, m, v = words
                level, seen = _levels_of(at, items, difficulties(name), m, v)
                sure = np.where(pinned, 0.0, seen * v / (seen * v + 1 / PRIOR))
                weight = UNGRADED * sure
                if before is not None and len(level):
                    name, m, v = before
                    change = float(np.abs(level - _levels_of(at, items, difficulties(name), m, v)[0]).max())
            n = np.bincount(items, np.repeat(weight, many), cuts[-1])
            total = np.bincount(items, np.repeat(weight * level, many), cuts[-1])
            for i, x in enumerate((sure, weight * many)):
                facts[3 * i : 3 * i + 3] = x.sum(), (x * level).sum(), (x * level * level).sum()
            x, y = level[pinned], anchor[pinned]
            facts[6:] = len(x), x.sum(), y.sum(), (x * x).sum(), (x * y).sum()
            for key in range(len(cuts) - 1):
                own = slice(cuts[key], cuts[key + 1])
                met, some, more = None, n[own], total[own]
                if np.count_nonzero(some) < len(some) / 2:
                    met = np.flatnonzero(some).astype(np.int32)
                    some, more = some[met], more[met]
                yield key, (kind, chunk, met, some.astype(np.float32), more.astype(np.float32), facts, change)

    return run


class Sums:
    """Of a range's words the weighted documents n and their levels total; facts of all documents; change of levels."""

    def __init__(self, size: int, route: dict[int, np.ndarray], sent: list) -> None:
        self.n, self.total, self.facts, self.change = np.zeros(size), np.zeros(size), np.zeros(11), 0.0
        for chunk, met, n, total, facts, change in sorted(sent, key=lambda x: x[0]):
            place = route[chunk] if met is None else route[chunk][met]
            self.n[place] += n
            self.total[place] += total
            self.facts, self.change = self.facts + facts, max(self.change, change)
        self.items, self.square = self.facts[3:5], self.facts[5]

    def scaled(self) -> Sums:
        """Levels centred and, where they spread more than the prior, scaled to it."""
        weight, level, square = self.facts[:3]
        centre = level / max(weight, 1e-9)
        spread = max(1.0, (max(square / max(weight, 1e-9) - centre**2, 0.0) * PRIOR**-1) ** 0.5)
        weight, level = self.items
        self.total = (self.total - centre * self.n) / spread
        self.items = np.array([weight, (level - centre * weight) / spread])
        self.square = (self.square - 2 * centre * level + centre**2 * weight) / spread**2
        return self


def _estimated(kind: str, before):
    """The difficulties of a range's words from the sums of the graded documents and, where given, of the others."""

    def run(part: Iterator) -> Iterator:
        own = _own(part)
        for key, size, route in own["route"]:
            parts = [Sums(size, dict(route), own["pinned"])]
            if own["others"]:
                parts.append(Sums(size, dict(route), own["others"]).scaled())
            n, total, items, square = (sum(getattr(p, c) for p in parts) for c in ("n", "total", "items", "square"))
            weight = max(items[0], 1e-9)
            centre = items[1] / weight
            var = square / weight - centre**2
            s = np.where(n > 0, (total - n * centre) / (max(var, 1e-9) * (n + KAPPA)), np.nan).astype(np.float32)
            numbers = _numbers(n, s, _centred(own[before[0]][0][0], before[1]) if before else 0.0)
            yield key, (kind, s, n.astype(np.float32), numbers, (parts[-1].facts, parts[-1].change))

    return run


def _curve(part: Iterator, means: tuple[float, float, float]):
    own = _own(part)
    if own["two"]:
        a, b, c = (_centred(own[kind][0][0], mean) for kind, mean in zip(("here", "one", "two"), means, strict=True))
        yield own["two"][0], a, b - a, c - 2 * b + a


def _bend(means: tuple[float, float, float]):
    """Squares of the first and second differences of three successive estimates."""

    def run(part: Iterator) -> Iterator:
        for (_, n, *_), _, r, q in _curve(part, means):
            yield (n * r * r).sum(), (n * q * q).sum()

    return run


def _headed(means: tuple[float, float, float], step: float | None):
    """Where three successive estimates are heading; without a step the last."""

    def run(part: Iterator) -> Iterator:
        part = list(part)
        for (s, n, *_), a, r, q in _curve(iter(part), means):
            if step is not None:
                s = np.where(np.isnan(s), np.nan, a + 2 * step * r + step * step * q).astype(np.float32)
            yield part[0][0], ("here", s, n, _numbers(n.astype(np.float64), s), (np.zeros(11), 0.0))

    return run


class Fit:
    """The alternation over chunks (partitions of docs) and ranges of words (partitions of routes)."""

    def __init__(self, chunks: DataFrame, parts: int, ranges: int, mean: float, sd: float) -> None:
        self.sc, self.parts, self.ranges, self.grade = chunks.sparkSession.sparkContext, parts, ranges, (mean, sd)
        self.docs = chunks.select("chunk", "at", "items", "grade", "cuts").rdd.map(lambda x: (x[0] % parts, ("docs", *x))).partitionBy(parts, _same)
        words = chunks.select("chunk", "cuts", "words").rdd.flatMap(_cut).partitionBy(ranges, _same)
        self.routes = words.mapPartitions(_route).partitionBy(ranges, _same)
        self.pinned = self.sums("pinned", None, None)

    def pieces(self, words: Words) -> RDD:
        return self.sc.union([self.routes, words.rdd]).mapPartitions(_pieces(words.kind, self.parts)).partitionBy(self.parts, _same)

    def sums(self, kind: str, words: Words | None, before: Words | None, *pieces: RDD) -> RDD:
        run = _sums(kind, words and words.shared(), before and before.shared(), *self.grade)
        return self.sc.union([*pieces, self.docs]).mapPartitions(run).partitionBy(self.ranges, _same)

    def words(self, kind: str, before: Words | None, *sums: RDD) -> Words:
        run = _estimated(kind, before and before.shared())
        got = self.sc.union([self.routes, self.pinned, *sums, *([before.rdd] if before else [])]).mapPartitions(run, preservesPartitioning=True)
        return Words(kind, got.persist(StorageLevel.DISK_ONLY))

    def headed(self, here: Words, one: Words, two: Words) -> Words:
        """Extrapolated, cut off from the passes before: its table is in the folder of spark.checkpoint.dir."""
        three, means = self.sc.union([here.rdd, one.rdd, two.rdd]), (here.mean, one.mean, two.mean)
        step = None
        # documents that share no word with the graded ones are reached step by step: nothing is extrapolated till then
        if here.known == two.known:
            r, q = np.sum(three.mapPartitions(_bend(means)).collect(), axis=0) / two.weight
            step = max(1.0, float(r / max(q, 1e-30)) ** 0.5)
        got = three.mapPartitions(_headed(means, step), preservesPartitioning=True).persist(StorageLevel.DISK_ONLY)
        got.checkpoint()
        words = Words("here", got)
        words.rdd = RDD(got._jrdd, self.sc, got._jrdd_deserializer)  # without the objects of earlier passes, which would keep their shuffle files
        return words

    def settled(self) -> tuple[Words, RDD]:
        """The words at which no level moves by TOLERANCE or more, and their pieces."""
        here = self.words("here", None)
        for _ in range(MOST_ROUNDS // 2):
            held = self.pieces(here)
            one = self.words("one", here, self.sums("others", here, None, held))
            near = one.moved < TOLERANCE  # near enough to compare the levels themselves
            pieces = self.pieces(one)
            two = self.words("two", None, self.sums("others", one, here, pieces, held) if near else self.sums("others", one, None, pieces))
            settled = near and two.change < TOLERANCE
            done = [here, one, two]
            if not settled:
                here = self.headed(here, one, two)
            for words in done:
                words.rdd.unpersist()
            # shuffle files of earlier passes are removed when the driver collects its garbage, which it rarely needs to
            gc.collect()
            self.sc._jvm.System.gc()
            if settled:
                one.facts = two.facts  # of the levels at these words
                return one, pieces
        raise RuntimeError(f"levels still change by {two.change} after {MOST_ROUNDS} rounds")


def _apply(words, line: tuple[float, float]):
    def run(part: Iterator) -> Iterator:
        for _, at, items, _, _, difficulties, rows in _read(part):
            name, m, v = words
            level, seen = _levels_of(at, items, difficulties(name), m, v)
            error = 1 / np.sqrt(seen * v + 1 / PRIOR)
            level, error = np.clip(line[0] * level + line[1], 1, 5), abs(line[0]) * error
            doc, kept = pa.ipc.open_stream(rows).read_all().combine_chunks().columns
            yield (_packed(pa.table([doc, pa.array(level), pa.array(error), pa.array(np.diff(at).astype(np.int32)), kept], names=["doc_id", "level", "error", "n_words", "kept"])),)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            yield from pa.ipc.open_stream(data.as_buffer()).read_all().to_batches()


def levels(documents: DataFrame, labels: DataFrame, keep: str | None = None) -> DataFrame:
    """doc_id, level (1 to 5, as the raters' grades), error (its standard error), n_words (distinct), and the column keep as a string."""
    out = _levels(documents.select("doc_id", "text", (F.col(keep) if keep else F.lit(None)).cast("string").alias("kept")), labels)
    return out.withColumnRenamed("kept", keep) if keep else out.drop("kept")


def _levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, level double, error double, n_words int, kept string"
    items = documents.mapInArrow(_items, f"doc_id {kind}, items array<bigint>, kept string")
    items = written(items.join(grades(labels), "doc_id", "left").select("doc_id", "items", "kept", "grade"), "reading-items")
    mean, sd, n = items.agg(F.avg("grade"), F.stddev_pop("grade"), F.count("grade")).first()
    if not n:
        return items.select("doc_id", F.lit(None).cast("double").alias("level"), F.lit(None).cast("double").alias("error"), F.size("items").alias("n_words"), "kept")
    sd = sd or 1.0
    shared_dir(spark)  # difficulties are checkpointed
    parts = items.rdd.getNumPartitions()
    ranges = min(parts, 64 + parts // 8)
    chunks = written(items.mapInArrow(_chunks(parts, ranges), _CHUNK), "reading-chunks")
    fit = Fit(chunks, parts, ranges, mean, sd)
    words, pieces = fit.settled()
    n, x, y, xx, xy = words.facts[6:] / np.array([1, *[words.facts[6]] * 4])
    var = xx - x * x
    slope = sd * (xy - x * y) / var if var > 1e-12 * xx else 0.0
    line = float(slope), float(mean + sd * y - slope * x)
    rows = chunks.select("chunk", "rows").rdd.map(lambda r: (r[0] % parts, ("rows", *r))).partitionBy(parts, _same)
    out = spark.sparkContext.union([pieces, rows, fit.docs]).mapPartitions(_apply(words.shared(), line))
    return spark.createDataFrame(out, "data binary").mapInArrow(_unpacked, schema)
