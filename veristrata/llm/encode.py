"""P8: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: the words (pre-tokens) of all documents are counted; the FREQUENT commonest are encoded once, by exact
merging, and compiled into a minimal acyclic transducer: a shared-suffix automaton over bytes whose transitions carry
the number of words before them, so that a walk gives a word's number and with it its ids. Its arrays lie in the
shared folder and tasks map them into memory. A batch's distinct words walk it together; words it doesn't hold are
merged exactly. The lexicon is bounded by FREQUENT and only changes the speed: every word it holds was merged exactly.

Defined cases. A null and an empty text give an empty list. Strings of special tokens are ordinary text. Any other
text is encoded whole, however long. Repeated rows give repeated rows; a null id stays null. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.session import shared_dir, written

FREQUENT = 1 << 16
#: Longer words are left to exact merging.
LONGEST = 64
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that divides a text into words before merging, published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_plainly(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging as defined: the lowest-ranked neighbouring pair first. Quadratic; the tests' yardstick."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def merger(ranks: dict[bytes, int]):
    """Exact ids of one word."""
    import tiktoken

    # a pattern that takes any text as one word: the caller has divided the text already
    return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Lexicon:
    """A minimal acyclic automaton in arrays: of transition t, key[t] = state << 8 | byte (sorted), to[t] its target and
    before[t] the number of words that sort before those through it; final[s] tells whether a word ends in s."""

    NAMES = ("key", "to", "before", "final", "start", "ids")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(entries)
        # states on the path of the last word: [final, {byte: state}]; finished states are shared by their signature
        register: dict[tuple, int] = {}
        states: list[tuple] = []
        path: list[list] = [[False, {}]]

        def close(depth: int, last: bytes) -> None:
            for d in range(len(path) - 1, depth, -1):
                final, out = path.pop()
                sign = (final, tuple(out.items()))
                if sign not in register:
                    register[sign] = len(states)
                    states.append(sign)
                path[-1][1][last[d - 1]] = register[sign]

        last = b""
        for word in words:
            common = len(os.path.commonprefix([last, word]))
            close(common, last)
            for _ in word[common:]:
                path.append([False, {}])
            path[-1][0] = True
            last = word
        close(0, last)
        root = len(states)
        states.append((path[0][0], tuple(path[0][1].items())))
        counts = [0] * len(states)
        rows = []
        for s, (final, out) in enumerate(states):  # targets come before their sources
            n = int(final)
            for byte, target in out:
                rows.append((s, byte, target, n))
                n += counts[target]
            counts[s] = n
        # number the root 0
        move = lambda s: 0 if s == root else s + 1
        rows = sorted((move(s) << 8 | byte, move(t), n) for s, byte, t, n in rows)
        final = np.zeros(len(states) + 1, bool)
        final[[move(s) for s, (f, _) in enumerate(states) if f]] = True
        key, to, before = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        lengths = [len(entries[w]) for w in words]
        return cls(key=key, to=to.astype(np.int32), before=before.astype(np.int32), final=final, start=np.r_[0, np.cumsum(lengths)].astype(np.int64), ids=np.array([i for w in words for i in entries[w]], np.int32))

    def save(self, folder: str) -> None:
        os.makedirs(folder)
        for name in self.NAMES:
            np.save(f"{folder}/{name}.npy", getattr(self, name))

    @classmethod
    def mapped(cls, folder: str) -> Lexicon:
        return cls(**{name: np.load(f"{folder}/{name}.npy", mmap_mode="r") for name in cls.NAMES})

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in sorted order, -1 where the lexicon doesn't hold it. All words walk together."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        number, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST)) if len(self.key) else np.zeros(0, np.int64)
        gone = np.ones(n, bool)
        gone[live] = False
        begin = np.r_[0, np.cumsum(lengths)]
        text = np.frombuffer(b"".join(words), np.uint8)
        depth = 0
        while len(live):
            key = state[live] << 8 | text[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            gone[live[~ok]] = True
            live, at = live[ok], at[ok]
            number[live] += self.before[at]
            state[live] = self.to[at]
            depth += 1
            live = live[lengths[live] > depth]
        return np.where(gone | ~self.final[state], -1, number)

    def outputs(self, number: int) -> list[int]:
        return self.ids[self.start[number] : self.start[number + 1]].tolist()


def _count_words(text_col: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, seen = regex.compile(PATTERN).findall, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                if text:
                    seen.update(find(text))
            if len(seen) > 300_000:  # bounds a task's memory; the sums below are the same
                yield out()
                seen.clear()
        if seen:
            yield out()

    return count


def word_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all documents; counted within each task before the shuffle."""
    return documents.select(text_col).mapInArrow(_count_words(text_col), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: Counts up to EXACT are cut exactly, larger ones in steps of 1/STEPS of a doubling: a few hundred rows in all.
EXACT, STEPS = 64, 8


def least_count(counts: DataFrame, frequent: int) -> int:
    """The least n at which no more than ``frequent`` words have n or more occurrences, from a histogram of a few hundred rows."""
    step = F.when(F.col("n") <= EXACT, F.col("n")).otherwise(F.floor(EXACT + STEPS * F.log2(F.col("n") / EXACT)))
    held, least = 0, 1 << 62
    for row in counts.groupBy(step.cast("int").alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        held += row["words"]
        if held > frequent:
            break
        least = row["n"]
    return least


def build_lexicon(documents: DataFrame, ranks: dict[bytes, int], text_col: str = "text", frequent: int = FREQUENT) -> Lexicon:
    """The lexicon of the commonest words of at most LONGEST bytes and two or more occurrences: as many whole steps of
    the histogram as make no more than ``frequent`` words. Only these words come to the driver."""
    counts = written(word_counts(documents, text_col).where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST)), "word-counts")
    common = counts.where(F.col("n") >= least_count(counts, frequent))
    merge = merger(ranks)
    return Lexicon.compile({row["word"].encode(): merge(row["word"]) for row in common.select("word").collect()})


def _shipped(spark: SparkSession, lexicon: Lexicon):
    """How tasks get the lexicon: mapped from the shared folder where that is a mounted path, else broadcast (bounded by FREQUENT)."""
    folder = shared_dir(spark)
    if folder.startswith("file:") or folder.startswith("/"):
        path = f"{folder.removeprefix('file://').removeprefix('file:')}/lexicon-{uuid.uuid4().hex}"
        lexicon.save(path)
        return lambda: Lexicon.mapped(path)
    held = spark.sparkContext.broadcast(lexicon)
    return lambda: held.value


def _encode(id_col: str, text_col: str, ranks, lexicon, only_count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, merge, held = regex.compile(PATTERN).findall, merger(ranks.value), lexicon()
        known: dict[str, list[int]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            ids_of = batch.column(batch.schema.get_field_index(id_col))
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            for a in range(0, len(texts), 512):
                divided = [find(t) if t else () for t in texts[a : a + 512]]
                if len(known) > 200_000:
                    known.clear()
                    size.clear()
                new = list({w for ws in divided for w in ws if w not in known})
                if new:
                    for word, number in zip(new, held.numbers([w.encode() for w in new]).tolist()):
                        known[word] = held.outputs(number) if number >= 0 else merge(word)
                if only_count:
                    size.update((w, len(known[w])) for w in new)
                    out = pa.array([sum([size[w] for w in ws]) for ws in divided], pa.int64())
                else:
                    out = pa.array([[i for w in ws for i in known[w]] for ws in divided], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([ids_of.slice(a, len(divided)), out], names=[id_col, "n_tokens" if only_count else "ids"])

    return run


def encoded(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, frequent: int = FREQUENT, only_count: bool = False) -> DataFrame:
    """id, ids (array of int) of every document, or id, n_tokens (long)."""
    spark = documents.sparkSession
    ranks = load_ranks(vocabulary or f"{TOKENIZERS}/{VOCABULARY}")
    lexicon = _shipped(spark, build_lexicon(documents, ranks, text_col, frequent))
    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ("n_tokens long" if only_count else "ids array<int>")
    return documents.select(id_col, text_col).mapInArrow(_encode(id_col, text_col, spark.sparkContext.broadcast(ranks), lexicon, only_count), schema)
