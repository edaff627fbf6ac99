"""Bloom filters of once- and repeatedly-seen hashes, built per partition and merged on the executors.

A partition keeps the positions of all its hashes (once) and of those it saw again (repeated). Merging in any
order keeps: repeated |= their repeated | (once & their once), once |= their once. A hash that occurs twice
anywhere therefore has all its bits in the merged repeated filter; there are no false negatives. False positives
only mean that more rows are shuffled to the exact step.

The filter has 16 bits for each row, in a power of two. MAX_BITS bounds what is collected and broadcast; a caller with
more rows than that divides its hashes into ranges with a filter each (form_copies). Results don't depend on its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

MAX_BITS = 1 << 28
BLOCK = 1 << 15  # bytes of a filter that travel as one row
HASHES = 5


def bits_for(rows: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, max(1 << 20, 1 << (16 * max(rows, 1) - 1).bit_length()))


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """(HASHES, n) bit positions of 64-bit hashes."""
    u = h.astype(np.uint64)
    u = (u ^ (u >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    step = (u >> np.uint64(32)) | np.uint64(1)
    return np.stack([(u + np.uint64(i) * step * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bits.bit_length() - 1)) for i in range(HASHES)]).astype(np.int64)


def _packed(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bytes that hold bits, and the bytes' values."""
    pos = np.unique(pos)
    at = pos >> 3
    if not len(at):
        return at, np.zeros(0, np.uint8)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.bitwise_or.reduceat((1 << (pos & 7)).astype(np.uint8), first)


def _partials(column: str, bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = bits // 8
        once, again = {}, {}

        def mark(held: dict, pos: np.ndarray) -> None:
            at, value = _packed(pos.ravel())
            cuts = np.searchsorted(at // BLOCK, np.unique(at // BLOCK)).tolist() + [len(at)]
            for a, b in zip(cuts, cuts[1:]):
                k = int(at[a]) // BLOCK
                if k not in held:
                    held[k] = np.zeros(min(BLOCK, size), np.uint8)
                held[k][at[a:b] - k * BLOCK] |= value[a:b]

        for batch in batches:
            h = batch.column(batch.schema.get_field_index(column)).drop_null().to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            u, n = np.unique(h, return_counts=True)
            pos = positions(u, bits)
            before = np.ones(len(u), bool)
            for p in pos:  # all bits set by earlier batches: perhaps a repeat
                have = np.zeros(len(u), np.uint8)
                block, offset = (p >> 3) // BLOCK, (p >> 3) % BLOCK
                for k in np.unique(block):
                    if (held := once.get(int(k))) is not None:
                        m = block == k
                        have[m] = (held[offset[m]] >> (p[m] & 7).astype(np.uint8)) & 1
                before &= have.astype(bool)
            mark(again, pos[:, (n > 1) | before])
            mark(once, pos)
        empty, lane = bytes(min(BLOCK, size)), TaskContext.get().partitionId() % 16
        for k in once:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lane], pa.int32()), pa.array([once[k].tobytes()], pa.binary()), pa.array([again[k].tobytes() if k in again else empty], pa.binary())], names=["block", "lane", "once", "again"])

    return build


def _merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    once = again = None
    for o, a in zip(part["once"], part["again"]):
        o, a = np.frombuffer(o, np.uint8), np.frombuffer(a, np.uint8)
        if once is None:
            once, again = o.copy(), a.copy()
        else:
            again |= a | (once & o)
            once |= o
    return pd.DataFrame({"block": [key[0]], "lane": [0], "once": [once.tobytes()], "again": [again.tobytes()]})


_SCHEMA = "block int, lane int, once binary, again binary"


def repeated_filter(hashes: DataFrame, column: str, rows: int, max_bits: int = MAX_BITS) -> tuple[int, np.ndarray]:
    """The merged repeated filter of a column of 64-bit hashes: number of bits, and its bytes (bits / 8 of them).

    Blocks merge in two steps, first in 16 lanes and then across them, so no task holds all partitions' blocks.
    """
    bits = bits_for(rows, max_bits)
    parts = hashes.select(column).mapInArrow(_partials(column, bits), _SCHEMA)
    merged = parts.groupBy("block", "lane").applyInPandas(_merge, _SCHEMA).groupBy("block").applyInPandas(_merge, _SCHEMA)
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.select("block", "again").toLocalIterator():  # at most MAX_BITS / 8 bytes in all
        block = np.frombuffer(row["again"], np.uint8)
        out[row["block"] * BLOCK : row["block"] * BLOCK + len(block)] = block
    return bits, out


def maybe_in(h: np.ndarray, bits: int, held: np.ndarray) -> np.ndarray:
    keep = np.ones(len(h), bool)
    for p in positions(h, bits):
        keep &= ((held[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
    return keep


def only_possible_repeats(rows: DataFrame, column: str, bits: int, held: np.ndarray, keep: bool = True) -> DataFrame:
    """The rows whose hash may occur more than once (keep=True), or the others, which surely occur once."""
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
            if len(h):
                yield batch.filter(pa.array(maybe_in(h, bits, shared.value) == keep))

    return rows.mapInArrow(pick, rows.schema)
