"""Hash chains over an ordered log: each record's hash covers the one before it.

Building a chain is a fold and runs over one log at a time, inside its group; verifying is a window: a record's hash needs
its own fields and the hash stored before it, so all links of all logs are checked in parallel.

Defined cases. Null fields hash as empty strings. The first record of a log follows GENESIS. Records of one log with one
sequence number have no order, so both are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64


def payload(*fields: str) -> Column:
    """The fields as one string with unit separators."""
    return F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))


def chained(rows: DataFrame, log: str, seq: str, fields: list[str]) -> DataFrame:
    """The rows with prev_hash and chain_hash. A log's records are hashed in order of seq as its sorted partition streams by; one value is kept."""
    own = rows.withColumn("_payload", payload(seq, *fields))
    names = own.columns
    schema = own.schema.add("prev_hash", "string").add("chain_hash", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = object(), GENESIS
        for batch in batches:
            before, after = [], []
            for key, text in zip(batch.column(names.index(log)).to_pylist(), batch.column(names.index("_payload")).to_pylist()):
                if key != at:
                    at, last = key, GENESIS
                before.append(last)
                last = hashlib.sha256(f"{last}\x1f{text}".encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*names, "prev_hash", "chain_hash"])

    return own.repartition(F.col(log)).sortWithinPartitions(log, seq).mapInArrow(run, schema).drop("_payload")


def broken_links(rows: DataFrame, log: str, seq: str, fields: list[str]) -> DataFrame:
    """log, seq, reason of every record whose hash, or whose link to the record before it, is wrong."""
    window = W.partitionBy(log).orderBy(seq)
    before = F.coalesce(F.lag("chain_hash").over(window), F.lit(GENESIS))
    twice = F.coalesce(F.lag(seq).over(window) == F.col(seq), F.lit(False)) | F.coalesce(F.lead(seq).over(window) == F.col(seq), F.lit(False))
    own = F.sha2(F.concat(F.coalesce("prev_hash", F.lit("")), F.lit("\x1f"), payload(seq, *fields)).cast("binary"), 256)
    reason = F.when(twice, "repeated").when(~F.col("prev_hash").eqNullSafe(before), "link").when(~F.col("chain_hash").eqNullSafe(own), "content")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(log, seq, "reason")
