"""Merkle roots, state digests and fingerprints of sets of records.

Merkle root. Leaves are SHA-256 values, so they spread evenly: they are dealt into buckets by their leading bits, numbered
inside each bucket in order, and offset by the counts of the buckets before (a few thousand numbers). A block of BLOCK
neighbours is then one subtree and one row; the next level is the same on a thousandth of the rows. No task ever holds
more than a bucket, and the result depends on neither order nor partitioning.

Digests over an order (state digest, fingerprint, corpus digest) are one SHA-256 over the sorted rows, which can't be
summed in parts: rows are sorted on the executors and folded on the driver one partition at a time, in constant state.

Defined cases. Equal leaves are one; null ids are none; no leaves give the digest of "empty".
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions import text as T

NODE, LEAF, STATE = "veristrata/manifest/v1", "veristrata/leaf/v1", "veristrata/state/v1"
BLOCK, BUCKET_ROWS = 1024, 50_000


def leaf(identifier: Column) -> Column:
    """Leaf hash, as hex."""
    return F.sha2(F.concat(F.lit(LEAF), F.lit("\0"), identifier).cast("binary"), 256)


def empty_root() -> str:
    return hashlib.sha256((NODE + "\0empty").encode()).hexdigest()


def fold_block(leaves: list[bytes], whole: bool) -> bytes:
    """Root of neighbouring nodes; an odd last node meets itself. Unless the block is the whole tree it rises log2(BLOCK) levels."""
    rises = 0
    while len(leaves) > 1 or (not whole and 1 << rises < BLOCK):
        leaves = [hashlib.sha256(NODE.encode() + leaves[i] + leaves[min(i + 1, len(leaves) - 1)]).digest() for i in range(0, len(leaves), 2)]
        rises += 1
    return leaves[0]


def _numbered(leaves: DataFrame, n: int) -> DataFrame:
    """h, at: each leaf's place in sorted order."""
    digits = min(4, max(0, len(f"{max(n // BUCKET_ROWS, 1):x}")) if n > BUCKET_ROWS else 0)
    own = leaves.withColumn("bucket", F.substring("h", 1, digits) if digits else F.lit(""))
    sizes = sorted((r["bucket"], r["n"]) for r in own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 16^4 rows
    starts, at = [], 0
    for bucket, size in sizes:
        starts.append((bucket, at))
        at += size
    offsets = leaves.sparkSession.createDataFrame(starts, "bucket string, start long")
    place = F.row_number().over(W.partitionBy("bucket").orderBy("h")) - 1
    return own.withColumn("place", place).join(F.broadcast(offsets), "bucket").select("h", (F.col("start") + F.col("place")).alias("at"))


def _folded(whole: bool):
    def root(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"h": [fold_block([bytes.fromhex(h) for h in part.sort_values("at")["h"]], whole).hex()], "at": [key[0]]})

    return root


def merkle_root(identifiers: DataFrame) -> str:
    """Root over the distinct strings of the one column, as hex."""
    name = identifiers.columns[0]
    leaves = identifiers.where(F.col(name).isNotNull()).select(leaf(F.col(name)).alias("h")).distinct()
    n = leaves.count()
    if not n:
        return empty_root()
    level = _numbered(leaves, n)
    while True:
        whole = n <= BLOCK
        level = level.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("block").applyInPandas(_folded(whole), "h string, at long")
        n = -(-n // BLOCK)
        if whole:
            return level.first()["h"]


def ordered_digest(rows: DataFrame, head: bytes = b"") -> str:
    """SHA-256 over head and the one string column, sorted, each value with a zero byte before it."""
    name, sha = rows.columns[0], hashlib.sha256(head)
    for row in rows.where(F.col(name).isNotNull()).distinct().orderBy(name).toLocalIterator():
        sha.update(b"\0" + row[0].encode())
    return sha.hexdigest()


def state_digest(claims: DataFrame) -> str:
    """Digest of the sorted (id, state) of all claims."""
    return ordered_digest(claims.where("id IS NOT NULL").select(F.concat_ws("\0", "id", F.coalesce("state", F.lit("")))), STATE.encode())


def fingerprint(identifiers: DataFrame) -> str:
    """Digest of the distinct ids, one a line in order."""
    name, sha, first = identifiers.columns[0], hashlib.sha256(), True
    for row in identifiers.where(F.col(name).isNotNull()).distinct().orderBy(name).toLocalIterator():
        sha.update(("" if first else "\n").encode() + row[0].encode())
        first = False
    return sha.hexdigest()


def version(root: Column) -> Column:
    return F.concat(F.lit("v1-"), F.substring(root, 1, 16))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change (added, removed) of two sets of ids."""
    a, b = before.select("id").where("id IS NOT NULL").distinct(), after.select("id").where("id IS NOT NULL").distinct()
    return b.join(a, "id", "left_anti").select("id", F.lit("added").alias("change")).unionByName(a.join(b, "id", "left_anti").select("id", F.lit("removed").alias("change")))


def union_ids(*tables: DataFrame) -> DataFrame:
    """Distinct ids of all tables (insert-or-ignore)."""
    out = tables[0].select("id")
    for t in tables[1:]:
        out = out.unionByName(t.select("id"))
    return out.where("id IS NOT NULL").distinct()
